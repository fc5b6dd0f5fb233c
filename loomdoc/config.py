"""Settings of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# The patterns and limits that results depend on.
HEADER_PATTERNS = (r"^\d+(\.\d+)*\s+", r"^[A-Z][A-Z\s]{10,}$", r"^(Chapter|Section|Part)\s+\d+", r"^#{1,6}\s+")
CHUNK_SCOPES = (r"^[A-Za-z]+\s+(?:\d+|[IVX]+)$", r"^(?:PART|SECTION|CHAPTER|VOLUME)\s+", r"^[A-Z][A-Z\s0-9]{3,50}$")
LAYOUT_SECTIONS = (r"^(?:CHAPTER|UNIT|SECTION|PART)\s+[IVXLCDM\d]+", r"^(?:SEMESTER|SEM)\s+[IVXLCDM\d]+", r"^\d+\.\s+[A-Z]", r"^[IVXLCDM]+\.\s+[A-Z]", r"^[A-Z][A-Z\s]{10,}$")
LAYOUT_SCOPES = (r"(?:SEMESTER|SEM)\s+([IVXLCDM]+|\d+)", r"(?:YEAR|YR)\s+([IVXLCDM]+|\d+)", r"(?:PART|SECTION)\s+([A-Z]|\d+)", r"(?:CHAPTER|UNIT)\s+([IVXLCDM]+|\d+)")
LAYOUT_EXCLUDED = (r"^Page\s+\d+", r"^\d+$", r"^https?://")
LAYOUT_LEVELS = ((r"(?i)^(?:CHAPTER|UNIT)\s+[IVXLCDM\d]+", 1), (r"(?i)^(?:SEMESTER|SEM|PART)\s+[IVXLCDM\d]+", 1), (r"^\d+\.\s+[A-Z]", 2), (r"^\d+\.\d+\s+[A-Z]", 3))
SECTION_CATEGORIES = ("Title", "SectionHeader", "Header")
EXCLUDED_CATEGORIES = ("Header", "Footer", "PageNumber")
# White space after a mark; the white space is looked for first, as most characters are none.
SENTENCE_END = r"\s(?<=[.!?。！？।]\s)\s*"
LISTING_WORDS = ("semester", "course", "papers", "subjects", "list", "all", "what are")
ENTITY_BLOCK, SECTION_BLOCK = "=== Extracted Entities ===", "\n=== Retrieved Document Sections ==="
HIDDEN_ATTRIBUTES = ("pattern", "original_text")
LISTED_TYPE = "course"
STOP_WORDS = ("what", "which", "where", "when", "that", "this", "from")


@dataclass(frozen=True)
class ChunkConfig:
    min_chars: int = 300
    max_chars: int = 4000
    overlap_chars: int = 200
    header_patterns: tuple[str, ...] = HEADER_PATTERNS
    low_signal: bool = False
    min_words: int = 20
    alpha_share: float = 0.3
    min_header: int = 5
    max_scope: int = 100
    language: str = "en"


DEFAULT = ChunkConfig()
RESEARCH_PAPER = replace(DEFAULT, min_chars=200, max_chars=2000, overlap_chars=150, low_signal=True)
DOCUMENTATION = replace(DEFAULT, min_chars=400, max_chars=5000, header_patterns=(r"^#{1,6}\s+", r"^\d+(\.\d+)*\s+", r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*\s*$"))
REGULATIONS = replace(DEFAULT, header_patterns=(r"^\d+(\.\d+)*\s+", r"^(Article|Section|Rule|Clause)\s+\d+", r"^[A-Z][A-Z\s]{5,}$"))
PRESETS = {"default": DEFAULT, "research_paper": RESEARCH_PAPER, "documentation": DOCUMENTATION, "regulations": REGULATIONS}


@dataclass(frozen=True)
class RetrievalConfig:
    top_k: int = 3
    max_context_tokens: int = 2000
    chars_per_token: int = 4
    max_entities: int = 20
    terms: int = 3
    separator: str = "\n---\n"
    listing_words: tuple[str, ...] = LISTING_WORDS
    stop_words: tuple[str, ...] = STOP_WORDS


@dataclass(frozen=True)
class TableConfig:
    row_tolerance: float = 8.0
    column_gap: float = 20.0
    column_slack: float = 10.0
    min_columns: int = 2
    min_rows: int = 2
    code: str = r"^[A-Z][A-Z0-9]{4,15}$"
    indicators: tuple[str, ...] = field(default=(r"^S\.?\s*No\.?$", r"^(?:Course|Subject)\s*(?:Code|No\.?)?", r"^(?:Course|Subject)\s*(?:Title|Name)", r"^Credits?$", r"^Hours?$", r"^L\s*T\s*P"))
    headers: tuple[str, ...] = field(default=(r"^S\.?\s*No\.?", r"^(?:Course|Subject)", r"^(?:Code|Title|Name|Category)", r"^Credits?", r"^Hours?", r"^L$|^T$|^P$|^J$|^C$", r"^Pre.?req"))
