"""Entities by patterns.

One pattern alone runs in the JVM: matches by regexp_extract_all, offsets from the gaps that split leaves. So does the whole set (`extract_by_rows`): its overlap
rule depends on the order of acceptance, but only among spans that overlap, so that each such cluster is folded by itself. `extract` does the
same as an Arrow function over whole texts, for patterns that only Python's expressions can say.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import bound

# Name, type, confidence, priority, pattern; matching ignores case and is by line.
PATTERNS = (
    ("alphanumeric_code", "code", 0.85, 10, r"\b[A-Z][A-Z0-9]{2,4}[A-Z0-9\-_]{2,10}\b"),
    ("titled_person", "person", 0.90, 10, r"(?:Dr\.?|Prof\.?|Mr\.?|Ms\.?|Mrs\.?|Shri|Smt\.?)\s+[A-Z][a-z]+(?:\s+[A-Z]\.?)?(?:\s+[A-Z][a-z]+)?"),
    ("org_with_suffix", "org", 0.85, 10, r"[A-Z][A-Za-z\s]+(?:Inc\.?|LLC|Ltd\.?|Corp\.?|University|Institute|College|Hospital|Foundation)"),
    ("date_mdy", "date", 0.95, 10, r"(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.?\s+\d{1,2},?\s+\d{4}"),
    ("currency", "amount", 0.95, 10, r"(?:\$|Rs\.?|₹|€|£)\s*[\d,]+(?:\.\d{2})?"),
    ("email", "email", 0.98, 10, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", "phone", 0.90, 10, r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"),
    ("url", "url", 0.98, 10, r"https?://[^\s<>\"{}|\\^`\[\]]+"),
    ("semester_date", "date", 0.90, 8, r"(?:Semester|Sem|Year|Quarter|Fall|Spring|Summer|Winter)\s+(?:[IVXLCDM]+|\d{1,2}|\d{4})"),
    ("section_code", "code", 0.90, 5, r"(?:Section|Clause|Article|Rule)\s+(\d+(?:\.\d+)*)"),
    ("name_with_suffix", "person", 0.85, 5, r"[A-Z][a-z]+\s+[A-Z][a-z]+\s+(?:Jr\.?|Sr\.?|PhD|MD|MBA)"),
    ("acronym_org", "org", 0.70, 5, r"\b[A-Z]{2,6}\b(?=\s+(?:standard|committee|organization|association))"),
    ("date_dmy", "date", 0.90, 5, r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}"),
    ("credit_hours", "amount", 0.90, 5, r"\d+(?:\.\d+)?\s*(?:credits?|hours?|units?|points?)"),
    ("percentage", "amount", 0.95, 5, r"\d+(?:\.\d+)?%"),
)
TITLED = ("titled_person", "name_with_suffix")
SQUEEZED = ("org_with_suffix", "date_mdy", "semester_date")


@dataclass(frozen=True)
class NerConfig:
    types: tuple[str, ...] | None = None  # None: all
    custom: tuple[tuple[str, str, float, int, str], ...] = ()
    min_length: int = 2

    def patterns(self) -> list[tuple]:
        chosen = [p for p in PATTERNS if self.types is None or p[1] in self.types] + list(self.custom)
        return sorted(chosen, key=lambda p: -p[3])


def pattern(name: str) -> str:
    return next(p[4] for p in PATTERNS if p[0] == name)


#: What a text must hold for the pattern to match, read with the pattern's flags: it fails fast where the pattern would try an open run or many words from each letter.
NEEDED = {
    "org_with_suffix": "(?i)inc|llc|ltd|corp|university|institute|college|hospital|foundation",
    "date_mdy": r"\s\d{1,2},?\s+\d{4}",
    "email": "@",
    "phone": r"\d{3}[-.\s]?\d{4}",
    "url": "://",
    "section_code": r"\s\d",
    "name_with_suffix": r"\s(?:Jr|Sr|PhD|MD|MBA)",
    "acronym_org": r"\s(?:standard|committee|organization|association)",
    "date_dmy": r"\d[-/]\d",
    "credit_hours": r"\d\s*(?:credit|hour|unit|point)",
    "percentage": r"\d%",
}
#: A match of organisations takes the last suffix of a run of letters, and begins with the run's first letter: any other place is refused at once, so that long runs aren't tried from each of their letters.
ANCHORED = {"org_with_suffix": r"(?<![A-Za-z\s])\s*"}


def matches(c: Column, regex: str, needed: str | None = None) -> Column:
    found = F.regexp_extract_all(c, F.lit(f"(?iUm){regex}"), 0)
    return found if needed is None else F.when(c.rlike(f"(?iUm){needed}"), found).otherwise(F.array().cast("array<string>"))


def spans(c: Column, regex: str) -> Column:
    """Array of begin, end, text of each match."""
    found, gaps = matches(c, regex), F.split(c, f"(?iUm){regex}", -1)
    upto = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda s, x: s + F.length(x))
    return F.transform(found, lambda m, i: F.struct((upto(gaps, i + 1) + upto(found, i)).alias("begin"), (upto(gaps, i + 1) + upto(found, i + 1)).alias("end"), m.alias("text")))


SPAN = "array<struct<type:string,text:string,begin:int,end:int,pattern:string,confidence:double>>"


LETTER_RUN = re.compile(r"[A-Za-z\s]{2,}", re.I)
SUFFIX = re.compile(NEEDED["org_with_suffix"])
HELD = {pattern(name): re.compile(p, re.I | re.M) for name, p in NEEDED.items()}


def _found(name: str, regex: re.Pattern, text: str):
    """regex.finditer(text); that of organisations is only tried in runs of letters that hold a suffix, as any other run fails from each of its letters anew."""
    if name != "org_with_suffix":
        held = HELD.get(regex.pattern)
        if held is None or held.search(text):
            yield from regex.finditer(text)
    elif SUFFIX.search(text):
        for run in LETTER_RUN.finditer(text):
            if SUFFIX.search(text, run.start(), run.end()):
                yield from regex.finditer(text, run.start(), run.end() + 1)


def _accepted(text: str, compiled: list[tuple], least: int) -> list[dict]:
    taken = bytearray(len(text))  # characters of accepted spans
    out, seen = [], set()
    for name, kind, confidence, regex in compiled:
        for m in _found(name, regex, text):
            found, (b, e) = m.group(0), m.span()
            if name in SQUEEZED or name in TITLED:
                found = " ".join(found.split())
            if name in TITLED:
                found = found.title()
            if len(found) < least or taken[b] or taken[e - 1]:
                continue
            taken[b:e] = b"\1" * (e - b)
            if (key := (kind, found.lower())) not in seen:
                seen.add(key)
                out.append({"type": kind, "text": found, "begin": b, "end": e, "pattern": name, "confidence": confidence})
    return out


def extract(docs: DataFrame, cfg: NerConfig = NerConfig()) -> DataFrame:
    """docs (doc_id, text) to doc_id and one row for each entity. A span is refused if one of its ends lies in an accepted
    one; of equal entities of a text the first accepted stays."""
    chosen = cfg.patterns()

    def run(batches):
        compiled = [(n, k, c, re.compile(p, re.I | re.M)) for n, k, c, _, p in chosen]
        kind = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("pattern", pa.string()), ("confidence", pa.float64())]))
        for batch in batches:
            rows = [_accepted(t or "", compiled, cfg.min_length) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, found {SPAN}").select("doc_id", F.inline("found"))


def _pieces(c: Column, order: int, name: str, regex: str) -> Column:
    """Array of order, number k, length of the gap before, and match."""
    needed, regex = NEEDED.get(name) if regex in HELD else None, f"(?iUm){ANCHORED.get(name, '')}{regex}"
    cut = lambda found: bound(F.split(c, regex, -1), lambda gaps: F.transform(found, lambda m, k: F.struct(F.lit(order).alias("order"), k.alias("k"), F.length(F.get(gaps, k)).alias("gap"), m.alias("m"))))
    found = F.regexp_extract_all(c, F.lit(regex), 0)
    some = bound(found, lambda f: F.when(F.size(f) > 0, cut(f)))
    some = some if needed is None else F.when(c.rlike(f"(?iUm){needed}"), some)
    return F.coalesce(some, F.array().cast("array<struct<order:int,k:int,gap:int,m:string>>"))


def _first_come(spans: Column) -> Column:
    """Spans in order of acceptance; one is refused if one of its ends lies in an accepted one."""
    inside = lambda s, x: (s["begin"] >= x["begin"]) & (s["begin"] < x["end"]) | (s["end"] > x["begin"]) & (s["end"] <= x["end"])
    none = F.array().cast("array<struct<order:int,begin:int,end:int,text:string>>")
    return F.aggregate(spans, none, lambda acc, s: F.when(F.exists(acc, lambda x: inside(s, x)), acc).otherwise(F.concat(acc, F.array(s))))


def extract_by_rows(docs: DataFrame, cfg: NerConfig = NerConfig()) -> DataFrame:
    """What `extract` gives, by DataFrame functions alone: matches are rows, dealt once by document. Rows of docs are taken one by one,
    those with the same doc_id or none too; texts that are null or empty give nothing. Custom patterns are read as Java reads them.
    White space is Unicode's, without the four separators that Python counts besides (U+001C to U+001F)."""
    chosen = cfg.patterns()
    listed = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in chosen)), F.col("order") + 1)
    among = lambda names: F.col("order").isin([i for i, p in enumerate(chosen) if p[0] in names])
    pieces = F.flatten(F.array(*(_pieces(F.col("text"), i, p[0], p[4]) for i, p in enumerate(chosen))))
    rows = docs.select("doc_id", "text").where("text <> ''").withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.explode_outer(pieces).alias("piece")).where("piece is not null")
    rows = rows.select("row", "doc_id", "piece.*").repartition("row")
    of_pattern, of_row = Window.partitionBy("row", "order").orderBy("k"), Window.partitionBy("row").orderBy("begin", "order")
    bare = F.when(among(ANCHORED), F.regexp_replace("m", r"(?U)^\s+", "")).otherwise(F.col("m"))
    placed = rows.withColumn("end", F.sum(F.col("gap") + F.length("m")).over(of_pattern).cast("int")).withColumn("m", bare).withColumn("begin", F.col("end") - F.length("m"))
    squeezed = F.when(among(SQUEEZED + TITLED), F.trim(F.regexp_replace("m", r"(?U)\s+", " "))).otherwise(F.col("m"))
    spans = placed.select("row", "doc_id", "order", "begin", "end", F.when(among(TITLED), F.initcap(squeezed)).otherwise(squeezed).alias("text")).where(F.length("text") >= cfg.min_length)
    reached = F.max("end").over(of_row.rowsBetween(Window.unboundedPreceding, -1))
    clustered = spans.withColumn("new", F.when(F.col("begin") >= reached, 1).otherwise(0)).withColumn("cluster", F.sum("new").over(of_row))
    together = clustered.groupBy("row", "doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("order", "begin", "end", "text"))).alias("spans"))
    accepted = together.select("row", "doc_id", F.explode_outer(_first_come(F.col("spans"))).alias("s")).select("row", "doc_id", "s.*").withColumn("type", listed(1))
    firsts = accepted.groupBy("row", "doc_id", "type", F.lower("text").alias("low")).agg(F.min(F.struct("order", "begin", "end", "text")).alias("s"))
    return firsts.select("doc_id", "type", "s.*").select("doc_id", "type", "text", "begin", "end", listed(0).alias("pattern"), listed(2).alias("confidence"))
