"""DOCX bytes to elements, with the standard library only."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def paragraphs(content: bytes) -> list[tuple[str, str, int]]:
    """Text, category and level of each paragraph: headings by their style, or short texts in capitals."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for p in root.iter(f"{NS}p"):
        text = "".join(t.text or "" for t in p.iter(f"{NS}t")).strip()
        if not text:
            continue
        style = p.find(f"{NS}pPr/{NS}pStyle")
        name = style.get(f"{NS}val", "") if style is not None else ""
        headed = name.startswith("Heading") or (len(text) < 100 and text.isupper())
        level = re.search(r"(\d)$", name)
        out.append((text, "Title" if headed else "NarrativeText", int(level[1]) if level else 1))
    return out


def docx_elements(files: DataFrame) -> DataFrame:
    """doc_id, pos, text, category, level, error of (doc_id string, content binary); a file that can't be read gives one row with its error."""
    schema = pa.schema([("doc_id", pa.string()), ("pos", pa.int32()), ("text", pa.string()), ("category", pa.string()), ("level", pa.int32()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for doc_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows = [(doc_id, i, *p, None) for i, p in enumerate(paragraphs(content or b""))]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
                    rows = [(doc_id, 0, None, None, None, f"{type(e).__name__}: {e}")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, schema.types)], schema=schema)

    return files.select("doc_id", "content").mapInArrow(run, "doc_id string, pos int, text string, category string, level int, error string")
