import hashlib
import os
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from loomdoc.config import ChunkConfig
from loomdoc.functions import text as T
from loomdoc.operators import chunking, layout, ner, store, tables, tree, vector
from loomdoc.plans import registry
from loomdoc.sources import readers
from loomdoc.sources.collections import Collections

DATA = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_against_sql(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    if name not in registry.ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {Path(f).stem} as select * from '{DATA}/{f}'")
    rel = con.sql(registry.ORACLES[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    assert sorted(at) == cols
    assert rows == sorted(repr(tuple(norm(r[at[c]]) for c in cols)) for r in rel.fetchall())


def test_section_scope_of_the_next_header(spark):
    rows = [(1, 0, "Preface words here.", "NarrativeText"), (1, 1, "Semester I", "Title"), (1, 2, "First body, one.", "NarrativeText"), (1, 3, "Semester II", "Title"), (1, 4, "Second body, two.", "NarrativeText")]
    found = chunking.section_chunks(spark.createDataFrame(rows, "doc_id int, pos int, text string, category string")).orderBy("section").collect()
    assert [(r.title, r.text, r.scope) for r in found] == [("Introduction", "[SEMESTER I] Preface words here.", "SEMESTER I"), ("Semester I", "[SEMESTER II] Semester I First body, one.", "SEMESTER II"), ("Semester II", "Semester II Second body, two.", "SEMESTER II")]


def test_merge_small(spark):
    chunks = [("t", "a" * 4), ("u", "b" * 4), ("v", "c" * 12), ("w", "d" * 20), ("x", "e" * 3)]
    df = spark.createDataFrame([(chunks,)], "c array<struct<title:string,text:string>>").select(chunking.merge_small(F.col("c"), 10, 25).alias("c"))
    assert [(c.title, c.text) for c in df.first()[0]] == [("t", "aaaa bbbb cccccccccccc"), ("w", "d" * 20 + " eee")]


def test_hard_split_takes_every_word_of_every_document(spark):
    want = {}
    for i, text in duckdb.sql(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall():
        parts = []
        for w in re.split(r"\s+", text):
            if w and parts and len(parts[-1]) + len(w) + 1 <= 120:
                parts[-1] += " " + w
            elif w:
                parts.append(w)
        want[i] = (len(parts), hashlib.sha256("|".join(parts).encode()).hexdigest())
    assert {r.id: (r.n, r.digest) for r in registry.QUERIES["hard_split_words"](spark, DATA).collect()} == want


def test_packed_parts_are_bounded(spark):
    text = "One two three. " * 40
    parts = spark.createDataFrame([(text.strip(),)], "t string").select(chunking.split_long(F.col("t"), ChunkConfig(max_chars=100, overlap_chars=10))).first()[0]
    assert len(parts) > 3 and all(len(p) <= 100 for p in parts)


def test_greedy_spans(spark):
    rows = [(1, "Dr. Kumar Rao"), (2, "Dr. John Smith"), (3, "Prof. A. Kumar"), (4, None), (5, "")]
    found = ner.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {i: [(r.type, r.text, r.begin, r.end) for r in found if r.doc_id == i] for i in range(1, 6)}
    assert got == {1: [("code", "Kumar", 4, 9), ("person", "Dr. Kumar R", 0, 11)], 2: [("code", "Smith", 9, 14)], 3: [("code", "Kumar", 9, 14)], 4: [], 5: []}


def test_extraction_by_rows_equals_row_by_row(spark):
    """Whole texts of sf0.001, with repeated and null keys, null and empty texts, overlaps, white space before organisations, an extra column of a clashing name."""
    texts = duckdb.connect().execute(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    odd = ["\n\t The Acme Widgets Inc. and Foo\nUniversity of it, Bar  College", "3.5 credits 7% 12/3/2024 $1,200.50 (202) 555-0143 Jan. 3, 2024", "Dr. Kumar Rao, John  Roe PhD; NASA committee", "Acme Corp. Acme Corp. ACME CORP."]
    texts += [(7, t) for t in odd] + [(None, t) for t in odd] + [(-1, None), (-2, ""), (-3, "a b\u00a0" * 3000 + "Inc")]
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, row string").repartition(4)
    want = sorted(map(repr, map(tuple, ner.extract(df).collect())))
    assert sorted(map(repr, map(tuple, ner.extract_by_rows(df).collect()))) == want and len(want) > 20000
    assert ner.extract_by_rows(df.limit(0)).collect() == []


def test_organisations_in_runs():
    regex = re.compile(ner.pattern("org_with_suffix"), re.I | re.M)
    for text in ("The Acme Widgets Inc. and Foo\nUniversity, or a b c. none here at all", "x" * 50 + " college, corp. 7 Bar Ltd.", "Inc. LLC"):
        assert [m.span() for m in ner._found("org_with_suffix", regex, text)] == [m.span() for m in regex.finditer(text)]


def test_every_pattern_matches_as_row_by_row(spark):
    texts = duckdb.connect().execute(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall()
    texts += [(-1, "ÉCODE AB12-x ISO standard, NASA Committee; IEEE organization. Dr. Ann B. Lee, Sem IV, Clause 4.5.1, 12/3/2024, 3.5 credits, 7%, John Roe PhD, $1,200.50, https://x.org/a?b=c, Jan. 3, 2024"), (-2, ""), (-3, None)]
    df = spark.createDataFrame(texts, "id long, text string").repartition(8)
    found = df.select("id", *(ner.matches(F.col("text"), ner.pattern(p[0]), ner.NEEDED.get(p[0])).alias(p[0]) for p in ner.PATTERNS)).collect()
    got = {(r.id, p[0]): r[p[0]] or [] for r in found for p in ner.PATTERNS}
    for name, *_, regex in ner.PATTERNS:
        made = re.compile(regex, re.I | re.M)
        for i, t in texts:
            assert got[i, name] == [m.group(0) for m in made.finditer(t or "")], (i, name)


def test_merge_entities(spark):
    rows = [(1, "e1", "course", "DSP", [], {"code": "X1"}, 0, "", 0.7), (2, "e2", "course", "dsp", ["Signals"], {"code": "X2", "credits": "4"}, 3, "Semester I", 0.9), (3, "e3", "org", "IEEE", [], {}, 1, "", 0.4)]
    df = spark.createDataFrame(rows, "ord int, id string, type string, canonical_name string, aliases array<string>, attributes map<string,string>, page int, scope string, confidence double")
    (r,) = store.merge(df).collect()
    assert (r.id, r.type, r.canonical_name, r.page, r.scope, r.confidence, r.attributes) == ("e1", "course", "DSP", 3, "Semester I", 0.9, {"code": "X2", "credits": "4"})
    assert "Signals" in r.aliases


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    new = spark.createDataFrame([(2, "x", 0), (2, "c", 1), (3, "d", 2)], "id int, v string, ord int")
    once = store.upsert(old, new)
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")] == sorted(map(tuple, store.upsert(once, new).collect()))


def test_table_regions_and_headers(spark):
    row = spark.range(1).select(tables.headers(F.create_map(F.lit(0), F.lit("Course Code"), F.lit(2), F.lit("Credits")), F.lit(3)).alias("h"), tables.header_key(F.lit(" Course  Code ")).alias("k")).first()
    assert row.h == ["Course Code", "Column_1", "Credits"] and row.k == "course_code"


def test_filters_before_the_limit(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0], "en"), (2, [0.0, 1.0, 0.0], "en"), (3, [0.6, 0.8, 0.0], "de")], "id int, embedding array<float>, language string")
    assert [(r.id, r.score) for r in vector.top_k(df, [1.0, 0.0, 0.0], 5, None, 0.5).collect()] == [(1, 1.0), (3, 0.6)]
    assert [r.id for r in vector.top_k(df, [1.0, 0.0, 0.0], 1, vector.payload_filter(language="de")).collect()] == [3]
    with pytest.raises(ValueError):
        vector.key_value_filter("nothing", ["a"])


def test_queries_beyond_one_block(spark, monkeypatch):
    p = spark.createDataFrame([(i, [float(i % 7), float(i % 3)]) for i in range(30)], "id int, embedding array<float>")
    q = p.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    monkeypatch.setattr(vector, "MOST_QUERIES", 7)
    got = {(r.query_id, r.rank): (r.id, r.score) for r in vector.top_k_per_query(p, q, 2).collect()}
    want = {}
    for a in range(30):
        score = {b: float((a % 7) * (b % 7) + (a % 3) * (b % 3)) for b in range(30)}
        for rank, b in enumerate(sorted(score, key=lambda b: (-score[b], b))[:2], 1):
            want[a, rank] = (b, score[b])
    assert got == want


def test_title_case(spark):
    assert spark.createDataFrame([("dr.john  o'neil x-ray",)], "t string").select(T.title_case(F.col("t"))).first()[0] == "Dr.John O'Neil X-Ray"


def test_docx(spark):
    import io
    import zipfile

    from loomdoc.sources.docx import docx_elements

    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Part</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text.</w:t></w:r></w:p></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
    rows = docx_elements(spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(b"no zip")), ("c", None)], "doc_id string, content binary")).collect()
    assert [(r.text, r.category, r.level) for r in rows if r.doc_id == "a"] == [("Part", "Title", 2), ("Some text.", "NarrativeText", 1)]
    assert all(r.error for r in rows if r.doc_id != "a")


def test_collections(spark, tmp_path):
    c = Collections(spark, f"file://{tmp_path}/c")
    assert c.names() == [] and not c.exists("a")
    rows = [("1", "x/y z", "t", [1.0, 0.0]), ("2", "x/y z", "t", [0.0, 1.0]), ("3", "b", None, [0.0, 1.0]), (None, "b", "t", [0.0, 1.0]), ("4", None, "t", [0.0, 1.0])]
    points = spark.createDataFrame(rows, "id string, source_id string, text string, embedding array<double>")
    assert c.create("a", points.schema, 2) and not c.create("a", points.schema, 2) and c.names() == ["a"]
    assert c.read("a").count() == 0 and c.info("a").first().points_count == 0
    for _ in range(2):
        c.upsert("a", points)
        assert sorted(r.id for r in c.read("a").collect()) == ["1", "2", "3"]
    c.replace_sources("a", points.where("id = 2"))
    assert sorted(r.id for r in c.read("a").collect()) == ["2", "3"]
    assert c.delete_source("a", "x/y z") == 1 and c.delete_source("a", "none") == 0 and [r.id for r in c.read("a").collect()] == ["3"]
    with pytest.raises(Exception, match="has 2 values, not 1"):
        c.upsert("a", spark.createDataFrame([("9", "b", "t", [1.0])], points.schema))
    assert c.create("a", points.schema, 2, recreate=True) and c.read("a").count() == 0
    with pytest.raises(ValueError, match="no collection"):
        c.read("b")


def test_title_characters_are_counted(spark, tmp_path):
    spark.createDataFrame([(1, "<title> A &amp; B </title><p>x"), (2, "<title>Long<br> title</title>")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.doc_id: (r.n, r.chars, r.digest) for r in registry.QUERIES["html_titles"](spark, str(tmp_path)).collect()}
    assert got == {i: (1, len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in ((1, "A & B"), (2, "Long title"))}


def test_pages_of_more_than_a_million_elements(spark):
    pages = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr("repeat('<p>a', 1000003)").alias("html")).unionByName(spark.createDataFrame([(2, "none"), (3, None), (4, "")], "doc_id int, html string"))
    assert [tuple(r) for r in readers.html_elements(pages).groupBy("doc_id").agg(F.count("*"), F.max("pos")).collect()] == [(1, 1000003, 1000002)]


def test_layout_of_empty_and_null_elements(spark):
    rows = [(1, 0, 1, None, None, None), (1, 1, 1, " ", 20.0, True), (1, 2, 1, "Some words", None, None), (1, 3, 1, "PART I", 11.0, False), (1, 4, 2, "More words", None, None)]
    got = layout.nodes(spark.createDataFrame(rows, "doc_id int, pos int, page int, text string, font_size double, bold boolean")).orderBy("pos").collect()
    assert [(r.pos, r.type, r.level, r.scope, r.parent) for r in got] == [(2, "paragraph", 1, "", None), (3, "section", 1, "PART I", None), (4, "paragraph", 2, "PART I", 3)]


@pytest.mark.parametrize("n", [1, 70, 1000])
def test_depth_of_a_chain(spark, n):
    nodes = spark.createDataFrame([(i, i - 1 if i else None) for i in range(n)] + [(5000, 5001), (5001, 5000), (6000, 7000)], "id long, parent long")
    got = {r.id: (r.depth, r.path) for r in tree.depths(nodes).collect()}
    assert got == {i: (i, "/".join(map(str, range(i + 1)))) for i in range(n)}


def test_parents_at_any_level(spark):
    levels = [1, 2, 3, 4, 5, 6, 4, None, 1, 3, 2, 9, None]
    nodes = spark.createDataFrame([(1, i, x, x is not None) for i, x in enumerate(levels)], "doc_id long, pos long, level int, header boolean")
    want, stack = {}, []
    for i, x in enumerate(levels):
        while x is not None and stack and stack[-1][0] >= x:
            stack.pop()
        want[i] = stack[-1][1] if stack else None
        if x is not None:
            stack.append((x, i))
    assert {r.pos: r.parent for r in tree.parents(nodes).collect()} == want


def test_search_of_odd_vectors(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 0.0])], "id long, embedding array<double>")
    q = p.select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    assert sorted((r.query_id, r.rank, r.id) for r in vector.top_k_per_query(p, q, 5).collect()) == [(1, 1, 1), (1, 2, 6), (6, 1, 1), (6, 2, 6)]
    assert vector.top_k_per_query(p, q.where("false"), 5).count() == 0 and vector.top_k_per_query(p.where("false"), q, 5).count() == 0


def test_files_by_their_suffix(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.txt").write_bytes(b"one\n\ntwo \xff")
    (tmp_path / "in" / "b.HTML").write_text("skipped: the suffix is matched as it stands")
    (tmp_path / "in" / "c.html").write_text("<title>T</title><p>x &amp; y</p>")
    (tmp_path / "d.docx").write_bytes(b"no archive")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "f.png").write_bytes(b"x")
    rows = readers.file_elements(spark, f"file://{tmp_path}").collect()
    got = sorted((r.doc_id.rsplit("/", 1)[1], r.pos, r.text, r.category, bool(r.error)) for r in rows)
    assert got == [("a.txt", 0, "one", "NarrativeText", False), ("a.txt", 1, "two \ufffd", "NarrativeText", False), ("c.html", 0, "T", "Title", False), ("c.html", 1, "x & y", "NarrativeText", False), ("d.docx", 0, None, None, True), ("e.pdf", 0, None, None, True)]
    assert readers.outcome(readers.report(readers.file_elements(spark, f"file://{tmp_path}"))).first().asDict() == {"total": 4, "succeeded": 2, "failed": 2}
    assert readers.document(spark, f"file://{tmp_path}/a.txt").count() == 2
    with pytest.raises(ValueError):
        readers.document(spark, f"file://{tmp_path}/f.png")
