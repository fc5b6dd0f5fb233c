from loomdoc.operators import table_entities, tables

SCHEMA = "doc_id long, page int, text string, x0 double, y0 double, x1 double, y1 double"


def cell(text, x, y, page=0, doc=1):
    return (doc, page, text, None if x is None else float(x), float(y), float((x or 0) + 50), float(y + 10))


PAGE = [
    *(cell(t, x, y) for t, x, y in (("A heading", 10, 0), ("Course \n Code", 10, 20), ("Course Title", 100, 21), ("Credits", 300, 22), ("Credits", 400, 20))),
    *(cell(t, x, y) for t, x, y in (("U18ECT3101", 10, 40), (" Digital  Signal ", 100, 41), ("Processing", 105, 40), ("4", 305, 47), ("x", 400, 40))),
    *(cell(t, x, y) for t, x, y in (("U18ECT3102", 10, 60), ("HS 3 0 2 0", 100, 60), ("3", 300, 60))),
    *(cell(t, x, y) for t, x, y in (("U18ECT3103", 10, 80), ("5", 300, 80), ("6", 400, 80), ("a closing note", 10, 100))),
]


def test_one_page(spark):
    (t,) = tables.extract(spark.createDataFrame(PAGE, SCHEMA)).collect()
    assert (t.table_index, t.headers, t.first, t.scope) == (0, ["Course Code", "Course Title", "Credits", "Credits"], 1, "")
    rows = [{c.header: c.value for c in row} for row in t.rows]
    assert rows[0] == {"Course Code": "U18ECT3101", "Course Title": "Digital  Signal Processing", "Credits": "x"}  # the last of two columns of one name
    assert [r["Credits"] for r in rows] == ["x", "", "6"]
    assert tuple(t.bbox) == (10.0, 20.0, 450.0, 90.0) and t.raw_text.splitlines()[-1] == "U18ECT3103 | 5 | 6"


def test_entities_of_a_page(spark):
    found = table_entities.tables_to_entities(tables.extract(spark.createDataFrame(PAGE, SCHEMA))).orderBy("row_index").collect()
    assert [(r.canonical_name, r.attributes) for r in found] == [("Digital Signal Processing", {"code": "U18ECT3101", "course_title": "Digital  Signal Processing", "credits": "x"}), ("U18ECT3103", {"code": "U18ECT3103", "credits": "6"})]


def test_scope_and_numbers_of_tables(spark):
    """Two tables of a page; the first has one column only, and keeps its number."""
    one = [cell("ABCDE1", 10, 0), cell("1", 12, 2), cell("ABCDE2", 10, 20), cell("2", 12, 22), cell("note", 10, 40)]
    two = [cell("ABCDE3", 10, 60), cell("3", 100, 60), cell("ABCDE4", 10, 80), cell("4", 100, 80)]
    df = spark.createDataFrame([(*c, "Semester II") for c in one + two], SCHEMA + ", part string")
    (t,) = tables.extract(df, scope="part").collect()
    assert (t.table_index, t.scope, t.headers, len(t.rows)) == (1, "Semester II", ["Column_0", "Column_1"], 2)


def test_nulls_repeats_extra_columns_and_nothing(spark):
    df = spark.createDataFrame(PAGE, SCHEMA)
    want = tables.extract(df).collect()
    bad = spark.createDataFrame([cell(None, 10, 40), cell("lost", None, 40), cell(" \n ", 10, 40)], SCHEMA)
    clash = ("lines", "run", "laid", "cells", "cell", "headers", "rows", "scope", "first")
    more = df.unionByName(bad)
    for c in clash:
        more = more.selectExpr("*", f"'z' AS {c}")
    assert tables.extract(more).collect() == want
    (twice,) = tables.extract(df.unionByName(df)).collect()
    assert [c.value for c in twice.rows[0]][0] == "U18ECT3101 U18ECT3101" and twice.bbox == want[0].bbox
    nowhere = tables.extract(df.selectExpr("cast(null AS long) AS doc_id", "cast(null AS int) AS page", "text", "x0", "y0", "x1", "y1")).collect()
    assert [t.raw_text for t in nowhere] == [want[0].raw_text]
    assert tables.extract(df.limit(0)).collect() == [] and table_entities.table_rows(df.limit(0)).collect() == []


def test_long_page(spark):
    size = 400
    rows = [c for i in range(size) for c in (cell(f"ABCD{i}", 10, 20 * i), cell(f"name number {i}", 100, 20 * i), cell(str(i), 300, 20 * i))]
    (t,) = tables.extract(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [[c.value for c in r] for r in t.rows] == [[f"ABCD{i}", f"name number {i}", str(i)] for i in range(size)]
