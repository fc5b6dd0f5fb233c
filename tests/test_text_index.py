"""The trigram index against containment row by row."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loomdoc.operators import retrieval, store, text_index
from loomdoc.plans import registry

SCHEMA = "id long, canonical_name string, aliases array<string>, attributes map<string,string>, confidence double, gram string, texts string, type string, scope string"


def rows():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abAB é") for _ in range(r.randint(0, 8)))
    out = [(i, word() or None, r.choice([None, [], [word(), None], [word(), word()]]), r.choice([None, {}, {word(): word()}, {"k": None}]), float(i % 5), "g", "t", "course", f"Semester {i % 7}") for i in range(300)]
    return [*out, (300, "x" * 30_000 + "abab", None, None, 1.0, "g", "t", "part", None), (301, None, None, None, None, "g", "t", "part", "")]


def texts_of(row):
    return [t.lower() for t in [row[1], *(row[2] or []), *(row[3] or {}), *(row[3] or {}).values()] if t]


@pytest.mark.parametrize("most", [text_index.BROADCAST_GRAMS, 0])
def test_containing(spark, monkeypatch, most):
    monkeypatch.setattr(text_index, "BROADCAST_GRAMS", most)
    terms = ["ab", "a", "é", "aba", "ABAB", "b a", "abab", "zzz", "abé", "", None, "x" * 40, "aaaa", "ab"]
    df = spark.createDataFrame(rows(), SCHEMA).repartition(3)
    got = text_index.containing(text_index.entity_texts(df), spark.createDataFrame([(t,) for t in terms], "term string"))
    want = {(t, row[0]) for t in terms if t is not None for row in rows() if any(t.lower() in x for x in texts_of(row))}
    found = list(map(tuple, got.collect()))
    assert len(found) == len(set(found)) and set(found) == want


def test_nothing_to_look_for_or_in(spark):
    none, df = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows(), SCHEMA)
    terms = spark.createDataFrame([("abab",), ("",), ("a",)], "term string")
    assert text_index.containing(text_index.entity_texts(none), terms).count() == 0
    assert text_index.containing(text_index.entity_texts(df), terms.where("term is null")).count() == 0


@pytest.mark.parametrize("query", ["aba", "B AB", "abab", "qqq", "xxxxxxxx"])
def test_saved_index(spark, tmp_path, query):
    df = spark.createDataFrame(rows(), SCHEMA)
    text_index.save(text_index.postings(text_index.entity_texts(df)), f"{tmp_path}/index")
    got = text_index.search(spark, df, f"{tmp_path}/index", query, 7)
    assert [r.id for r in got.collect()] == [r.id for r in store.search(df, query, limit=7).collect()]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "formatted")
    assert re.search(r"PushedFilters: \[.*(In|EqualTo)\(gram", plan)
    with pytest.raises(ValueError, match="3 characters"):
        text_index.search(spark, df, f"{tmp_path}/index", "ab")


def test_no_nested_loop_in_retrieval(spark):
    df = registry.QUERIES["entity_context"](spark, "/root/testdata/sf0.001")
    df.collect()
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_hits_of_listings_and_terms(spark):
    df = spark.createDataFrame(rows(), SCHEMA)
    queries = [(1, "list all courses of semester 3"), (2, "list everything"), (3, "abab"), (4, None), (5, ""), (6, "what is zzzz")]
    hits = retrieval.entity_hits(spark.createDataFrame(queries, "query_id int, query string"), df).select("query_id", "rank", "id", "confidence").orderBy("query_id", "rank").collect()
    first = lambda ids, n: [x[0] for x in sorted(((i, c) for i, c in ids), key=lambda x: (-x[1], x[0]))[:n]]
    by = lambda q: [r.id for r in hits if r.query_id == q]
    courses = [(x[0], x[4], x[8]) for x in rows() if x[7] == "course"]
    assert by(1) == first([(i, c) for i, c, s in courses if "semester 3" in s.lower()], 20)
    assert by(2) == first([(i, c) for i, c, _ in courses], 20)
    assert by(3) == first([(x[0], x[4]) for x in rows() if any("abab" in t for t in texts_of(x))], 6)
    assert by(4) == by(5) == by(6) == []
