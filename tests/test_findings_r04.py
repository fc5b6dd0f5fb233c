"""What the fourth round's reviewer found."""

import random
import re

import pytest

from pyspark.sql import functions as F

from loomdoc.operators import tables, text_index
from loomdoc.plans import registry

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_lines_without_number_or_part_dont_count(spark, tmp_path):
    """As the SQL's arg_max has it; an order with no other lines has no part."""
    spark.createDataFrame([(1, 5), (9, 6)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(1, None, 7), (1, 20, 3), (1, 21, None), (1, 22, 3), (2, None, 1), (2, 30, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["relation_upsert"](spark, str(tmp_path)).collect()
    assert sorted((r.id, r.type, r.target_entity_id) for r in found) == [(1, "holds", 20), (2, "holds", None), (9, "ordered", 9)]


def test_what_documents_hold_is_counted_where_they_are_read(spark):
    """Nothing that has a document's id is shuffled: neither its words nor the terms in it."""
    df = registry.QUERIES["terms_in_documents"](spark, DATA)
    assert not re.search(r"\) (Exchange|BroadcastExchange)\nInput[^\n]*\b(id|word)#", plan_of(df))


@pytest.mark.parametrize("block, letters", [(1 << 18, 1 << 19), (3, 100)])
def test_terms_of_any_length_in_blocks(spark, monkeypatch, block, letters):
    monkeypatch.setattr(text_index, "BLOCK", block, raising=False)
    monkeypatch.setattr(text_index, "LETTERS", letters, raising=False)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abé\u00a0\U0001f600") for _ in range(r.randint(0, 9)))
    long = "".join(r.choice("ab") for _ in range(1_500))
    rows = [(i, [r.choice([" ", "\t", "\x0b\n"]).join(word() for _ in range(r.randint(0, 20))) for _ in range(r.randint(0, 3))]) for i in range(200)] + [(200, [None, long]), (201, None)]
    terms = {word().strip(" ") for _ in range(60)} | {long[190:254], long[1436:1500], long[255:263], "AB", "ab", "Ab"}
    # one row comes twice: each of its rows is found
    texts, asked = spark.createDataFrame([*rows, rows[7]], "id int, texts array<string>"), spark.createDataFrame([(t,) for t in terms], "term string")
    found = text_index.containing(texts, asked.where("term <> ''"))
    want = [(t, i) for i, x in [*rows, rows[7]] for t in terms if t and any(t.lower() in y for y in x or () if y)]
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_rows_of_a_page_are_folded_in_batches(spark):
    """Pages that end anywhere in a batch, and one of many batches, are as in one batch; nothing is collected by an aggregate, and the rule of codes is evaluated once."""
    cells = [(d, p, r.choice(["AB123", "Course Code", "Title", "7", "x y", " Credits\n"]), x, y, x + 9, y + 9) for r in [random.Random(5)] for d in ("a", "b", None) for p in (0, 1, None) for _ in range(r.choice([1, 7, 40])) for x, y in [(float(r.choice([5, 100, 200, 205])), r.randint(0, 60) * 1.0)]]
    df = spark.createDataFrame(cells, "doc_id string, page int, text string, x0 double, y0 double, x1 double, y1 double").withColumn("scope", F.concat(F.lit("s"), F.col("x0").cast("string")))
    conf, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    for size in ("10000", "3"):
        spark.conf.set(conf, size)
        found.append(sorted(map(str, tables.extract(df, scope="scope").collect())))
    spark.conf.unset(conf)
    least = {(c[0], c[1]): min(f"s{x[3]}" for x in cells if x[:2] == c[:2]) for c in cells}
    assert found[0] == found[1] and len(found[0]) == 3
    assert all(r.scope == least[r.doc_id, r.page] for r in tables.extract(df, scope="scope").collect())
    plan = plan_of(registry.QUERIES["table_entities"](spark, DATA))
    assert "ObjectHashAggregate" not in plan and plan.count("A-Z0-9]{4,15}") <= 3
