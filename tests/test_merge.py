"""Merged entities against a plain loop."""

import random

from pyspark.sql import functions as F

from loomdoc.operators import store

SCHEMA = "ord long, id string, source_id string, type string, canonical_name string, aliases array<string>, attributes map<string,string>, page int, scope string, confidence double, kind int, item string"


def merged(rows):
    out = {}
    for o, i, source, kind, name, aliases, attributes, page, scope, confidence, *_ in sorted(rows, key=lambda r: r[0]):
        e = out.setdefault((source, kind, name.lower()), {"id": i, "name": name, "aliases": set(), "attributes": {}, "page": 0, "scope": "", "confidence": confidence})
        e["aliases"] |= set(aliases or [])
        e["attributes"].update(attributes or {})
        e["page"] = e["page"] or page or 0
        e["scope"] = e["scope"] or scope or ""
        e["confidence"] = max(e["confidence"], confidence)
    return sorted(((s, e["id"], k, e["name"], sorted(a for a in e["aliases"] if a is not None and a != e["name"]), list(e["attributes"].items()), e["page"], e["scope"], e["confidence"]) for (s, k, _), e in out.items() if e["confidence"] >= 0.5), key=repr)


def test_merge_of_many(spark):
    r = random.Random(4)
    rows = [(o, f"e{o}", r.choice("st"), r.choice(["code", None]), r.choice(["Abc", "abc", "ABC", "x"]), r.choice([None, [], ["Abc", "a"], [r.choice("abc"), None]]), r.choice([None, {}, {r.choice("wxyz"): r.choice(["1", "2", None])}]), r.choice([None, 0, o]), r.choice([None, "", f"s{o}"]), r.choice([0.1, 0.6, 0.9]), 7, "clash") for o in range(400)]
    # as entries: a map on its way to Python loses its order
    got = store.merge(spark.createDataFrame(rows, SCHEMA).repartition(5), ["source_id"]).withColumn("attributes", F.map_entries("attributes")).collect()
    assert sorted(((x.source_id, x.id, x.type, x.canonical_name, x.aliases, list(map(tuple, x.attributes)), x.page, x.scope, x.confidence) for x in got), key=repr) == merged(rows)
    assert store.merge(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_name_with_very_many_rows(spark):
    n = 1_000_000
    i = F.col("id")
    df = spark.range(n).select(i.alias("ord"), i.cast("string").alias("id"), F.lit("s").alias("source_id"), F.lit("code").alias("type"), F.lit("one").alias("canonical_name"), F.array(F.concat(F.lit("a"), (i % 5).cast("string"))).alias("aliases"), F.create_map(F.concat(F.lit("k"), (i % 3).cast("string")), i.cast("string")).alias("attributes"), F.lit(0).alias("page"), F.lit("").alias("scope"), F.lit(0.9).alias("confidence"))
    (x,) = store.merge(df).collect()
    assert (x.id, x.aliases, dict(x.attributes)) == ("0", [f"a{j}" for j in range(5)], {f"k{j}": str(max(k for k in range(n - 3, n) if k % 3 == j)) for j in range(3)})
