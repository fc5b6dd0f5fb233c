"""The preorder walk against a plain one, and over a long chain and a wide star."""

import random

from pyspark.sql import functions as F

from loomdoc.operators import tree

SCHEMA = "id long, parent long, pos int, size string, root int"


def walked(rows):
    children = {}
    for i, parent, pos, *_ in rows:
        children.setdefault(parent, []).append((pos, i))
    out = []
    for _, root in children.get(None, []):
        stack, seen = [(root, 0)], []
        while stack:
            i, depth = stack.pop()
            seen.append((i, depth))
            stack += [(c, depth + 1) for _, c in sorted(children.get(i, []), reverse=True)]
        for place, (i, depth) in enumerate(seen):
            size = next((k for k, (_, d) in enumerate(seen[place + 1 :], 1) if d <= depth), len(seen) - place)
            out.append((i, root, place, depth, size))
    return sorted(out)


def test_preorder(spark):
    r = random.Random(6)
    rows = [(i, r.choice([None, *range(max(0, i - 5), i)]) if i else None, r.randint(0, 3)) for i in range(300)]
    rows += [(1000, 1001, 0), (1001, 1000, 0), (1002, 1001, 0), (1003, 999, 0), (1004, 1003, 0)]  # a cycle, and a parent that is missing
    rows = [(*x, "clash", 1) for x in rows]
    r.shuffle(rows)
    assert sorted(map(tuple, tree.preorder(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())) == walked(rows)
    assert tree.preorder(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_and_star(spark):
    n = 20_000
    i = F.col("id")
    chain = spark.range(n).select(i, F.when(i > 0, i - 1).alias("parent"), F.lit(0).alias("pos"))
    assert tree.preorder(chain).where((F.col("place") != i) | (F.col("depth") != i) | (F.col("size") != n - i) | (F.col("root") != 0)).count() == 0
    star = spark.range(200_000).select(i, F.when(i > 0, 0).cast("long").alias("parent"), (-i).alias("pos"))
    found = tree.preorder(star)
    assert found.count() == 200_000 and found.where((i > 0) & ((F.col("place") != 200_000 - i) | (F.col("size") != 1))).count() == 0
