"""The trie of conversations against one built turn by turn."""

import collections
import hashlib
import random
import zlib

import pytest

from loomdoc.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, k1 long, depth string, seg long"


def table():
    r = random.Random(5)
    rows = []
    for c in [*range(60), 105, 107, 1003, -7, -5, -10]:
        if c in (20, 35):
            continue  # first conversations that are absent
        n = r.choice([1, 2, 3, 9, 12])
        for j in range(n):
            same = c % 3 == 0 and j < 6
            rows.append((c, j + 1, "user" if j % 2 == 0 else "assistant", f"common {j}" if same else f"own {c} {j} é"))
    rows += [(57, None, None, None), (57, None, "user", None), (58, 3, "user", "tie b"), (58, 3, "user", "tie a"), (None, 1, "user", "nobody"), (1003, 2, "user", "long " * 50_000)]
    rows += [rows[5], rows[5]]
    r.shuffle(rows)
    return [(*x, 1, "x", 2) for x in rows]


def built(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        off = c % 5 if c >= 0 else -(-c % 5)
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own if off == 0 else convs.get(c - off, [])[:h] + own[h:]
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = collections.defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in members.items())


@pytest.mark.parametrize("cfg", [prefixtrie.Config(), prefixtrie.Config(fan=2, rows=7, piece=3)])
def test_trie(spark, cfg):
    rows = table()
    got = prefixtrie.report(spark.createDataFrame(rows, SCHEMA).repartition(5), cfg)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect())) == built(rows)


def test_one_conversation_of_many_ranges(spark):
    rows = [(3, j, "user", f"t{j}", 1, "x", 2) for j in range(3000)] + [(5, j, "user", f"t{j}", 1, "x", 2) for j in range(2500)] + [(6, 0, "user", "a", 1, "x", 2)]
    df = spark.createDataFrame(rows, SCHEMA)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = sorted(map(tuple, prefixtrie.report(df).collect()))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == built(rows)


def test_no_conversations(spark):
    assert prefixtrie.report(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefixtrie.report(spark.createDataFrame([(None, 1, "user", "x", 1, "x", 2)], SCHEMA)).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 1, "user", "gone", 1, "x", 2), (c + 1000000 - c % 5, 1, "user", "stays", 1, "x", 2)]
    assert sorted(map(tuple, prefixtrie.report(spark.createDataFrame(rows, SCHEMA)).collect())) == built(rows)
