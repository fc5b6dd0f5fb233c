"""Prefix trie of conversations from mergeable partial tries.

A node is a distinct sequence of first turns; its members are the conversations that begin with it. Nodes are named by 128 bits: the XOR of a
hash of (role, text, place) for each turn, so that a prefix's name is the XOR of its pieces' names, wherever these were made.

1. Turns are dealt by ranges of (conv_id, turn), not by conversation, and numbered within their range; a conversation that spans ranges gets the
   number of its rows in earlier ones. No task holds a whole conversation because of its id.
2. Conversations are rebuilt (first turns of another one, then their own); each range's names are combined with those of the ranges before.
3. Each partition emits a locally combined table of nodes (a partial trie: members counted, least member). Tables are merged by node in rounds of
   `fan` tables, by hash, which sum the members. End lists are rows of (node, conversation), not arrays: a node where a third of all
   conversations end is as wide as any other.
4. Leaves and bytes are rolled up by doubling: in round k each node gives the sum over its descendants less than 2 ** k below it to its ancestor 2 ** k
   above, so that a trie of depth D takes log2(D) rounds.

Order: by turn (null first), then role and text; rows that are equal in all of these are interchangeable. A null role or text is empty. Rows without
conv_id belong to no conversation and are left out. A repeated row is one more turn. Long texts are hashed whole. An empty table gives no rows. Other columns of the
input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written
from .kernels import arrow_rows, lean

NODE = ["k1", "k2"]
NOTHING = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Config:
    #: Conversation c begins with the first turns of c - c % group, crc32(c) % most of them. With group 1 conversations stay as they are.
    group: int = 5
    most: int = 9
    #: Partial tries that one merge puts together at most, and rows that a partial trie is made of at most.
    fan: int = 64
    rows: int = 200_000
    #: Bytes of a piece of a list of ids on its way to the digest.
    piece: int = 1 << 20


def _numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, idx, e1, e2, bytes of each turn, written; idx counts up within a partition, whose number is in its upper bits."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    # the driver draws a sample of what ranges are made of, so that long texts only give their first letters
    dealt = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.left("role", F.lit(16)), F.left("text", F.lit(16)))
    in_order = dealt.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return written(in_order.select("conv_id", F.monotonically_increasing_id().alias("idx"), F.xxhash64(F.lit(1), "role", "text").alias("e1"), F.xxhash64(F.lit(2), "text", "role").alias("e2"), F.octet_length("text").cast("long").alias("bytes")), "turns")


def _pieces(turns: DataFrame) -> DataFrame:
    """A row for each conversation and range: its first idx there, the rows of the conversation before it and in all."""
    by = Window.partitionBy("conv_id").orderBy("seg")
    found = turns.groupBy("conv_id", F.shiftright("idx", 33).alias("seg")).agg(F.min("idx").alias("first"), F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return written(found.select("conv_id", "seg", "first", before.alias("before"), F.sum("rows").over(Window.partitionBy("conv_id")).alias("len")), "pieces")


def _plans(pieces: DataFrame, cfg: Config) -> DataFrame:
    """How each conversation is rebuilt: the first `kept` turns of `base`, then its own without the first `cut`; `total` turns in all."""
    convs = pieces.where("before = 0").select("conv_id", "len")
    off = F.col("conv_id") % cfg.group
    cut = F.when(off == 0, 0).otherwise(F.crc32(F.col("conv_id").cast("string")) % cfg.most).cast("long")
    both = convs.select("conv_id", "len", (F.col("conv_id") - off).alias("base"), cut.alias("cut")).join(convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len")), "base", "left")
    kept = F.least("cut", F.coalesce("base_len", F.lit(0)))
    return written(both.select("conv_id", "base", "cut", kept.alias("kept"), (kept + F.greatest(F.col("len") - F.col("cut"), F.lit(0))).alias("total")), "plans")


def _rebuilt(turns: DataFrame, pieces: DataFrame, plans: DataFrame, cfg: Config) -> DataFrame:
    """conv_id, seg, pos (from 1), total, f1, f2, bytes of each rebuilt turn; the turns of another conversation have seg -1."""
    at = pieces.join(plans, "conv_id").select("conv_id", "seg", "first", "before", "cut", "kept", "total")
    place = F.col("idx") - F.col("first") + F.col("before") - F.col("cut") + F.col("kept") + 1
    own = turns.withColumn("seg", F.shiftright("idx", 33)).join(at, ["conv_id", "seg"]).withColumn("pos", place).where(F.col("pos") > F.col("kept"))
    own = own.select("conv_id", "seg", "pos", "total", F.xxhash64(F.lit(3), "pos", "e1", "e2").alias("f1"), F.xxhash64(F.lit(4), "e2", "e1", "pos").alias("f2"), "bytes")
    heads = own.where((F.col("conv_id") % cfg.group == 0) & (F.col("pos") < cfg.most)).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("pos", "f1", "f2", "bytes")).alias("head"))
    taken = plans.where("kept > 0").join(heads, "base").select("conv_id", "total", "kept", F.explode("head").alias("t")).where("t.pos <= kept")
    return own.unionByName(taken.select("conv_id", F.lit(-1).cast("long").alias("seg"), "t.pos", "total", "t.f1", "t.f2", "t.bytes"))


def _named(rebuilt: DataFrame) -> DataFrame:
    """conv_id, depth, ends, bytes and the names k1, k2 of the prefix, p1, p2 of its parent, for each rebuilt turn."""
    so_far = Window.partitionBy("conv_id", "seg").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = written(rebuilt.withColumns({"x1": F.bit_xor("f1").over(so_far), "x2": F.bit_xor("f2").over(so_far)}), "local")
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = local.groupBy("conv_id", "seg").agg(F.bit_xor("f1").alias("s1"), F.bit_xor("f2").alias("s2"))
    carried = whole.select("conv_id", "seg", *(F.coalesce(F.bit_xor(f"s{i}").over(earlier), F.lit(0)).alias(f"c{i}") for i in (1, 2)))
    key = lambda i: F.col(f"x{i}").bitwiseXOR(F.col(f"c{i}"))
    rows = local.join(carried, ["conv_id", "seg"])
    out = written(rows.select("conv_id", F.col("pos").alias("depth"), (F.col("pos") == F.col("total")).alias("ends"), "bytes", key(1).alias("k1"), key(2).alias("k2"), key(1).bitwiseXOR(F.col("f1")).alias("p1"), key(2).bitwiseXOR(F.col("f2")).alias("p2")), "named")
    dropped(local)
    return out


TABLE = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("depth", pa.int64()), ("bytes", pa.int64()), ("n_convs", pa.int64()), ("conv_id", pa.int64()), ("slot", pa.int64())])


def _partial(cfg: Config):
    """mapInArrow function: named turns to the node tables of this partition, one for each cfg.rows of them."""
    same = ["k1", "k2", "p1", "p2", "depth", "bytes"]

    def combined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        found = pa.Table.from_batches(held).group_by(same).aggregate([("conv_id", "count"), ("conv_id", "min")])
        columns = [*(found.column(c) for c in same), found.column("conv_id_count"), found.column("conv_id_min")]
        return arrow_rows(TABLE, [*(c.combine_chunks() for c in columns), pa.repeat(TaskContext.get().partitionId(), found.num_rows).cast(pa.int64())])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= cfg.rows:
                yield combined(held)
                held, n = [], 0
        if n:
            yield combined(held)

    return lean(run)


def _merged(partial: DataFrame, by: list) -> DataFrame:
    first = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "bytes")]  # the same wherever a node was met
    return partial.groupBy(*by).agg(*first, F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))


def tries(named: DataFrame, cfg: Config) -> DataFrame:
    """k1, k2, p1, p2, depth, bytes, n_convs, conv_id (least member) of each node but the root: partial tries, merged in rounds."""
    partial = written(named.select("k1", "k2", "p1", "p2", "depth", "bytes", "conv_id").mapInArrow(_partial(cfg), "k1 long, k2 long, p1 long, p2 long, depth long, bytes long, n_convs long, conv_id long, slot long"), "partial")
    tables, merged = partial.agg(F.coalesce(F.max("slot"), F.lit(0))).first()[0] + 1, partial
    while tables > cfg.fan:
        merged = _merged(merged, [*NODE, F.floor(F.col("slot") / cfg.fan).alias("slot")])
        tables = -(-tables // cfg.fan)
    out = written(_merged(merged, NODE), "nodes")
    dropped(partial)
    return out


def rolled_up(nodes: DataFrame) -> DataFrame:
    """nodes, the root included, with n_children, n_leaves and saved_tokens (of a subtree, its top included)."""
    children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    full = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    state = written(full.select("*", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved_tokens"), F.col("p1").alias("a1"), F.col("p2").alias("a2")), "rollup")
    deepest = state.agg(F.coalesce(F.max("depth"), F.lit(0))).first()[0]
    reach = 1  # a1, a2: the ancestor that stands this much above
    while reach <= deepest:
        given = state.where("a1 is not null").groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = state.where("a1 is not null").select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        kept = ["k1", "k2", "p1", "p2", "depth", "bytes", "n_convs", "conv_id", "n_children"]
        sums = [(F.col(c) + F.coalesce(m, F.lit(0))).alias(c) for c, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        new = state.join(given, NODE, "left").join(above, ["a1", "a2"], "left").select(*kept, *sums, F.col("b1").alias("a1"), F.col("b2").alias("a2"))
        old, state = state, written(new, "rollup")
        dropped(old)
        reach *= 2
    return state


def _by_node(fold, schema: pa.Schema):
    """mapInArrow function over (k1, k2, at, ids) in order: what fold, a generator, makes of the rows of each node."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "at", "ids"))))
        out = []
        for node, of_node in itertools.groupby(rows, lambda r: r[:2]):
            for made in fold(of_node):
                out.append((*node, *made))
                if len(out) == 1000:
                    yield arrow_rows(schema, list(zip(*out)))
                    out = []
        if out:
            yield arrow_rows(schema, list(zip(*out)))

    return lean(run)


def digests(ends: DataFrame, cfg: Config) -> DataFrame:
    """k1, k2, sha of ends (k1, k2, conv_id): the digest of each node's ids in ascending order.

    Ids are dealt by ranges of (node, id), so that many tasks put the list of one node to text. A digest takes one byte after the other by its nature: the pieces of
    a node are streamed through one task, one of them in memory at a time.
    """

    def pieces(rows):
        at, held, size = None, [], 0
        for _, _, i, text in rows:
            at = i if at is None else at
            held.append(text)
            size += len(text) + 1
            if size >= cfg.piece:
                yield at, ",".join(held)
                at, held, size = None, [], 0
        if held:
            yield at, ",".join(held)

    def digest(rows):
        made = hashlib.sha256()
        for n, (*_, text) in enumerate(rows):
            made.update(("," * (n > 0) + text).encode())
        yield (made.hexdigest(),)

    key = [("k1", pa.int64()), ("k2", pa.int64())]
    rows = ends.select("k1", "k2", F.col("conv_id").alias("at"), F.col("conv_id").cast("string").alias("ids")).repartitionByRange("k1", "k2", "at").sortWithinPartitions("k1", "k2", "at")
    lists = rows.mapInArrow(_by_node(pieces, pa.schema([*key, ("at", pa.int64()), ("ids", pa.string())])), "k1 long, k2 long, at long, ids string")
    return lists.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "at").mapInArrow(_by_node(digest, pa.schema([*key, ("sha", pa.string())])), "k1 long, k2 long, sha string")


@dataclass(frozen=True)
class Trie:
    #: k1, k2 (name), p1, p2 (parent's), conv_id, depth, bytes (of the last text), n_convs, n_children, n_leaves, saved_tokens
    nodes: DataFrame
    #: k1, k2, conv_id: where each conversation ends
    ends: DataFrame


def prefix_trie(conversations: DataFrame, cfg: Config = Config()) -> Trie:
    """The trie of conversations (conv_id, turn, role, text), rebuilt as cfg says."""
    turns = _numbered(conversations)
    pieces = _pieces(turns)
    plans = _plans(pieces, cfg)
    named = _named(_rebuilt(turns, pieces, plans, cfg))
    zero = F.lit(0).cast("long")
    none: Column = F.lit(None).cast("long")
    root = plans.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0").select(zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"), zero.alias("depth"), zero.alias("bytes"), "n_convs", "conv_id")
    found = tries(named, cfg)
    ends = named.where("ends").select("k1", "k2", "conv_id").unionByName(plans.where("total = 0").select(zero.alias("k1"), zero.alias("k2"), "conv_id"))
    ends = written(ends, "ends")
    nodes = rolled_up(found.unionByName(root))
    dropped(turns, pieces, plans, named, found)
    return Trie(nodes.drop("a1", "a2"), ends)


def report(conversations: DataFrame, cfg: Config = Config()) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    trie = prefix_trie(conversations, cfg)
    parents = trie.nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    rows = trie.nodes.join(parents, ["p1", "p2"], "left").join(digests(trie.ends, cfg), NODE, "left")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(NOTHING)).alias("ends_sha256"))


def oracle(group: int = 5, most: int = 9) -> str:
    """report() in DuckDB: every prefix by the digest of its turns' digests."""
    bit = "list_reduce(list_prepend({}, list_transform(range(8), lambda i: i::BIGINT)), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda a, b: " + bit.format("xor(a, b)") + "), 4294967295)"
    return f"""
WITH t AS MATERIALIZED (SELECT conv_id, octet_length(encode(coalesce(text, ''))) AS bytes, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS turn_sha,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS j FROM conversations WHERE conv_id IS NOT NULL
), c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % {group} AS base, CASE WHEN conv_id % {group} = 0 THEN 0 ELSE {crc} % {most} END AS h, n FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)
), p AS MATERIALIZED (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base
), full_rows AS (SELECT p.conv_id, j + 1 AS pos, turn_sha, bytes FROM p JOIN t ON t.conv_id = p.base AND t.j < p.m
  UNION ALL SELECT p.conv_id, j - h + m + 1, turn_sha, bytes FROM p JOIN t ON t.conv_id = p.conv_id AND t.j >= p.h
), path AS MATERIALIZED (SELECT conv_id, pos AS depth, bytes, sha256(string_agg(turn_sha, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS k FROM full_rows
  UNION ALL SELECT conv_id, 0, 0, '' FROM p
), node AS MATERIALIZED (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes FROM path GROUP BY depth, k
), up AS MATERIALIZED (SELECT n.depth, n.k, q.k AS parent, r.conv_id AS parent_conv_id FROM node n JOIN path q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1 JOIN node r ON r.depth = q.depth AND r.k = q.k
), children AS (SELECT depth - 1 AS depth, parent AS k, count(*) AS n FROM up GROUP BY ALL
), sized AS (SELECT node.*, coalesce(children.n, 0) AS n_children FROM node LEFT JOIN children USING (depth, k)
), sums AS (SELECT a.depth, a.k, sum((v.n_children = 0)::INT) AS n_leaves, sum((v.n_convs - 1) * v.bytes) AS saved FROM sized v JOIN path a ON a.conv_id = v.conv_id AND a.depth <= v.depth GROUP BY ALL
), last AS (SELECT conv_id, arg_max(k, depth) AS k, max(depth) AS depth FROM path GROUP BY conv_id
), ends AS (SELECT depth, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM last GROUP BY ALL)
SELECT s.conv_id, s.depth::BIGINT AS depth, up.parent_conv_id, s.n_convs, s.n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM sized s JOIN sums USING (depth, k) LEFT JOIN up USING (depth, k) LEFT JOIN ends USING (depth, k)
"""
