"""Near-duplicate groups by MinHash with tensored banding.

Two small collections A and B hold `half_tables` half keys each, every half key made of `half_rows`
minhashes. A table's key is a pair (A_i, B_j), so half_tables ** 2 tables of 2 * half_rows minhashes come
from 2 * half_tables * half_rows minhash evaluations: about the square root of what plain banding takes.
With the defaults (12 and 3) 72 minhashes give 144 tables; a pair of similarity 0.8 meets in no table with
probability 2 * (1 - 0.8 ** 3) ** 12 = 3.7e-4, one of 0.9 with 4.7e-7.

1. Each text gives its set's size, a 128-bit digest of the set and the half keys. Rows with equal sets form
   a class; its least doc_id stands for it, so that copies are never expanded.
2. Representatives are dealt to tables. In every table each member is paired with the table's first member
   and with the member before it; candidates are confirmed on full sets and joined to components. A half key of more
   than `hot` representatives has its tables salted, so that no task takes a whole one; the salts' first members are
   paired in the same way.
3. What can still link two different components are pairs of one table whose members carry different labels. The
   documents of such tables are compared within their half keys of A, which covers all of these pairs, in blocks of
   bounded size that emit links only, so that no candidate is left out and no pairs are made. A table whose members
   are already one component, as of a large group of near copies, costs nothing more.

Sets are kept as 64-bit hashes of shingles (word hashes of whole texts), and similarity is tested in whole
numbers: 100 * intersection >= percent * union.

Nulls, empty texts and texts without words have no shingles and stay alone. A null doc_id is kept, alone.
Rows with the same doc_id count as one document when their texts are equal too; otherwise they are joined,
as they carry one id. Equal sets are a tie, which the least doc_id wins. Long texts are read whole. An empty table gives no rows. Extra columns of the input are
ignored, whatever their names; deduplicated() keeps them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written
from .graph import components
from .kernels import SPACED, Words, arrow_rows, lean, mix, slices, windows

#: A set of ids up to this size is broadcast (8 bytes each); a larger one is joined by shuffle.
BROADCAST_IDS = 2_000_000
#: A document in more candidate pairs than this is hot: its set is copied for each PARTNERS of them.
PARTNERS = 256


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 80
    half_tables: int = 12
    half_rows: int = 3
    seed: int = 20
    block: int = 1024
    block_shingles: int = 1_000_000
    hot: int = 50_000


def shingle_sets(raw, off, k: int):
    """(row, distinct hashes) of each row with a word; a text of fewer than k words is one shingle."""
    w = Words(raw, off, SPACED, lower=True)
    h = w.hashes()
    win = windows(h, k)
    for i in range(len(w.count)):
        a, n = w.first[i], w.count[i]
        if n >= k:
            yield i, np.unique(win[a : a + n - k + 1])
        elif n:
            yield i, windows(h[a : a + n], int(n))


def signatures(docs: DataFrame, cfg: Config) -> DataFrame:
    """doc_id, n, h1, h2 and the half keys a and b of each row."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("a", T.ArrayType(T.LongType(), False)), T.StructField("b", T.ArrayType(T.LongType(), False))])
    arrow = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64()))])

    def run(batches):
        m, r = cfg.half_tables, cfg.half_rows
        odd = np.random.default_rng(cfg.seed).integers(0, 1 << 64, 2 * m * r, dtype=np.uint64) | np.uint64(1)
        index = np.arange(2 * m, dtype=np.uint64)[:, None]
        for batch in batches:
            for rows, raw, off in slices(batch):
                n = np.zeros(rows.num_rows, np.int64)
                h1, h2 = np.zeros((2, rows.num_rows), np.uint64)
                keys = np.zeros((rows.num_rows, 2 * m), np.uint64)
                sets = list(shingle_sets(raw, off, cfg.words))
                if sets:
                    at = np.array([i for i, _ in sets])
                    n[at] = [len(s) for _, s in sets]
                    begin = np.concatenate([[0], np.cumsum(n[at])[:-1]])
                    flat = np.concatenate([s for _, s in sets])
                    h1[at] = np.add.reduceat(mix(flat + np.uint64(1)), begin)
                    h2[at] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)
                    least = np.empty((2 * m * r, len(at)), np.uint64)
                    for f in range(2 * m * r):
                        least[f] = np.minimum.reduceat((flat * odd[f]) >> np.uint64(32), begin)
                    half = np.zeros((2 * m, len(at)), np.uint64)
                    for f in range(r):
                        half = mix(half * np.uint64(0x9E3779B97F4A7C15) + least[f::r] + np.uint64(1))
                    keys[at] = mix(half + index).T
                flat_keys = keys.view(np.int64)
                ends = pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, m, 0))]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(flat_keys[n > 0, s : s + m].ravel())) for s in (0, m)]
                yield arrow_rows(arrow, [rows.column(0).cast(pa.int64()), n, h1.view(np.int64), h2.view(np.int64), *lists])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), schema)


def _sets(docs: DataFrame, cfg: Config) -> DataFrame:
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("s", T.ArrayType(T.LongType(), False))])
    arrow = pa.schema([("doc_id", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                sets = dict(shingle_sets(raw, off, cfg.words))
                ends = np.cumsum([0] + [len(sets.get(i, ())) for i in range(rows.num_rows)])
                flat = np.concatenate(list(sets.values())).view(np.int64) if sets else np.zeros(0, np.int64)
                yield arrow_rows(arrow, [rows.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))])

    return docs.mapInArrow(lean(run), schema)


def _with_sets(rows: DataFrame, pairs: DataFrame, sets: DataFrame, by: str, other: str, name: str) -> tuple[DataFrame, DataFrame]:
    """rows (u, v of pairs, and more) with the set of their document `by` as `name`; and the table of hot documents, to be dropped when these are used up.

    A document of more than PARTNERS pairs, such as the first of a large group, is salted: its pairs are dealt by `other`, and its set is copied once for
    each salt, so that the copies number a PARTNERS-th of the pairs and no task takes all pairs of one document.
    """
    many = written(pairs.groupBy(by).agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("salts")).where("salts > 1"), "many")
    few = F.broadcast(many) if many.count() <= BROADCAST_IDS else many
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(other), "salts")).cast("int")
    dealt = rows.join(few, by, "left").withColumn("salt", salt).drop("salts")
    copies = F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)
    copied = sets.select(F.col("doc_id").alias(by), F.col("s").alias(name)).join(few, by, "left").select(by, name, F.explode(copies).alias("salt"))
    return dealt.join(copied, [by, "salt"]).drop("salt"), many


def confirmed(pairs: DataFrame, docs: DataFrame, cfg: Config) -> DataFrame:
    """The pairs (u, v), all different, whose full sets meet the similarity. docs: doc_id, text, one row for each id at least."""
    ids = written(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = written(_sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi"), cfg), "sets")
    both = F.size(F.array_intersect("su", "sv"))
    half, hot_u = _with_sets(pairs, pairs, sets, "u", "v", "su")
    met, hot_v = _with_sets(half, pairs, sets, "v", "u", "sv")
    held = met.where(100 * both >= cfg.percent * (F.size("su") + F.size("sv") - both)).select("u", "v").distinct()
    held = written(held, "links")
    dropped(ids, sets, hot_u, hot_v)
    return held


def _dealt(tables: DataFrame, *group: str) -> DataFrame:
    """tables (key, rep, n, wide and the columns of group) with the first member of its group, those next to it and their sizes."""
    by = Window.partitionBy(*group).orderBy("rep")
    return tables.select("key", "rep", "n", "wide", F.first("rep").over(by).alias("head"), F.first("n").over(by).alias("head_n"), F.lag("rep").over(by).alias("back"), F.lag("n").over(by).alias("back_n"), F.lead("rep").over(by).alias("next"))


def _first_pairs(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v): each member with the head of its group and with the member before it, where their sizes allow the similarity."""
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    out = dealt.where((F.col("back") == F.col("head")) & fits("n", "back_n")).select(F.col("rep").alias("u"), F.col("head").alias("v"))
    for at in ("head", "back"):
        out = out.unionByName(dealt.where((F.col("back") > F.col("head")) & fits("n", f"{at}_n")).select(F.col("rep").alias("u"), F.col(at).alias("v")))
    return out


def near_duplicates(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, class_id.

    class_id: the least doc_id with the same set.
    component_id: the least doc_id that can be reached; kept: whether it is the row's own.
    """
    sig = written(signatures(docs, cfg), "signatures")
    reps = written(sig.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("a").alias("a"), F.first("b").alias("b")), "classes")

    halves = reps.select("rep", "n", F.explode("a").alias("x"), "b")
    hot = written(halves.groupBy("x").agg(F.count("*").alias("size")).where(F.col("size") > cfg.hot).select("x", F.ceil(F.col("size") / cfg.hot).cast("int").alias("salts")), "hot")
    halves = halves.join(F.broadcast(hot) if hot.count() <= BROADCAST_IDS else hot, "x", "left")
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), "salts")).cast("int")
    tables = halves.select("rep", "n", "x", "salts", F.explode("b").alias("y")).select(F.xxhash64("x", "y").alias("key"), "rep", "n", salt.alias("salt"), F.col("salts").isNotNull().alias("wide"))
    met = written(_dealt(tables, "key", "salt").where("wide or back is not null or next is not null"), "tables")
    # a key has one head for each salt, so this second dealing is of few rows
    heads = _dealt(met.where("wide and back is null").select("key", "rep", "n", "wide"), "key")
    first = _first_pairs(met, cfg.percent).unionByName(_first_pairs(heads, cfg.percent))
    pairs = written(first.where("u <> v").distinct(), "pairs")
    links = confirmed(pairs, docs, cfg)
    label = written(components(links), "labels")

    # documents of tables that hold more than one label: what may still link two components
    named = met.select("key", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("key")
    open_ = written(named.join(mixed, "key", "left_semi").select("rep", "label").distinct(), "open")
    late = confirmed(_late_links(open_, reps, docs, cfg), docs, cfg)
    n_late = late.count()
    if n_late > BROADCAST_IDS // 2:
        label, n_late = written(components(links.unionByName(late)), "labels"), 0
    classes = reps.select("n", "h1", "h2", "rep").join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    merged = None
    if n_late:  # they link whole components: at most two names a link, so that the table of new names can be broadcast
        both = late
        for end in ("u", "v"):
            both = both.join(label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
        merged = written(components(both.select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))), "merged")
        names = F.broadcast(merged.select(F.col("node").alias("component_id"), F.col("label").alias("merged")))
        classes = classes.join(names, "component_id", "left").withColumn("component_id", F.coalesce("merged", "component_id")).drop("merged")
    out = sig.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
    out = written(out, "near")
    dropped(sig, reps, hot, met, pairs, links, label, open_, late, *([merged] if merged else []))
    return out


def _overlaps(sets: list[np.ndarray], size: np.ndarray, label: np.ndarray, split: int, percent: int) -> list[tuple[int, int]]:
    """One pair for each two labels that some pair of different blocks (before and from split; one block if split is 0) links."""
    n = len(sets)
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    of, column = of[keep], column[inverse[keep]]
    rows, cols = (slice(0, split), slice(split, n)) if split else (slice(0, n), slice(0, n))
    both = np.zeros((rows.stop - rows.start, cols.stop - cols.start), np.float32)
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    for a in range(0, int(shared.sum()), 4096):  # slabs of the shared shingles as 0/1 columns
        lo, hi = np.searchsorted(column, (a, a + 4096))
        slab = np.zeros((n, 4096), np.float32)
        slab[of[lo:hi], column[lo:hi] - a] = 1
        both += slab[rows] @ slab[cols].T
    total = size[rows][:, None] + size[cols][None, :]
    i, j = np.nonzero((100 * both >= percent * (total - both)) & (label[rows][:, None] != label[cols][None, :]))
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    for u, v in zip((i + rows.start).tolist(), (j + cols.start).tolist()):
        seen.setdefault(tuple(sorted((int(label[u]), int(label[v])))), (u, v))
    return list(seen.values())


def _late_links(open_: DataFrame, reps: DataFrame, docs: DataFrame, cfg: Config) -> DataFrame:
    """(u, v): links between documents of `open_` (rep, label) that carry different labels and share a half key of A.

    Groups of one half key are cut into blocks of about cfg.block documents, fewer where their sets are large; each two blocks meet in one group of bounded size, and there
    all sets are compared at once (a product of 0/1 matrices). Only links leave it, never candidates.
    """
    few = written(reps.join(open_, "rep").select("rep", "n", "label", "a"), "few")
    n = few.count()
    ids = few.select(F.col("rep").alias("doc_id"))
    sets = _sets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, "doc_id", "left_semi"), cfg)
    sets = written(sets.select(F.col("doc_id").alias("rep"), "s").dropDuplicates(["rep"]), "late_sets")
    rows = few.select("rep", "n", "label", F.explode("a").alias("x"))
    groups = rows.groupBy("x").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")
    blocks = F.greatest(F.ceil(F.col("size") / cfg.block), F.ceil(F.col("shingles") / cfg.block_shingles)).cast("int")
    placed = rows.join(groups, "x").select("x", "rep", "label", F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"), blocks.alias("blocks"))
    dealt = placed.select("x", "rep", "label", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("x", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "label").join(sets, "rep")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        held: list[tuple] = []

        def solve():
            if len({h[5] for h in held}) < 2:
                return []
            rep, label = np.array([h[4] for h in held]), np.array([h[5] for h in held])
            split = sum(h[3] == held[0][1] for h in held) if held[0][1] != held[0][2] else 0
            if split == len(held):
                return []
            found = [h[6] for h in held]
            return [(max(rep[u], rep[v]), min(rep[u], rep[v])) for u, v in _overlaps(found, np.array([len(f) for f in found]), label, split, cfg.percent)]

        for batch in batches:
            out = []
            flat = batch.column("s").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column("s").value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for k, key in enumerate(zip(*(batch.column(c).to_pylist() for c in ("x", "i", "j", "own", "rep", "label")))):
                if held and held[0][:3] != key[:3]:
                    out += solve()
                    held = []
                held.append((*key, flat[ends[k] : ends[k + 1]].copy()))
            if out:
                yield arrow_rows(schema, [np.array(c, np.int64) for c in zip(*out)])
        if held and (out := solve()):
            yield arrow_rows(schema, [np.array(c, np.int64) for c in zip(*out)])

    links = dealt.repartition("x", "i", "j").sortWithinPartitions("x", "i", "j", "own").select("x", "i", "j", "own", "rep", "label", "s").mapInArrow(lean(run), "u long, v long")
    links = written(links.distinct(), "late")
    dropped(few, sets)
    return links


def oracle(words: int = 2, percent: int = 80) -> str:
    """near_duplicates() of documents (each doc_id once) in DuckDB: all pairs of different sets."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    shingle = " || ' ' || ".join(f"w[i + {j}]" for j in range(words))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_sort(list_distinct([{shingle} for i in range(1, len(w) - {words - 2})]))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM split
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS rep FROM sets WHERE len(s) > 0 GROUP BY s
), links AS (
  SELECT a.rep AS u, b.rep AS v, a.n + b.n AS total, len(list_intersect(a.s, b.s)) AS shared
  FROM classes a JOIN classes b ON a.rep <> b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
), met AS MATERIALIZED (SELECT u, v FROM links WHERE 100 * shared >= {percent} * (total - shared)
), reach AS (SELECT rep AS node, rep AS label FROM classes UNION SELECT met.v, reach.label FROM reach JOIN met ON met.u = reach.node
), named AS (SELECT node, min(label) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(sets.s) AS BIGINT) AS n_shingles, coalesce(component, doc_id) AS component_id,
  coalesce(component, doc_id) = doc_id AS kept, coalesce(rep, doc_id) AS class_id
FROM sets LEFT JOIN classes ON sets.s = classes.s LEFT JOIN named ON named.node = classes.rep
"""


def deduplicated(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs with one document of each group: that of the least doc_id. Rows that repeat a doc_id go too; rows without doc_id stay."""
    near = near_duplicates(docs, cfg)
    key = F.col("doc_id").cast("long")
    gone = written(near.where("not kept").select(F.col("doc_id").alias("gone__")).distinct(), "gone")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    out = docs.join(small, key == F.col("gone__"), "left_anti")
    twice = written(near.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("twice__")), "twice")
    n = twice.count()
    if n:
        twice = F.broadcast(twice) if n <= BROADCAST_IDS else twice
        out = out.join(twice, key == F.col("twice__"), "left_anti").unionByName(out.join(twice, key == F.col("twice__"), "left_semi").dropDuplicates(["doc_id"]))
    return out
