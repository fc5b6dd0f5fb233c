"""Self-join of word n-gram sets by Jaccard similarity, in vertical fragments.

1. Rows with equal sets form a class; its least doc_id stands for it, so that copies are never expanded. In the same pass each task reports the shingles that
   several of its sets hold: every shingle beyond a small share of the corpus is among these.
2. All shingles get one global order: by hash, but for common ones, which come last, the most common at the very end. Two sets of the similarity
   share one of their first n - ceil(percent * n / 100) + 1 shingles in any order; with this one, such a prefix holds a common passage only if most of the
   text is made of such. Which shingles count as common changes the work alone, never the result.
3. A holder of a prefix shingle is paired with the least holder and with the one before, for the first and the last `lead` shared shingles of its prefix. These
   pairs are confirmed and joined to components.
4. What can still link two components are pairs that share a prefix shingle and carry different labels. They are found within blocks of bounded size, by sizes
   and by what is left of both prefixes from that shingle on, and confirmed too. A group of near copies that is one component by now costs nothing more.
5. To confirm pairs, the overlap of their prefixes is counted first: what lies beyond can't make up for too few. For the pairs that are left the order by hash is cut
   into `fragments`. Sets are cut at the same places; the fragments of two blocks of documents meet in one cell, where the overlaps of the cell's
   pairs are counted, and a pair's counts are summed over its fragments. A document is copied once for each cell that it is needed in, not for
   each pair, and a long one is dealt over the fragments.

The similarity is tested in whole numbers: 100 * intersection >= percent * union. Shingles are 64-bit hashes of whole texts, lower-cased from A-Z.

Nulls, empty texts and texts without words have no shingles and stay alone. A null doc_id is kept, alone. Rows with the same doc_id count as one document
when their sets are equal too; otherwise they are joined, as they carry one id. Equal sets are a tie, which the least doc_id wins. An empty table gives no
rows. Extra columns of the input are ignored, whatever their names. Links within a component that follow from others aren't looked for, so that links aren't counted.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written
from .graph import components
from .kernels import arrow_rows, lean, mix, slices
from .minhash import shingle_sets
from .minhash import oracle as pairs_oracle

#: A table of classes or ids up to this many rows is broadcast (40 bytes each at most); a larger one is joined by shuffle.
BROADCAST_ROWS = 500_000
#: Holders that a task looks at together, so that a pair comes out once for these.
GATHERED = 20_000


@dataclass(frozen=True)
class Config:
    words: int = 5
    percent: int = 80
    fragments: int = 4
    #: Shingles of a chunk of `chunk` in `local` sets or more are reported; the order knows the `common` most reported ones.
    chunk: int = 4_000_000
    local: int = 4
    common: int = 500_000
    #: Shared shingles at either end of a prefix that give the first pairs.
    lead: int = 8
    #: Documents and shingles of a block whose pairs are confirmed together; holders of a shingle in a block that are compared with each other.
    block: int = 1024
    block_shingles: int = 1_000_000
    holders: int = 512
    #: Holders of a common shingle in one task.
    hot: int = 50_000


def _digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all sets one after the other, where each begins, two 64-bit digests of each); none of them is empty."""
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    return flat, begin, np.add.reduceat(mix(flat + np.uint64(1)), begin), np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), begin)


def _first_pass(docs: DataFrame, cfg: Config) -> DataFrame:
    """(doc_id, n, h1, h2, null, null) of each row, and (null, null, null, null, shingle, sets) of each reported shingle."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n", "h1", "h2", "shingle", "sets")])

    def run(batches):
        held, size, seen = [], 0, set()

        def reported():
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            many = counts >= cfg.local
            found = found[many].view(np.int64)
            none = pa.nulls(len(found), pa.int64())
            return arrow_rows(schema, [none, none, none, none, found, counts[many]])

        for batch in batches:
            for rows, raw, off in slices(batch):
                n, h1, h2 = np.zeros(rows.num_rows, np.int64), *np.zeros((2, rows.num_rows), np.uint64)
                pairs = list(shingle_sets(raw, off, cfg.words))
                if pairs:
                    at, sets = [i for i, _ in pairs], [s for _, s in pairs]
                    n[at] = [len(s) for s in sets]
                    _, _, h1[at], h2[at] = _digests(sets)
                    for i, s in pairs:  # of equal sets one counts
                        if (int(h1[i]), int(h2[i])) not in seen:
                            seen.add((int(h1[i]), int(h2[i])))
                            held.append(s)
                            size += len(s)
                none = pa.nulls(rows.num_rows, pa.int64())
                yield arrow_rows(schema, [rows.column(0), n, h1.view(np.int64), h2.view(np.int64), none, none])
                if size >= cfg.chunk:
                    yield reported()
                    held, size, seen = [], 0, set()
        if held:
            yield reported()

    return docs.mapInArrow(lean(run), "doc_id long, n long, h1 long, h2 long, shingle long, sets long")


def _common(first: DataFrame, cfg: Config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cfg.common most reported shingles: sorted, with the rank of each (the least reported first) and the sets it was reported of."""
    found = first.where("shingle is not null").groupBy("shingle").agg(F.sum("sets").alias("sets")).orderBy(F.desc("sets"), "shingle").limit(cfg.common).toArrow()
    shingle, sets = found.column("shingle").to_numpy().view(np.uint64), found.column("sets").to_numpy()
    by_hash = np.argsort(shingle)
    return shingle[by_hash], np.arange(len(sets))[::-1][by_hash], sets[by_hash]


def _sets_of(wanted: DataFrame, docs: DataFrame, cfg: Config, make, schema: pa.Schema, kind: str) -> DataFrame:
    """What make(rep, n, h1, set) yields for the set of each class in wanted (rep, n, h1, h2): texts whose set is another one's are passed over."""
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    rows = docs.join(few.withColumnRenamed("rep", "doc_id"), "doc_id").select("doc_id", "n", "h1", "h2", "text")

    def run(batches):
        for batch in batches:
            for part, raw, off in slices(batch):
                pairs = [(i, s) for i, s in shingle_sets(raw, off, cfg.words)]
                if not pairs:
                    continue
                ids, n, w1, w2 = (part.column(c).to_pylist() for c in ("doc_id", "n", "h1", "h2"))
                _, _, h1, h2 = _digests([s for _, s in pairs])
                out = [x for (i, s), a, b in zip(pairs, h1.view(np.int64).tolist(), h2.view(np.int64).tolist()) if (len(s), a, b) == (n[i], w1[i], w2[i]) for x in make(ids[i], n[i], a, s)]
                if out:
                    *single, arrays = zip(*out)
                    ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]), pa.int32())
                    yield arrow_rows(schema, [*single, pa.ListArray.from_arrays(ends, pa.array(np.concatenate(arrays).view(np.int64)))])

    return rows.mapInArrow(lean(run), kind)


def _prefixes(classes: DataFrame, docs: DataFrame, common, cfg: Config) -> DataFrame:
    """rep, n, prefix (its shingles in the global order) of each class."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def make(rep, n, _, s):
        known, rank, _ = shared.value
        at = np.searchsorted(known, s)
        at[at == len(known)] = 0
        is_common = known[at] == s if len(known) else np.zeros(len(s), bool)
        length = n - -(-cfg.percent * n // 100) + 1
        rare = s[~is_common][:length]
        if len(rare) < length:
            late = np.flatnonzero(is_common)
            late = late[np.argsort(rank[at[late]], kind="stable")]
            rare = np.concatenate([rare, s[late][: length - len(rare)]])
        yield rep, n, rare

    schema = pa.schema([("rep", pa.int64()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64()))])
    return _sets_of(classes, docs, cfg, make, schema, "rep long, n long, prefix array<long>")


def _fits(n: Column, other: Column, cfg: Config) -> Column:
    return 100 * F.least(n, other) >= cfg.percent * F.greatest(n, other)


def _holders(prefixes: DataFrame, common, cfg: Config) -> DataFrame:
    """Holders of prefix shingles that have more than one: key, rep, n, pos, wide, the group's first holder and the one before (head, back with n), and the
    place of the shingle among those of rep, from the begin (rank) and from the end (left).

    A common shingle of more than cfg.hot holders has its holders dealt into salts; wide marks these.
    """
    spark = prefixes.sparkSession
    hot = common[2] > cfg.hot
    salted = spark.createDataFrame(list(zip(common[0][hot].view(np.int64).tolist(), (-(-common[2][hot] // cfg.hot)).tolist())), "key long, salts long")
    rows = prefixes.select("rep", "n", F.posexplode("prefix").alias("pos", "key")).join(F.broadcast(salted), "key", "left")
    rows = rows.select("key", "rep", "n", "pos", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("rep"), F.col("salts"))).cast("int").alias("salt"), F.col("salts").isNotNull().alias("wide"))
    dealt = written(_dealt(rows, "key", "salt").where("wide or back is not null or next is not null").drop("salt", "next"), "dealt")
    place = lambda by: F.row_number().over(Window.partitionBy("rep").orderBy(by, "key"))
    out = written(dealt.withColumns({"rank": place(F.asc("pos")), "left": place(F.desc("pos"))}), "holders")
    dropped(dealt)
    return out


def _dealt(rows: DataFrame, *group: str) -> DataFrame:
    by = Window.partitionBy(*group).orderBy("rep")
    return rows.withColumns({"head": F.first("rep").over(by), "head_n": F.first("n").over(by), "back": F.lag("rep").over(by), "back_n": F.lag("n").over(by), "next": F.lead("rep").over(by)})


def _first_pairs(holders: DataFrame, cfg: Config) -> DataFrame:
    """(u, v): a holder with the least one and with the one before, for the rarest and the most common of its shared prefix shingles: these meet near copies, those what few others hold."""
    heads = _dealt(holders.where("wide and back is null").select("key", "rep", "n", "pos"), "key").select("rep", "n", "head", "head_n", "back", "back_n")
    lead = holders.where((F.col("rank") <= cfg.lead) | (F.col("left") <= cfg.lead))
    rows = lead.select("rep", "n", "head", "head_n", "back", "back_n").unionByName(heads).where("back is not null")
    pairs = [rows.where(_fits(F.col("n"), F.col(f"{at}_n"), cfg)).select(F.col("rep").alias("u"), F.col(at).alias("v")) for at in ("head", "back")]
    return pairs[0].unionByName(pairs[1]).where("u <> v").distinct()


def _mixed(holders: DataFrame, label: DataFrame) -> DataFrame:
    """key, rep, n, pos, left, label, size of the holders of prefix shingles whose holders carry more than one label; size counts these."""
    named = written(holders.select("key", "rep", "n", "pos", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")), "named")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size")).where("lo <> hi").drop("lo", "hi")
    out = written(named.join(mixed, "key"), "mixed")
    dropped(named)
    return out


def _late_pairs(mixed: DataFrame, cfg: Config) -> DataFrame:
    """(u, v), all different: holders of one prefix shingle that carry different labels, may be similar by sizes and places.

    The holders of a shingle are cut into blocks; each two blocks meet in one cell, so that no task takes all holders.
    """
    blocks = F.ceil(F.col("size") / cfg.holders).cast("int")
    placed = mixed.select("key", "rep", "n", "pos", "left", "label", blocks.alias("blocks"), F.pmod(F.xxhash64("rep"), blocks).cast("int").alias("own"))
    dealt = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "pos", "left", "label")
    schema, columns = pa.schema([("u", pa.int64()), ("v", pa.int64())]), ("key", "i", "j", "own", "rep", "n", "pos", "left", "label")

    def pairs(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        """Of whole cells, in order: each row with the one d after it, for every d."""
        new = np.flatnonzero((np.diff(x["key"]) != 0) | (np.diff(x["i"]) != 0) | (np.diff(x["j"]) != 0)) + 1
        cell = np.zeros(len(x["key"]), np.int64)
        cell[new] = 1
        end = np.append(new, len(cell))[np.cumsum(cell)]  # where the cell of each row ends
        us, vs, a, d = [], [], np.arange(len(cell)), 0
        while len(a):
            d += 1
            a = a[a + d < end[a]]
            b = a + d
            small, great = np.minimum(x["n"][a], x["n"][b]), np.maximum(x["n"][a], x["n"][b])
            # were this the first shingle that both hold: what they can share from here on, and of their prefixes (see _promising)
            left = np.minimum(x["n"][a] - x["pos"][a], x["n"][b] - x["pos"][b])
            left = np.minimum(left, np.minimum(x["left"][a], x["left"][b]) - (-cfg.percent * great // 100) - 1)
            ok = (x["label"][a] != x["label"][b]) & ((x["i"][a] == x["j"][a]) | (x["own"][a] != x["own"][b])) & (100 * small >= cfg.percent * great) & ((100 + cfg.percent) * left >= cfg.percent * (small + great))
            us.append(np.maximum(x["rep"][a[ok]], x["rep"][b[ok]]))
            vs.append(np.minimum(x["rep"][a[ok]], x["rep"][b[ok]]))
        both = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)]), axis=1) if us else np.zeros((2, 0), np.int64)
        return arrow_rows(schema, [both[0], both[1]])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append({c: batch.column(c).to_numpy() for c in columns})
            size += batch.num_rows
            if size >= GATHERED:
                x = {c: np.concatenate([h[c] for h in held]) for c in columns}
                last = (x["key"] == x["key"][-1]) & (x["i"] == x["i"][-1]) & (x["j"] == x["j"][-1])  # this cell may go on
                held = [{c: x[c][last] for c in columns}]
                size = int(last.sum())
                yield pairs({c: x[c][~last] for c in columns})
        if size:
            yield pairs({c: np.concatenate([h[c] for h in held]) for c in columns})

    found = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(lean(run), "u long, v long")
    return written(found.distinct(), "late")


CELL = ("f", "bu", "bv")


def _counted(cfg: Config):
    """mapInArrow function over cells (segments of documents before pairs): the overlap of each pair in the cell's fragment, where there is one."""
    schema = pa.schema([(c, pa.int64()) for c in ("u", "v", "hu", "hv", "total", "both")])

    def overlaps(docs: dict[int, dict], pairs: list[tuple[int, int]]):
        of_u: dict[int, list[int]] = {}
        for u, v in pairs:
            of_u.setdefault(u, []).append(v)
        for u, vs in of_u.items():
            other = [(v, h, *x) for v in vs for h, x in docs.get(v, {}).items()]
            for hu, (nu, s) in docs.get(u, {}).items() if other else ():
                flat = np.concatenate([x[3] for x in other])
                at = np.searchsorted(s, flat)
                at[at == len(s)] = 0
                both = np.add.reduceat((s[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum([len(x[3]) for x in other])[:-1]]))
                for (v, hv, nv, _), n in zip(other, both.tolist()):
                    if n:
                        yield u, v, hu, hv, nu + nv, n

    def run(batches):
        cell, docs, pairs, out = None, {}, [], []
        for batch in batches:
            f, bu, bv, kind, a, b, h, n = (batch.column(c).to_pylist() for c in (*CELL, "kind", "a", "b", "h", "n"))
            flat = batch.column("s").flatten().to_numpy()
            ends = np.concatenate([[0], np.cumsum(batch.column("s").value_lengths().to_numpy(zero_copy_only=False))]).astype(int)
            for k in range(batch.num_rows):
                if (f[k], bu[k], bv[k]) != cell:
                    out += overlaps(docs, pairs)
                    cell, docs, pairs = (f[k], bu[k], bv[k]), {}, []
                if kind[k]:
                    pairs.append((a[k], b[k]))
                else:
                    docs.setdefault(a[k], {})[h[k]] = n[k], flat[ends[k] : ends[k + 1]].copy()  # a repeated row once
            if out:
                yield arrow_rows(schema, list(zip(*out)))
                out = []
        if out := list(overlaps(docs, pairs)):
            yield arrow_rows(schema, list(zip(*out)))

    return lean(run)


def _met(pairs: DataFrame, segments: DataFrame, fragments: int, cfg: Config) -> DataFrame:
    """u, v, hu, hv, total (both sizes), both (summed overlap) of the pairs (u, v) by segments (rep, h, n, f, s)."""
    of, shingles = segments.agg(F.count_distinct("rep"), F.coalesce(F.sum(F.size("s")), F.lit(0))).first()
    blocks = max(1, -(-of // cfg.block), -(-shingles // cfg.block_shingles))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    placed = pairs.select(block("u").alias("bu"), block("v").alias("bv"), "u", "v")
    needed = placed.select("bu", "bv", F.col("u").alias("rep")).unionByName(placed.select("bu", "bv", F.col("v").alias("rep"))).distinct()
    zero = F.lit(0).cast("long")
    sets = needed.join(segments, "rep").select(*CELL, F.lit(0).alias("kind"), F.col("rep").alias("a"), zero.alias("b"), "h", "n", "s")
    asked = placed.select(F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("f"), "bu", "bv", F.lit(1).alias("kind"), F.col("u").alias("a"), F.col("v").alias("b"), zero.alias("h"), zero.alias("n"), F.array().cast("array<long>").alias("s"))
    cells = sets.unionByName(asked).repartition(*CELL).sortWithinPartitions(*CELL, "kind", "a")
    partial = cells.mapInArrow(_counted(cfg), "u long, v long, hu long, hv long, total long, both long")
    return partial.groupBy("u", "v", "hu", "hv").agg(F.sum("both").alias("both"), F.first("total").alias("total"))


def _promising(pairs: DataFrame, holders: DataFrame, cfg: Config) -> DataFrame:
    """The pairs that share enough of their prefixes.

    Of the two prefixes one ends first in the global order; what both sets share up to there lies in both prefixes, and what is left of that set is all that
    can be shared beyond. Shared prefix shingles have two holders by definition, so that holders has all of them.
    """
    ids = written(pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct(), "ids")
    held = holders.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "rep", "left_semi").groupBy("rep", "n").agg(F.sort_array(F.collect_set("key")).alias("s"))
    held = written(held.select("rep", F.col("n").alias("h"), "n", F.lit(0).alias("f"), "s"), "held")
    rest = lambda n: F.ceil(cfg.percent * F.col(n) / 100) - 1
    enough = (100 + cfg.percent) * (F.col("both") + F.greatest(rest("hu"), rest("hv"))) >= cfg.percent * F.col("total")
    out = written(_met(pairs, held, 1, cfg).where(enough).select("u", "v").distinct(), "promising")
    dropped(ids, held)
    return out


def confirmed(pairs: DataFrame, holders: DataFrame, classes: DataFrame, docs: DataFrame, cfg: Config) -> DataFrame:
    """The pairs (u, v), all different, that are similar: overlaps are counted in fragments and summed, those of the prefixes first."""
    pairs = _promising(pairs, holders, cfg)
    ids = written(pairs.select(F.col("u").alias("rep")).unionByName(pairs.select(F.col("v").alias("rep"))).distinct(), "ids")
    wanted = classes.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "rep", "left_semi")
    cuts = np.array([(i << 64) // cfg.fragments for i in range(1, cfg.fragments)], dtype=np.uint64)

    def make(rep, n, h, s):
        at = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
        for f in range(cfg.fragments):
            if at[f] < at[f + 1]:
                # compared as signed numbers on the other side, which keep their order within a fragment but for one that holds the middle
                yield rep, h, n, f, np.sort(s[at[f] : at[f + 1]].view(np.int64))

    schema = pa.schema([("rep", pa.int64()), ("h", pa.int64()), ("n", pa.int64()), ("f", pa.int32()), ("s", pa.list_(pa.int64()))])
    segments = written(_sets_of(wanted, docs, cfg, make, schema, "rep long, h long, n long, f int, s array<long>"), "segments")
    out = written(_met(pairs, segments, cfg.fragments, cfg).where(100 * F.col("both") >= cfg.percent * (F.col("total") - F.col("both"))).select("u", "v").distinct(), "links")
    dropped(pairs, ids, segments)
    return out


def _joined(label: DataFrame, late: DataFrame) -> DataFrame:
    """label (node, label) after the links `late` between its components; nodes that it doesn't hold are their own label."""
    both = late
    for end in ("u", "v"):
        both = both.join(label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left").withColumn(f"{end}_label", F.coalesce(f"{end}_label", end))
    merged = written(components(both.select(F.col("u_label").alias("u"), F.col("v_label").alias("v"))), "merged")
    to = merged.select(F.col("node").alias("label"), F.col("label").alias("to"))
    old = label.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    out = written(old.unionByName(merged.join(label.select("node"), "node", "left_anti").select("node", "label")), "labels")
    dropped(merged)
    return out


def jaccard_components(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id (the least doc_id that can be reached by links), class_id (that with the same set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = written(_first_pass(docs, cfg), "first")
    texts = first.where("shingle is null").select("doc_id", "n", "h1", "h2")
    classes = written(texts.where("n > 0 and doc_id is not null").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")), "classes")
    common = _common(first, cfg)
    holders = _holders(_prefixes(classes, docs, common, cfg), common, cfg)
    tried, label = None, None
    for step in (_first_pairs, _late_pairs):
        rows = holders if label is None else _mixed(holders, label)
        pairs = written(step(rows, cfg), "pairs")
        new = pairs if tried is None else written(pairs.join(tried, ["u", "v"], "left_anti"), "new")
        links = confirmed(new, holders, classes, docs, cfg)
        if label is None:
            label = written(components(links), "labels")
        elif not links.isEmpty():
            old, label = label, _joined(label, links)
            dropped(old)
        old, tried = tried, pairs if tried is None else written(tried.unionByName(new), "tried")
        dropped(links, *([] if old is None else [old, rows, pairs, new]))
    named = classes.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("n", "h1", "h2", F.col("rep").alias("class_id"), F.coalesce("label", "rep").alias("component_id"))
    known = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id")).alias(c)
    out = texts.join(named, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), known("component_id"), known("class_id"))
    out = written(out, "joined")
    dropped(first, classes, holders, label, tried)
    return out


def oracle(words: int = 5, percent: int = 80) -> str:
    """jaccard_components() in DuckDB: all pairs of different sets."""
    return f"SELECT doc_id, n_shingles, component_id, class_id FROM ({pairs_oracle(words, percent)})"
