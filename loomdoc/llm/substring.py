"""Repeated passages by collinear chaining of shared k-mer seeds.

1. Seeds. Of the `k`-word windows of each text those with the least hash of `window` consecutive ones are seeds
   (minimizers): two texts that share k + window - 1 words in a row share a seed, whatever stands around it.
   Texts of fewer than `least_words` words hold no passage and give none.
2. Anchors. In each input partition every occurrence of a seed is anchored to its first one there (by doc_id and place); only
   these first ones are dealt by hash, sorted, and anchored to the very first. So a seed brings one row at most for each
   partition to its group, however many documents share it, and there are no pairs within groups. The second and
   later occurrences in one document are anchored both to the seed's first one and to that of the same number elsewhere.
   A seed has one first holder only, so that a later copy of a passage whose parts stand here and there in earlier documents would share anchors with many documents and with
   none enough. So couples of a document's shared seeds, up to `couple` apart, that are anchored to different documents are seeds as well, whatever stands
   between them: they are anchored to their own first holder, which has both.
3. Chains. The anchors of a pair of documents are sorted; the best local chains (each anchor worth its new words, gaps at
   a cost in their length and in their change of diagonal) are found with a Fenwick tree of prefix maxima, in n log n. Anchors in one run on one diagonal are a chain as they are.
4. Alignment. A chain is aligned on the words themselves: matching runs along the diagonals, a longest common
   subsequence in the gaps, and extension at both ends while matches outweigh mismatches. A passage has at least
   `least_words` words on both sides, of which `percent` % match in order.
5. Exact windows. The single partner of an anchor can differ from seed to seed, so that a passage of phrases that stand in many
   documents leaves no chain. So every run of `least_words` words that stands in two documents is found by itself as well: runs that begin at
   a minimizer and are shorter by `window - 1` words tell where such windows can be (each window holds one); the windows there are
   joined to their first holder, which holds all of their words. That is one row at most for each window and block.

The later document (by doc_id) holds the repetition, the earlier one its source. deduplicated() removes repetitions and
keeps sources: words of the spans go, the rest of the text stays as it is.

Words are lower-cased (A-Z) runs without white space. Null and empty texts have none. Rows without doc_id take no part.
Rows with the same doc_id are one document, of which one text is compared (that of the greatest word hashes); in deduplicated() each row with a text that
carries the span loses it. Repetitions within one document are not looked for. Long texts are read whole; of equal holders of a run the least doc_id, then the
first place, is its source. An empty table gives no rows. Extra columns are kept by deduplicated(), whatever their names.
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
from .kernels import SPACED, Words, arrow_rows, free_name, lean, mix, slices, windows

#: A set of ids up to this size is broadcast (8 bytes each); a larger one is joined by shuffle.
BROADCAST_IDS = 2_000_000


@dataclass(frozen=True)
class Config:
    k: int = 5
    window: int = 16
    least_words: int = 50
    percent: int = 80
    gap_cost: float = 0.2
    shift_cost: float = 0.5
    max_gap: int = 48
    least_anchors: int = 2
    pad: int = 64
    couple: int = 6


def _slide(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over each n consecutive values."""
    step = 1
    while step * 2 <= n:
        x = pick(x[:-step], x[step:])
        step *= 2
    return pick(x[: len(x) - (n - step)], x[n - step :]) if n > step else x


def minimizers(h: np.ndarray, rows: np.ndarray, k: int, w: int) -> np.ndarray:
    """Places of the windows h (k words each, rows of the words) that are the least of w consecutive ones within a row."""
    n = len(h)
    if n < w:
        return np.zeros(0, np.int64)
    least = _slide(h, w, np.minimum)
    least = np.where(rows[: len(least)] == rows[k + w - 2 : k + w - 2 + len(least)], least, 0)
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    return np.flatnonzero((_slide(around, w, np.maximum)[:n] == h) & (h > 0))


ANCHOR = "doc long, partner long, x int, y int"
ANCHOR_ARROW = pa.schema([("doc", pa.int64()), ("partner", pa.int64()), ("x", pa.int32()), ("y", pa.int32())])


def _firsts(h: np.ndarray, d: np.ndarray, *places: np.ndarray) -> tuple:
    """Sorted by h, d and the first of places: h, d, places, whether a row is the first of its h, and the row that is."""
    order = np.lexsort((places[0], d, h))
    h, d, *places = (v[order] for v in (h, d, *places))
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return h, d, places, new, np.flatnonzero(new)[np.cumsum(new) - 1]


def _seeds(docs: DataFrame, cfg: Config) -> DataFrame:
    """Each occurrence of a seed (h, doc, x): the first one in a partition (partner is null; others: whether more documents there have it), and the others with that one (partner, y)."""
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("partner", pa.int64()), ("y", pa.int32()), ("others", pa.bool_())])

    def run(batches):
        hs, ds, xs = [], [], []
        for batch in batches:
            for rows, raw, off in slices(batch):
                w = Words(raw, off, SPACED, lower=True)
                row = w.rows()
                h = windows(w.hashes(), cfg.k)
                at = minimizers(h, row, cfg.k, cfg.window)
                at = at[w.count[row[at]] >= cfg.least_words]
                hs.append(h[at])
                ds.append(rows.column(0).to_numpy()[row[at]])
                xs.append((at - w.first[row[at]]).astype(np.int32))
        if not hs:
            return
        h, d, x = np.concatenate(hs), np.concatenate(ds), np.concatenate(xs)
        del hs, ds, xs
        order = np.lexsort((x, d, h))
        h, d, x = h[order], d[order], x[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        again = np.flatnonzero(same)
        if len(again):  # the n-th occurrence in a document is a seed of its own, besides
            nth = np.arange(len(h)) - np.flatnonzero(~same)[np.cumsum(~same) - 1]
            own = mix(h[again] + nth[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            h, d, x = np.concatenate([h, own]), np.concatenate([d, d[again]]), np.concatenate([x, x[again]])
        h, d, (x,), new, first = _firsts(h, d, x)
        late = d != d[first]
        others = np.zeros(len(h), bool)
        others[first[late]] = True
        for a in range(0, len(h), 200_000):
            s = slice(a, a + 200_000)
            keep = new[s] | late[s]
            head = new[s][keep]
            yield arrow_rows(schema, [h[s][keep].view(np.int64), d[s][keep], x[s][keep], pa.array(d[first[s]][keep], mask=head), pa.array(x[first[s]][keep], mask=head), others[s][keep]])

    return docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null").mapInArrow(lean(run), "h long, doc long, x int, partner long, y int, others boolean")


def _couples(shared: DataFrame, cfg: Config) -> DataFrame:
    """Couples of seeds of one document that are anchored to different documents (shared: h, doc, x, partner; their own holder is anchored to itself): the first occurrence in a
    partition (h, doc, x, x2) and the others with that one (partner, y, y2; h is null)."""
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("x2", pa.int32()), ("partner", pa.int64()), ("y", pa.int32()), ("y2", pa.int32())])

    def run(batches):
        parts, held = [], None

        def coupled(h, d, x, p):
            for j in range(1, cfg.couple + 1):
                at = np.flatnonzero((d[j:] == d[:-j]) & (p[j:] != p[:-j]) & (x[j:] > x[:-j]) & (x[j:] - x[:-j] <= cfg.max_gap))
                parts.append((mix(h[at] + mix(h[at + j]) * np.uint64(3)), d[at], x[at], x[at + j]))

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column("h").to_numpy().view(np.uint64), *(batch.column(c).to_numpy() for c in ("doc", "x", "partner"))]
            held = [np.concatenate(z) for z in zip(held, now)] if held else now
            end = int(np.searchsorted(held[1], held[1][-1]))
            if end:  # the last document may go on in the next batch
                coupled(*(z[:end] for z in held))
                held = [z[end:] for z in held]
        if held:
            coupled(*held)
        if not parts:
            return
        h, d, (x, x2), new, first = _firsts(*(np.concatenate(z) for z in zip(*parts)))
        for a in range(0, len(h), 200_000):
            s = slice(a, a + 200_000)
            keep = new[s] | (d[s] != d[first[s]])
            head = new[s][keep]
            f = first[s][keep]
            yield arrow_rows(schema, [pa.array(h[s][keep].view(np.int64), mask=~head), d[s][keep], x[s][keep], x2[s][keep], pa.array(d[f], mask=head), pa.array(x[f], mask=head), pa.array(x2[f], mask=head)])

    dealt = shared.repartition("doc").sortWithinPartitions("doc", "x")
    return dealt.mapInArrow(lean(run), "h long, doc long, x int, x2 int, partner long, y int, y2 int")


def anchors(docs: DataFrame, cfg: Config) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, partner, x, y) with partner < doc, and the tables to drop once they have been read."""
    seeds = written(_seeds(docs, cfg), "seeds")
    by = Window.partitionBy("h").orderBy("doc", "x")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = seeds.where("partner is null").select("h", "doc", "x", F.first("doc").over(whole).alias("partner"), F.first("x").over(whole).alias("y"), (F.max("others").over(whole) | (F.first("doc").over(whole) < F.last("doc").over(whole))).alias("shared"))
    heads = written(heads.where("shared").drop("shared"), "heads")
    found = seeds.where("partner is not null").select("h", "doc", "x", "partner", "y").unionByName(heads)
    scattered = written(found.groupBy("doc").agg(F.min("partner").alias("a"), F.max("partner").alias("b")).where("a < b").select("doc"), "scattered")
    several = found.select("h", "doc", "x", "partner")
    if scattered.count() <= BROADCAST_IDS:  # the others give no couples: less to shuffle
        several = several.join(F.broadcast(scattered), "doc", "left_semi")
    couples = written(_couples(several, cfg), "couples")
    first = couples.where("h is not null").select("doc", "x", "x2", *(F.first(c).over(by).alias(o) for c, o in (("doc", "partner"), ("x", "y"), ("x2", "y2")))).where("doc <> partner")
    both = couples.where("h is null").select("doc", "x", "x2", "partner", "y", "y2").unionByName(first)
    both = both.select("doc", "partner", F.inline(F.array(F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))))
    return found.where("doc <> partner").select("doc", "partner", "x", "y").unionByName(both), [seeds, heads, scattered, couples]


def _shared_runs(docs: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(doc, x) of minimizers whose run of least_words - span + 1 words may stand elsewhere too, and the table to drop. Each window of least_words words that
    stands in two documents begins at most span - 1 words before such an x in both."""
    span = min(cfg.window, cfg.least_words - cfg.k + 1)
    n = cfg.least_words - span + 1
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("last", pa.int64())])

    def run(batches):
        hs, ds, xs = [], [], []
        for batch in batches:
            for rows, raw, off in slices(batch):
                w = Words(raw, off, SPACED, lower=True)
                row, hashes = w.rows(), w.hashes()
                at = minimizers(windows(hashes, cfg.k), row, cfg.k, span)
                at = at[at + n <= len(row)]
                at = at[(row[at + n - 1] == row[at]) & (w.count[row[at]] >= cfg.least_words)]
                hs.append(windows(hashes, n)[at])
                ds.append(rows.column(0).to_numpy()[row[at]])
                xs.append((at - w.first[row[at]]).astype(np.int32))
        if not hs:
            return
        h, d, x = np.concatenate(hs), np.concatenate(ds), np.concatenate(xs)
        del hs, ds, xs
        order = np.lexsort((x, d, h))
        h, d, x = h[order], d[order], x[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        last = np.concatenate([np.flatnonzero(new)[1:], [len(h)]])[np.cumsum(new) - 1] - 1
        for a in range(0, len(h), 200_000):
            s = slice(a, a + 200_000)
            yield arrow_rows(schema, [pa.array(h[s].view(np.int64), mask=~new[s]), d[s], x[s], pa.array(d[last[s]], mask=~new[s])])

    runs = written(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").where("doc is not null and text is not null").mapInArrow(lean(run), "h long, doc long, x int, last long"), "runs")
    by = Window.partitionBy("h")
    heads = runs.where("h is not null").select("doc", "x", (F.min("doc").over(by) < F.max("last").over(by)).alias("shared")).where("shared")
    return runs.where("h is null").select("doc", "x").unionByName(heads.select("doc", "x")), runs


def _merged(d: np.ndarray, p: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple:
    """Overlapping or touching runs on one diagonal of a pair are one: d, p, x, y and the length of each."""
    order = np.lexsort((x, x - y, p, d))
    d, p, x, y, n = d[order], p[order], x[order], y[order], n[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (p[1:] != p[:-1]) | (x[1:] - y[1:] != x[:-1] - y[:-1]) | (x[1:] > x[:-1] + n[:-1])
    at = np.flatnonzero(new)
    end = np.maximum.reduceat(x + n, at) if len(at) else x
    return d[at], p[at], x[at], y[at], (end - x[at]).astype(np.int32)


#: Windows that are compared with each other before they are dealt.
BLOCK_WINDOWS = 1_000_000


def _windows(held: DataFrame, cfg: Config) -> DataFrame:
    """The first occurrence of each window in a block (h, doc, x and its others there in this document), and the runs that others share with it (doc, x, partner, y, n).
    held: doc, words, xs."""
    span, size = min(cfg.window, cfg.least_words - cfg.k + 1), cfg.least_words
    schema = pa.schema([("h", pa.int64()), ("doc", pa.int64()), ("x", pa.int32()), ("again", pa.list_(pa.int32())), ("partner", pa.int64()), ("y", pa.int32()), ("n", pa.int32())])

    def solved(parts):
        h, d, x = (np.concatenate(z) for z in zip(*parts))
        order = np.lexsort((x, d, h))
        h, d, x = h[order], d[order], x[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first, last = at[group], (np.concatenate([at[1:], [len(h)]]) - 1)[group]
        own = d == d[first]
        late, same = np.flatnonzero(~own), np.flatnonzero(own & ~new)
        told = same[d[last[same]] != d[same]]  # others of the first document: their partner is the last one
        a, b = np.concatenate([late, last[told]]), np.concatenate([first[late], told])
        rd, rp, rx, ry, rn = _merged(d[a], d[b], x[a], x[b], np.full(len(a), size, np.int32))
        for i in range(0, len(rd), 200_000):
            s = slice(i, i + 200_000)
            m = len(rd[s])
            yield arrow_rows(schema, [pa.nulls(m, pa.int64()), rd[s], rx[s], pa.nulls(m, pa.list_(pa.int32())), rp[s], ry[s], rn[s]])
        many = np.bincount(group[same], minlength=len(at))
        offsets = np.concatenate([[0], np.cumsum(many)])
        for i in range(0, len(at), 200_000):
            s = slice(i, i + 200_000)
            m = len(at[s])
            o = offsets[i : i + m + 1]
            again = pa.ListArray.from_arrays(pa.array((o - o[0]).astype(np.int32), mask=np.concatenate([many[s] == 0, [False]])), pa.array(x[same[o[0] : o[-1]]]))
            yield arrow_rows(schema, [h[at[s]].view(np.int64), d[at[s]], x[at[s]], again, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32())])

    def run(batches):
        parts, count = [], 0
        for batch in batches:
            for d, words, xs in zip(*(batch.column(c) for c in ("doc", "words", "xs"))):
                a = np.frombuffer(words.as_buffer(), "<u4").astype(np.uint64)
                h = windows(a, size)
                edge = np.zeros(len(a) + span + 1, np.int32)
                at = np.minimum(xs.values.to_numpy(), len(a))
                np.add.at(edge, np.maximum(at - span + 1, 0), 1)
                np.add.at(edge, at + 1, -1)
                at = np.flatnonzero(np.cumsum(edge)[: len(h)] > 0)
                parts.append((h[at], np.full(len(at), d.as_py(), np.int64), at.astype(np.int32)))
                count += len(at)
                if count >= BLOCK_WINDOWS:  # documents stay whole
                    yield from solved(parts)
                    parts, count = [], 0
        if count:
            yield from solved(parts)

    return held.mapInArrow(lean(run), "h long, doc long, x int, again array<int>, partner long, y int, n int")


def _exact(words: DataFrame, shared: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """The passages (as of passages()) that are equal word by word, cut anywhere, and the table to drop once they have been read. Every window of least_words words that stands in two
    documents is in one, in the role of the later document unless its own is the first."""
    found = written(_windows(words.join(shared.groupBy("doc").agg(F.collect_list("x").alias("xs")), "doc"), cfg), "windows")
    by = Window.partitionBy("h").orderBy("doc", "x")
    heads = found.where("h is not null").select("doc", "x", "again", *(F.first(c).over(by).alias(o) for c, o in (("doc", "partner"), ("x", "y"), ("again", "others"))), F.row_number().over(by).alias("nth")).where("doc <> partner")
    mine = F.expr("transform(coalesce(again, cast(array() as array<int>)), v -> named_struct('x', v, 'y', y))")
    theirs = F.expr("transform(if(nth = 2, coalesce(others, cast(array() as array<int>)), cast(array() as array<int>)), v -> named_struct('x', x, 'y', v))")
    every = heads.select("doc", "partner", F.inline(F.concat(F.array(F.struct("x", "y")), mine, theirs)))
    runs = found.where("h is null").select("doc", "partner", "x", "y", "n").unionByName(every.withColumn("n", F.lit(cfg.least_words)))
    schema = pa.schema([("doc", pa.int64()), ("partner", pa.int64()), *((c, pa.int32()) for c in ("begin", "end", "partner_begin", "partner_end", "matches"))])

    def run(batches):
        for batch in batches:
            d, p, x, y, n = _merged(*(batch.column(c).to_numpy() for c in ("doc", "partner", "x", "y", "n")))
            yield arrow_rows(schema, [d, p, x, x + n, y, y + n, n])

    dealt = runs.repartition("doc", "partner").sortWithinPartitions("doc", "partner", "x")
    return dealt.mapInArrow(lean(run), "doc long, partner long, begin int, end int, partner_begin int, partner_end int, matches int"), found


def chains_of(x: np.ndarray, y: np.ndarray, cfg: Config) -> list[np.ndarray]:
    """Best local chains of anchors sorted by x, then y, cut at gaps over max_gap: places of the anchors of each, in order; no anchor is in two."""
    n = len(x)
    if n < cfg.least_anchors:
        return []
    dx, dy = np.diff(x), np.diff(y)
    if (dx == dy).all() and (dx > 0).all() and (dx <= cfg.max_gap).all():
        return [np.arange(n)]
    ranks = np.searchsorted(np.unique(y), y) + 1
    size = int(ranks.max())
    value, holder = [-1e18] * (size + 1), [-1] * (size + 1)  # Fenwick tree of prefix maxima of score + gap_cost * (x + y)
    score, back = np.zeros(n), np.full(n, -1)
    k, c = cfg.k, cfg.gap_cost / 2
    i = 0
    while i < n:
        j = i
        while j < n and x[j] == x[i]:
            j += 1
        for a in range(i, j):  # anchors at the same x don't follow each other
            best, who, r = -1e18, -1, int(ranks[a]) - 1
            while r > 0:
                if value[r] > best:
                    best, who = value[r], holder[r]
                r -= r & -r
            score[a] = k
            if who >= 0:
                gx, gy = int(x[a] - x[who]), int(y[a] - y[who])
                gain = score[who] + min(k, gx, gy) - cfg.shift_cost * abs(gx - gy) - c * (gx + gy)
                if gain > k:
                    score[a], back[a] = gain, who
        for a in range(i, j):
            v, r = score[a] + c * (int(x[a]) + int(y[a])), int(ranks[a])
            while r <= size:
                if v > value[r]:
                    value[r], holder[r] = v, a
                r += r & -r
        i = j
    used, out = np.zeros(n, bool), []
    for a in np.argsort(-score, kind="stable"):
        path = []
        a = int(a)
        while a >= 0 and not used[a]:
            used[a] = True
            path.append(a)
            a = int(back[a])
        path = np.array(path[::-1], np.int64)
        if len(path) >= cfg.least_anchors:
            wide = np.maximum(np.diff(x[path]), np.diff(y[path])) > cfg.max_gap
            out += [p for p in np.split(path, np.flatnonzero(wide) + 1) if len(p) >= cfg.least_anchors]
    return out


def _chain(anchored: DataFrame, cfg: Config) -> DataFrame:
    """doc, partner and the anchors xs, ys of each chain that can be part of a passage."""
    schema = pa.schema([("doc", pa.int64()), ("partner", pa.int64()), ("xs", pa.list_(pa.int32())), ("ys", pa.list_(pa.int32()))])
    reach = 2 * (cfg.k + cfg.window - 2)

    def run(batches):
        held: list = []

        def solve(d, p, x, y):
            cut = np.flatnonzero((d[1:] != d[:-1]) | (p[1:] != p[:-1])) + 1
            out = []
            for a, b in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(d)]]).tolist()):
                if b - a >= cfg.least_anchors:
                    for c in chains_of(x[a:b], y[a:b], cfg):
                        xs, ys = x[a:b][c], y[a:b][c]
                        if max(xs[-1] - xs[0], ys[-1] - ys[0]) + cfg.k + reach >= cfg.least_words:
                            out.append((int(d[a]), int(p[a]), xs, ys))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), schema.types)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy() for k in ("doc", "partner", "x", "y")]
            new = np.ones(len(now[0]), bool)  # an anchor may have come by several seeds
            new[1:] = np.logical_or.reduce([z[1:] != z[:-1] for z in now])
            now = [z[new] for z in now]
            held = [np.concatenate(z) for z in zip(held, now)] if held else now
            d, p = held[0], held[1]
            end = int(np.flatnonzero((d != d[-1]) | (p != p[-1]))[-1]) + 1 if ((d != d[-1]) | (p != p[-1])).any() else 0
            if end:  # the last pair may go on in the next batch
                yield from solve(*(z[:end] for z in held))
                held = [z[end:] for z in held]
        if held:
            yield from solve(*held)

    dealt = anchored.repartition("doc", "partner").sortWithinPartitions("doc", "partner", "x", "y")
    return dealt.mapInArrow(lean(run), "doc long, partner long, xs array<int>, ys array<int>")


def _lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, np.int64)
    for v in a:
        hit = row[:-1] + (b == v)
        row[1:] = np.maximum.accumulate(np.maximum(hit, row[1:]))
    return int(row[-1])


def _reach(same: np.ndarray) -> tuple[int, int]:
    """How far an end can be moved along a diagonal, and the matches won: the furthest point where matches outweigh twice the mismatches most."""
    if not len(same):
        return 0, 0
    total = np.cumsum(np.where(same, 1, -2))
    best = len(total) - 1 - int(np.argmax(total[::-1]))
    if total[best] <= 0:
        return 0, 0
    return best + 1, int(same[: best + 1].sum())


def align(a: np.ndarray, b: np.ndarray, xs: np.ndarray, ys: np.ndarray, k: int) -> tuple[int, int, int, int, int]:
    """Begin and end in a, begin and end in b, and matches, of the passage around a chain. a, b: word hashes; xs, ys: places in them."""
    matches, x, y = k, int(xs[0]) + k, int(ys[0]) + k
    for u, v in zip(xs[1:].tolist(), ys[1:].tolist()):
        if u < x or v < y:  # the anchors overlap, on the same diagonal or nearly so
            over = max(x - u, y - v)
            new = max(0, k - over)
            matches += new
            x, y = u + k, v + k
            continue
        left, right = a[x:u], b[y:v]
        if len(left) == len(right) and (left == right).all():
            matches += len(left)
        elif len(left) and len(right):
            matches += _lcs(left, right)
        matches += k
        x, y = u + k, v + k
    n = min(len(a) - x, len(b) - y)
    go, won = _reach(a[x : x + n] == b[y : y + n])
    m = min(int(xs[0]), int(ys[0]))
    back, before = _reach((a[int(xs[0]) - m : int(xs[0])] == b[int(ys[0]) - m : int(ys[0])])[::-1])
    return int(xs[0]) - back, x + go, int(ys[0]) - back, y + go, matches + won + before


def _words(docs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc", pa.int64()), ("words", pa.binary())])

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                w = Words(raw, off, SPACED, lower=True)
                low = (w.hashes() >> np.uint64(32)).astype("<u4")
                yield arrow_rows(schema, [rows.column(0), pa.array([low[w.first[i] : w.first[i + 1]].tobytes() for i in range(rows.num_rows)], pa.binary())])

    return docs.mapInArrow(lean(run), "doc long, words binary")


def passages(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """doc, partner (partner < doc), begin, end, partner_begin, partner_end (in words) and matches of each passage."""
    anchored, seeds = anchors(docs, cfg)
    chains = written(_chain(anchored, cfg), "chains")
    dropped(*seeds)
    shared, runs = _shared_runs(docs, cfg)
    places = written(shared, "places")
    dropped(runs)
    ids = written(chains.select("doc").unionByName(chains.select(F.col("partner").alias("doc"))).unionByName(places.select("doc")).distinct(), "ids")
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    words = written(_words(docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc", "left_semi")).groupBy("doc").agg(F.max("words").alias("words")), "words")
    lo = lambda c: F.greatest(F.lit(0), F.col(c)[0] - cfg.pad)
    near = lambda c: F.expr(f"substring(words, 4 * from_ + 1, 4 * (element_at({c}, -1) + {cfg.k + cfg.pad} - from_))")
    left = chains.join(words, "doc").withColumn("from_", lo("xs")).select("doc", "partner", "xs", "ys", F.col("from_").alias("from_x"), near("xs").alias("a"))
    both = left.join(words.withColumnRenamed("doc", "partner"), "partner").withColumn("from_", lo("ys")).select("doc", "partner", "xs", "ys", "from_x", F.col("from_").alias("from_y"), "a", near("ys").alias("b"))
    schema = pa.schema([("doc", pa.int64()), ("partner", pa.int64()), *((c, pa.int32()) for c in ("begin", "end", "partner_begin", "partner_end", "matches"))])

    def run(batches):
        for batch in batches:
            out = []
            for d, p, xs, ys, fx, fy, a, b in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
                xs, ys, a, b = np.array(xs) - fx, np.array(ys) - fy, np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                if xs[-1] + cfg.k > len(a) or ys[-1] + cfg.k > len(b):  # anchors of another text with this doc_id
                    continue
                u, v, r, s, matches = align(a, b, xs, ys, cfg.k)
                if min(v - u, s - r) >= cfg.least_words and 100 * matches >= cfg.percent * max(v - u, s - r):
                    out.append((d, p, u + fx, v + fx, r + fy, s + fy, matches))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [()] * 7, schema.types)], schema=schema)

    exact, held = _exact(words, places, cfg)
    exact = written(exact, "exact")
    dropped(places, held)
    found = written(both.mapInArrow(lean(run), T.StructType([T.StructField("doc", T.LongType()), T.StructField("partner", T.LongType()), *(T.StructField(c, T.IntegerType()) for c in ("begin", "end", "partner_begin", "partner_end", "matches"))])).unionByName(exact), "passages")
    dropped(chains, ids, words, exact)
    return found


def _united(spans: DataFrame) -> DataFrame:
    """doc and its spans, united where they meet: spans: array of begin, end. A document's distinct spans are bounded by its length."""
    by = Window.partitionBy("doc").orderBy("begin", "end")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    isle = F.sum(F.when(F.col("begin") > F.coalesce(reach, F.lit(-1)), 1).otherwise(0)).over(by)
    whole = spans.select("doc", "begin", "end").distinct().withColumn("isle", isle).groupBy("doc", "isle").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return whole.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def _covered(spans: str):
    return F.aggregate(spans, F.lit(0), lambda a, s: a + s["end"] - s["begin"]).cast("long")


def repeated(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each document with a passage that stands in another one too: doc_id, n_repeated_words, spans (of passages in either
    role), n_removed_words and removed (spans whose source is an earlier document)."""
    found = passages(docs, cfg)
    late = found.select("doc", "begin", "end")
    every = _united(late.unionByName(found.select(F.col("partner").alias("doc"), F.col("partner_begin").alias("begin"), F.col("partner_end").alias("end"))))
    gone = _united(late).withColumnRenamed("spans", "removed")
    out = every.join(gone, "doc", "left")
    return out.select(F.col("doc").alias("doc_id"), _covered("spans").alias("n_repeated_words"), "spans", F.coalesce(_covered("removed"), F.lit(0).cast("long")).alias("n_removed_words"), "removed")


def deduplicated(docs: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs without the repetitions: each removed span becomes one space; documents of which no word is left go. Other texts stay as they are."""
    names = docs.columns
    key, spans_of = (free_name(names, n) for n in ("doc_key__", "removed__"))
    gone = written(_united(passages(docs, cfg).select("doc", "begin", "end")).select(F.col("doc").alias(key), F.col("spans").alias(spans_of)), "removed")
    small = F.broadcast(gone) if gone.count() <= BROADCAST_IDS // 10 else gone
    joined = docs.join(small, F.col("doc_id").cast("long") == F.col(key), "left").select(*[docs[c] for c in names], spans_of)

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                spans = rows.column(spans_of).to_pylist()
                text, keep = rows.column("text"), np.ones(rows.num_rows, bool)
                if any(spans):
                    w = Words(raw, off, SPACED)
                    new = text.to_pylist()
                    for i, s in enumerate(spans):
                        if s and new[i]:
                            a, n, at, parts = int(w.first[i]), int(w.count[i]), int(off[i]), []
                            left = n
                            for x in s:
                                begin, end = min(x["begin"], n), min(x["end"], n)
                                if begin < end:
                                    parts.append(raw[at : w.start[a + begin]].tobytes())
                                    at = int(w.end[a + end - 1])
                                    left -= end - begin
                            new[i] = b" ".join([*parts, raw[at : off[i + 1]].tobytes()]).decode() if parts else new[i]
                            keep[i] = left > 0
                    text = pa.array(new, text.type)
                out = pa.RecordBatch.from_arrays([text if k == "text" else rows.column(k) for k in names], names=names)
                yield out.filter(pa.array(keep)) if not keep.all() else out

    return joined.mapInArrow(lean(run), docs.schema)
