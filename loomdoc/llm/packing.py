"""Packing of token sequences by non-negative least squares over the histogram of lengths.

1. Each document's ids (with the end id) are cut into full windows and a tail of 1 to window - 1 ids. Full windows are
   sequences as they are. The tail's ids are kept until its place is known.
2. The tails' histogram (at most window - 1 counts) goes to the driver. All combinations of two or three lengths that fill
   a window exactly are enumerated, and repeat counts x >= 0 that minimise |Ax - histogram| are found by accelerated
   projected gradient; they are rounded down to whole counts that the histogram can serve.
3. What no combination took is packed greedily, longest first: each tail begins where the last one ended and is cut at the
   window's end. Only the last sequence can be short.
4. The n-th tail of a length gets the n-th place of that length. Its number is its rank within its input partition
   plus the tails of that length in the partitions before, a running sum over a table of counts; so are the full windows before each partition, by two steps.

Null and empty texts have one id, the end id; long texts are cut into as many windows as they take. Rows are never merged; rows without doc_id and repeated
rows are packed too. Tails of one length are all alike, so that ties need no rule beyond the order of rows in their partition. An empty table gives no rows.
Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import dropped, written
from .kernels import arrow_rows, lean, slices
from .pieces import byte_level

#: The table of counts is broadcast up to this many rows (32 bytes each), and joined by shuffle beyond.
BROADCAST_COUNTS = 200_000
#: Input partitions whose windows are summed in one group; the groups' sums are then summed in their order.
PARTS = 1024


@dataclass(frozen=True)
class Config:
    tokenizer: str
    window: int = 1024
    end_id: int = 0
    steps: int = 300


def encoded(docs: DataFrame, cfg: Config) -> DataFrame:
    """doc_id, part (input partition), n_tokens, full (crc32 of each full window), full_before (full windows before it in its
    part), tail (ids of the rest), tail_len, rank (among its part's tails of that length)."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int64()), ("n_tokens", pa.int64()), ("full", pa.list_(pa.int64())), ("full_before", pa.int64()), ("tail", pa.binary()), ("tail_len", pa.int32()), ("rank", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        encoder, part, w = byte_level(cfg.tokenizer), TaskContext.get().partitionId(), cfg.window
        seen, windows = np.zeros(w, np.int64), 0
        for batch in batches:
            for rows, _, _ in slices(batch):
                ids, off = encoder.encode([t or "" for t in rows.column("text").to_pylist()])
                ids = np.insert(ids, off[1:], cfg.end_id).astype("<u4")
                off = off + np.arange(len(off))
                n = np.diff(off)
                full, tail = n // w, n % w
                raw = memoryview(ids.tobytes())
                crcs = [[zlib.crc32(raw[4 * p : 4 * (p + w)]) for p in range(off[i], off[i] + full[i] * w, w)] for i in range(len(n))]
                small = ids.astype(encoder.dtype)
                tails = [small[off[i + 1] - tail[i] : off[i + 1]].tobytes() for i in range(len(n))]
                order = np.argsort(tail, kind="stable")
                begin = np.searchsorted(tail[order], tail[order])
                rank = np.empty(len(n), np.int64)
                rank[order] = seen[tail[order]] + np.arange(len(n)) - begin
                seen += np.bincount(tail, minlength=w)
                before = windows + np.cumsum(full) - full
                windows += int(full.sum())
                yield arrow_rows(schema, [rows.column("doc_id"), np.full(len(n), part), n, pa.array(crcs, pa.list_(pa.int64())), before, pa.array(tails, pa.binary()), tail.astype(np.int32), rank])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, part long, n_tokens long, full array<long>, full_before long, tail binary, tail_len int, rank long")


def combinations(window: int) -> np.ndarray:
    """All multisets of two or three positive lengths with the sum window; 0 where there are two."""
    a = np.arange(1, window // 2 + 1)
    pairs = np.stack([a, window - a, np.zeros_like(a)], 1)
    triples = [np.stack([np.full(n, a), b, window - a - b], 1) for a in range(1, window // 3 + 1) if (n := len(b := np.arange(a, (window - a) // 2 + 1)))]
    return np.concatenate([pairs, *triples])


def solve(combos: np.ndarray, histogram: np.ndarray, steps: int) -> np.ndarray:
    """x >= 0 with small |Ax - histogram|, where column j of A counts the lengths of combination j."""
    size = len(histogram)
    cols = combos.ravel()
    live = cols > 0
    which = np.repeat(np.arange(len(combos)), combos.shape[1])[live]
    cols = cols[live]
    up = lambda x: np.bincount(cols, weights=x[which], minlength=size)
    down = lambda y: np.bincount(which, weights=y[cols], minlength=len(combos))
    v = np.ones(len(combos))
    for _ in range(20):
        v = down(up(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = z = np.zeros(len(combos))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, z - down(up(z) - histogram) / (1.02 * norm))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def rounded(combos: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that the histogram can serve, largest first."""
    left, out = histogram.astype(np.int64).copy(), []
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        lengths, need = np.unique(combos[j][combos[j] > 0], return_counts=True)
        n = min(int(np.rint(x[j])), int((left[lengths] // need).min()))
        if n > 0:
            left[lengths] -= n * need
            out.append((tuple(int(v) for v in combos[j] if v), n))
    return out


@dataclass(frozen=True)
class Plan:
    """Places by length: the tails of length l and rank r with r < taken[l] stand in run k of that length, the last with low <= r."""

    starts: np.ndarray  # runs of length l: starts[l] : starts[l + 1]
    low: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    taken: np.ndarray
    base: np.ndarray  # where the rest of each length begins in the greedy stream
    first_rest: int
    sequences: int


def plan(histogram: np.ndarray, cfg: Config) -> Plan:
    w = cfg.window
    combos = combinations(w)
    usable = (histogram[combos] > 0).all(1) | ((combos == 0) | (histogram[combos] > 0)).all(1)
    combos = combos[usable]
    chosen = rounded(combos, solve(combos, histogram, cfg.steps), histogram) if len(combos) else []
    taken, sequence, runs = np.zeros(w, np.int64), 0, []
    for lengths, n in chosen:
        at = 0
        for length in lengths:
            runs.append((length, int(taken[length]), sequence, at))
            taken[length] += n
            at += length
        sequence += n
    runs = np.array(sorted(runs), np.int64).reshape(-1, 4)
    rest = (histogram - taken) * np.arange(w)
    base = np.concatenate([np.cumsum(rest[::-1])[::-1][1:], [0]])
    return Plan(np.searchsorted(runs[:, 0], np.arange(w + 1)), runs[:, 1], runs[:, 2], runs[:, 3], taken, base, sequence, sequence + -(-int(rest.sum()) // w))


def pack(docs: DataFrame, cfg: Config) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark, w = docs.sparkSession, cfg.window
    rows = written(encoded(docs, cfg), "encoded")
    histogram = np.zeros(w, np.int64)
    for r in rows.where("tail_len > 0").groupBy("tail_len").count().collect():  # at most window - 1 rows
        histogram[r[0]] = r[1]
    found = plan(histogram, cfg)
    counts = written(rows.groupBy("part", "tail_len").agg(F.count("*").alias("n"), F.sum(F.size("full")).alias("full_n")), "counts")
    in_order = lambda *by: Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "tail_len", F.coalesce(F.sum("n").over(in_order("tail_len")), F.lit(0)).alias("before"))
    # windows before each part: within its group of PARTS parts, and in the groups before (one row for each group)
    sums = counts.groupBy("part").agg(F.sum("full_n").alias("n")).withColumn("band", F.floor(F.col("part") / PARTS))
    bands = sums.groupBy("band").agg(F.sum("n").alias("all")).select("band", F.coalesce(F.sum("all").over(Window.orderBy("band").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    windows = sums.join(bands, "band").select("part", (F.col("base") + F.coalesce(F.sum("n").over(in_order("band")), F.lit(0))).alias("windows"))
    total = counts.agg(F.coalesce(F.sum("full_n"), F.lit(0))).first()[0]
    before = before.join(windows, "part")
    before = written(before, "before")
    dropped(counts)
    joined = rows.join(F.broadcast(before) if before.count() <= BROADCAST_COUNTS else before, ["part", "tail_len"])
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
    shared = spark.sparkContext.broadcast((found, total))

    def run(batches):
        p, base_sequence = shared.value
        width = np.dtype(byte_level(cfg.tokenizer).dtype)
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            n, length, rank = get("n_tokens"), get("tail_len").astype(np.int64), get("rank") + get("before")
            lists = batch.column("full")
            count = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
            doc, each = np.repeat(np.arange(len(n)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            out = [[doc, each * w, np.full(len(doc), w), lists.flatten().to_numpy(zero_copy_only=False), (get("windows") + get("full_before"))[doc] + each, np.zeros(len(doc), np.int64)]]
            planned = np.flatnonzero((length > 0) & (rank < p.taken[length]))
            # the run of each: the last of its length with low <= rank
            lo, hi = p.starts[length[planned]], p.starts[length[planned] + 1]
            while (hi - lo > 1).any():
                mid = (lo + hi) // 2
                go = (hi - lo > 1) & (p.low[np.minimum(mid, len(p.low) - 1)] <= rank[planned])
                lo, hi = np.where(go, mid, lo), np.where(go | (hi - lo <= 1), hi, mid)
            tails = batch.column("tail").to_pylist()
            crc = lambda i, a, b: zlib.crc32(np.frombuffer(tails[i], width)[a:b].astype("<u4").tobytes())  # noqa: E731, B023
            if len(planned):
                out.append([planned, (n - length)[planned], length[planned], np.array([crc(i, 0, None) for i in planned.tolist()], np.int64), base_sequence + p.sequence[lo] + rank[planned] - p.low[lo], p.offset[lo]])
            rest = np.flatnonzero((length > 0) & (rank >= p.taken[length]))
            place = p.base[length[rest]] + (rank[rest] - p.taken[length[rest]]) * length[rest]
            fits = np.minimum(length[rest], w - place % w)
            for a, b in ((np.zeros_like(fits), fits), (fits, length[rest])):
                ok = b > a
                i, a, b, at = rest[ok], a[ok], b[ok], (place + a)[ok]
                if len(i):
                    out.append([i, (n - length)[i] + a, b - a, np.array([crc(x, y, z) for x, y, z in zip(i.tolist(), a.tolist(), b.tolist())], np.int64), base_sequence + p.first_rest + at // w, at % w])
            doc, start, size, sums, sequence, offset = (np.concatenate(x) for x in zip(*out))
            yield arrow_rows(schema, [batch.column("doc_id").take(pa.array(doc)), start, size, sums, n[doc], sequence, offset])

    return joined.mapInArrow(lean(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
