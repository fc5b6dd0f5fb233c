"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z. A window is `words` consecutive words of a
benchmark item; an item of fewer words, but not none, is one window. Spark makes the table of distinct windows with the items of each. It goes out
as sorted arrays of hashes, with the windows' words and items beside them; workers roll the same hashes over whole texts, look them up and confirm
each hit on the words themselves.

What is broadcast is bounded by its bytes: a table of more than `block_bytes` is cut by hash into blocks of about that size (the items of one window
stay together). The driver holds one block at a time; the documents pass through one scan after the other, are written between them, and each scan
adds its hits. Nothing is shuffled but the benchmark.

Null and empty texts have no words; long texts are read whole. Items without words have no windows. Items that share an item_id count as
one; windows of items without item_id mark words but no item. Rows without doc_id and repeated rows are scanned each. Empty documents give no rows,
an empty benchmark no hits. Extra columns of both inputs are kept or ignored; columns of the documents that are called as those of report() don't clash.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.scratch import dropped, written
from .kernels import ALNUM, Words, arrow_rows, lean, slices, windows


@dataclass(frozen=True)
class Config:
    words: int = 10
    block_bytes: int = 32 << 20
    drop_percent: int = 50


def item_windows(benchmark: DataFrame, cfg: Config) -> DataFrame:
    """n (number of words), h, words (joined by spaces) and items (sorted strings) of each distinct window."""
    schema = pa.schema([("n", pa.int32()), ("h", pa.int64()), ("words", pa.binary()), ("item", pa.string())])

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                w = Words(raw, off, ALNUM, lower=True)
                h = w.hashes()
                out = []
                for i, item in enumerate(rows.column(0).to_pylist()):
                    a, n = int(w.first[i]), int(w.count[i])
                    size = min(cfg.words, n)
                    if size:
                        words = [w.raw[s:e].tobytes() for s, e in zip(w.start[a : a + n].tolist(), w.end[a : a + n].tolist())]
                        out += [(size, v, b" ".join(words[j : j + size]), item) for j, v in enumerate(windows(h[a : a + n], size).view(np.int64).tolist())]
                yield arrow_rows(schema, [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 4, schema.types)])

    found = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").mapInArrow(lean(run), "n int, h long, words binary, item string")
    return found.groupBy("n", "h", "words").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _block(part: DataFrame) -> dict[int, tuple]:
    """{length: (sorted hashes, words and items of each)}."""
    table = part.toArrow().combine_chunks()
    n, h = table["n"].to_numpy(), table["h"].to_numpy().view(np.uint64)
    out = {}
    for size in np.unique(n).tolist():
        mine = np.flatnonzero(n == size)
        mine = mine[np.argsort(h[mine], kind="stable")]
        take = lambda c: table[c].combine_chunks().take(pa.array(mine))  # noqa: E731, B023
        out[size] = (h[mine], take("words"), take("items"))
    return out


def _scan(raw, off, block: dict) -> tuple[Words, np.ndarray, dict[int, set]]:
    """The words, which of them are hit, and the items of each row."""
    w = Words(raw, off, ALNUM, lower=True)
    h = w.hashes()
    edge = np.zeros(len(h) + 1, np.int64)
    items: dict[int, set] = defaultdict(set)
    rows = w.rows()
    for n, (keys, words, lists) in block.items():
        win = windows(h, n)
        sieve = np.zeros(1 << 16, bool)
        sieve[keys >> np.uint64(48)] = True
        some = np.flatnonzero(sieve[win >> np.uint64(48)])
        some = some[rows[some] == rows[some + n - 1]]
        at = np.minimum(np.searchsorted(keys, win[some]), len(keys) - 1)
        hit = keys[at] == win[some]
        held: dict[int, tuple] = {}  # words and items of the entries that this slice met
        for p, k in zip(some[hit].tolist(), at[hit].tolist()):
            mine = b" ".join(w.raw[w.start[x] : w.end[x]].tobytes() for x in range(p, p + n))
            key = keys[k]
            while k < len(keys) and keys[k] == key:  # different windows with one hash stand side by side
                if k not in held:
                    held[k] = (words[k].as_py(), lists[k].as_py())
                if held[k][0] == mine:
                    edge[p] += 1
                    edge[p + n] -= 1
                    items[int(rows[p])].update(held[k][1])
                    break
                k += 1
    return w, np.cumsum(edge[:-1]) > 0, items


def scan(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config(), then=None) -> DataFrame:
    """docs with n_words, spans (array of [begin, end) in words, ascending, apart) and items (sorted strings); or, with
    then, what it makes of each batch of these, with the columns of docs."""
    mark = "" if then is None else "found__"  # then keeps columns of docs that are called alike
    own = {f"{mark}n_words": T.LongType(), f"{mark}spans": T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]), False), f"{mark}items": T.ArrayType(T.StringType(), False)}
    keep = [f for f in docs.schema if f.name not in own]
    out = docs.select(*[F.col(f"`{f.name}`") for f in keep])
    spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    table = written(item_windows(benchmark, cfg), "windows")
    weight = F.length("words") + 24 + F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.length(x) + 8)
    blocks = max(1, -(-(table.agg(F.sum(weight)).first()[0] or 0) // cfg.block_bytes))
    between = None
    for n in range(blocks):
        last = then if n == blocks - 1 else None
        shared = docs.sparkSession.sparkContext.broadcast(_block(table.where(F.pmod("h", F.lit(blocks)) == n)))

        def run(batches, shared=shared, again=n > 0, last=last):
            for batch in batches:
                for rows, raw, off in slices(batch):
                    w, hit, items = _scan(raw, off, shared.value)
                    before = rows.select(list(own)).to_pylist() if again else None
                    all_spans, all_items = [], []
                    for i in range(rows.num_rows):
                        own_hit = hit[w.first[i] : w.first[i + 1]]
                        found = items.get(i, set())
                        if again and before[i][mark + "spans"]:
                            own_hit = own_hit.copy()
                            for s in before[i][mark + "spans"]:
                                own_hit[s["begin"] : s["end"]] = True
                        if again:
                            found = found | set(before[i][mark + "items"])
                        if own_hit.any():
                            step = np.diff(np.concatenate([[0], own_hit.astype(np.int8), [0]]))
                            all_spans.append([{"begin": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))])
                        else:
                            all_spans.append([])
                        all_items.append(sorted(found))
                    cols = [rows.column(f.name) for f in keep] + [pa.array(w.count.astype(np.int64)), pa.array(all_spans, spans_type), pa.array(all_items, pa.list_(pa.string()))]
                    found = pa.RecordBatch.from_arrays(cols, names=[f.name for f in keep] + list(own))
                    yield found if last is None else last(found)

        out = out.mapInArrow(lean(run), docs.schema if last is not None else T.StructType(keep + [T.StructField(k, t) for k, t in own.items()]))
        if n < blocks - 1:
            out = written(out, "scanned")
            shared.unpersist()
            if between is not None:
                dropped(between)
            between = out
    dropped(table)
    return out


def report(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """One row for each document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    out = scan(docs.select("doc_id", "text"), benchmark, cfg)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["begin"])
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def cleaned(docs: DataFrame, benchmark: DataFrame, cfg: Config = Config()) -> DataFrame:
    """docs without the hit spans (each becomes one space), and without documents of which at least drop_percent of the words are hit. Texts without hits stay as they are."""
    names = docs.columns

    def cut(batch):
        spans, n_words = batch.column("found__spans").to_pylist(), batch.column("found__n_words").to_pylist()
        text, keep = batch.column("text"), np.ones(batch.num_rows, bool)
        if any(spans):
            new = text.to_pylist()
            for i, s in enumerate(spans):
                if s:
                    keep[i] = 100 * sum(x["end"] - x["begin"] for x in s) < cfg.drop_percent * n_words[i]
                    raw = np.frombuffer(new[i].encode(), np.uint8)
                    w, at, parts = Words(raw, np.array([0, len(raw)]), ALNUM, lower=True), 0, []
                    for x in s:
                        parts.append(raw[at : w.start[x["begin"]]].tobytes())
                        at = w.end[x["end"] - 1]
                    new[i] = b" ".join([*parts, raw[at:].tobytes()]).decode()
            text = pa.array(new, text.type)
        out = pa.RecordBatch.from_arrays([text if k == "text" else batch.column(k) for k in names], names=names)
        return out if keep.all() else out.filter(pa.array(keep))

    return scan(docs, benchmark, cfg, cut)


def oracle(words: int = 10) -> str:
    up, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    ws = f"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    return f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {ws} AS ws FROM documents),
b AS (SELECT item_id, {ws} AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), {words}) AS l, array_to_string(ws[i : i + least(len(ws), {words}) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {words - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (SELECT r, l, i, array_to_string(ws[i : i + l - 1], ' ') AS win FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS i FROM w, lens WHERE len(ws) >= l)),
hits AS (SELECT r, dw.l, i, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS p FROM (SELECT DISTINCT r, i, l FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN its USING (r)"""
