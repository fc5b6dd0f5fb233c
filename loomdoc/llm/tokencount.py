"""Token counts by a two-tier lookup on the map side: no pre-token is ever shuffled by its key.

Tier 1 is a table of frequent pre-tokens and their numbers of tokens, broadcast as sorted hashes; it has at most
`frequent` entries. It comes from one pass over all texts: each task counts its own pre-tokens (those that a slice of text holds twice at least, and
the `held` most frequent ones so far), and sends its `per_task` most frequent ones, which are summed. These counts decide only what the table holds, and
so the speed: tier 2, a bounded cache in each worker, encodes whatever tier 1 does not have with the library itself.

Pre-tokens are known by 64-bit hashes of their code points. Two different ones with one hash, which for n pre-tokens happens with a probability of n ^ 2 / 2 ^ 65
(1e-8 for a million), would get one number of tokens; nothing checks this.

A null text counts as empty: 0 bytes, 0 tokens. Long texts are counted whole. Rows without doc_id and repeated rows are counted as any other; ties between
equally frequent pre-tokens change the speed only. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import arrow_rows, lean, slices
from .pieces import piece_counter, points, space_segments, span_hashes


@dataclass(frozen=True)
class Config:
    model: str
    limit: int = 4096
    frequent: int = 1 << 16
    per_task: int = 1 << 12
    held: int = 1 << 18


def frequent_lengths(docs: DataFrame, cfg: Config) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the most frequent pre-tokens and their numbers of tokens."""
    schema = pa.schema([("h", pa.int64()), ("n", pa.int64()), ("tokens", pa.int32())])

    def run(batches):
        counter = piece_counter(cfg.model)
        keys, counts, names = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

        def trim(most):
            nonlocal keys, counts, names
            if len(keys) > most:
                best = np.sort(np.argpartition(-counts, most)[:most])
                keys, counts, names = keys[best], counts[best], names[best]

        for batch in batches:
            for rows, _, _ in slices(batch):
                joined, cps, off = points([t or "" for t in rows.column("text").to_pylist()])
                cps, _, start, end = space_segments(cps, off)
                h = span_hashes(cps, start, end)
                some = np.flatnonzero(end - start > 0)
                own, first, n = np.unique(h[some], return_index=True, return_counts=True)
                at = np.minimum(np.searchsorted(keys, own), max(len(keys) - 1, 0))
                old = keys[at] == own if len(keys) else np.zeros(len(own), bool)
                counts[at[old]] += n[old]
                new = ~old & (n > 1)
                p = some[first[new]]
                keys, counts, names = np.concatenate([keys, own[new]]), np.concatenate([counts, n[new]]), np.concatenate([names, np.array([joined[a:b] for a, b in zip(start[p].tolist(), end[p].tolist())] + [None], object)[:-1]])
                order = np.argsort(keys)
                keys, counts, names = keys[order], counts[order], names[order]
                trim(cfg.held)
        trim(cfg.per_task)
        yield arrow_rows(schema, [keys.view(np.int64), counts, np.array(counter.lengths(names.tolist()), np.int32)])

    table = docs.select("text").mapInArrow(lean(run), "h long, n long, tokens int").groupBy("h", "tokens").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(cfg.frequent).select("h", "tokens").toArrow()
    keys = table["h"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table["tokens"].to_numpy()[order].astype(np.int32)


def token_counts(docs: DataFrame, cfg: Config) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_tokens, over_limit."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, cfg))

    def run(batches):
        counter = piece_counter(cfg.model)
        keys, sizes = shared.value
        for batch in batches:
            for rows, _, off in slices(batch):
                n = counter.count([t or "" for t in rows.column("text").to_pylist()], keys, sizes)
                yield arrow_rows(schema, [rows.column("doc_id"), np.diff(off), n])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_bytes long, n_tokens long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > cfg.limit).alias("over_limit"))
