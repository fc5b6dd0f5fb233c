"""Toxicity scores by non-negative positive-unlabelled (nnPU) learning.

Positives are confirmed toxic rows of the labels. Unlabelled text is a sample of the documents themselves, labelled or not, whose labels nobody
looks at. The class prior pi is the share of toxic rows among the labelled ones that may be read. The linear model is fitted by numpy on the risk

    pi * E_P[l(z)] + max(0, E_U[l(-z)] - pi * E_P[l(-z)]),     l(z) = log(1 + exp(-z)),

following the step of Kiryo et al. (2017): where the corrected negative part falls below zero, the gradient
goes against it instead. Features are the presence of whole words and of words' beginnings (`PREFIXES` bytes), all
as 64-bit hashes of the whole text. Their numbers of positive and of unlabelled documents are counted in Spark, and the model takes those that
tell the two most surely (z statistic of `least_z` at least).

Bounds, which are parameters: `max_positive` confirmed rows and `max_unlabelled` documents are used for fitting (those
with the least hash of doc_id), and the model has `max_features` weights. Every row is scored.

Rows with crc32(doc_id as text) mod 5 = 0 take no part in fitting, neither with their labels nor as unlabelled text.
Null and empty texts have no features and get the score of the intercept; long texts are read whole, one at a time if need be. Without a confirmed positive
every score is 0 (to 17 places). An empty table of documents gives no rows. Rows without doc_id are scored
too. A doc_id that is labelled twice counts once; it is positive if any of its labels is 1. Repeated rows are scored each; they weigh in fitting as
often as they stand in the documents. Extra columns of both inputs are ignored, whatever their names; rejecting() keeps those of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import dropped, written
from .kernels import ALNUM, Words, arrow_rows, lean, mix, slices

PREFIXES = (4, 5, 6, 7, 8, 10)


@dataclass(frozen=True)
class Config:
    max_positive: int = 3000
    max_unlabelled: int = 9000
    max_features: int = 4096
    least_documents: int = 5
    least_z: float = 4.0
    folds: int = 5
    steps: int = 400
    rate: float = 0.05
    decay: float = 1e-4


@dataclass(frozen=True)
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    intercept: float
    prior: float


def _features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), with repetitions."""
    rows = w.rows()
    out_rows, out = [rows], [w.hashes()]
    for n in PREFIXES:
        long = (w.end - w.start) > n
        out_rows.append(rows[long])
        out.append(mix(w.spans(w.start[long], w.start[long] + n) + np.uint64(n)))
    return np.concatenate(out_rows), np.concatenate(out)


def _present(raw, off, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash), or with keep (sorted) distinct (row, index in keep)."""
    w = Words(raw, off, ALNUM, lower=True)
    rows, h = _features(w)
    if keep is None:
        order = np.lexsort((h, rows))
        rows, h = rows[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
        return rows[new], h[new]
    if not len(keep):
        return rows[:0], np.zeros(0, np.int64)
    sieve = np.zeros(1 << 16, bool)
    sieve[keep >> np.uint64(48)] = True
    some = np.flatnonzero(sieve[h >> np.uint64(48)])
    at = np.minimum(np.searchsorted(keep, h[some]), len(keep) - 1)
    hit = keep[at] == h[some]
    code = np.unique(rows[some[hit]].astype(np.int64) * len(keep) + at[hit])
    return code // len(keep), code % len(keep)


def _open(doc_id, cfg: Config):
    """Whether a document may be used for fitting."""
    return doc_id.isNotNull() & (F.crc32(doc_id.cast("string")) % cfg.folds != 0)


def train_rows(labels: DataFrame, cfg: Config) -> DataFrame:
    """doc_id and toxic (0/1) of the rows whose labels may be read."""
    found = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    return found.where(_open(F.col("doc_id"), cfg) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _sample(docs: DataFrame, labels: DataFrame, cfg: Config) -> tuple[DataFrame, float]:
    """(p, u, text) of the documents for fitting, and the class prior."""
    known = written(train_rows(labels, cfg), "known")
    n, positive = known.agg(F.count("*"), F.count_if(F.col("toxic") == 1)).first()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    least = lambda rows, most: rows.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    p = least(known.where("toxic = 1"), cfg.max_positive).select("doc_id", F.lit(True).alias("p"), F.lit(False).alias("q"))
    u = least(named.where(_open(F.col("doc_id"), cfg)), cfg.max_unlabelled).select("doc_id", F.lit(False).alias("p"), F.lit(True).alias("q"))
    ids = p.unionByName(u).groupBy("doc_id").agg(F.max("p").alias("p"), F.max("q").alias("u"))  # max_positive + max_unlabelled rows at most
    out = written(named.join(F.broadcast(ids), "doc_id").select("p", "u", "text"), "sample")
    dropped(known)
    return out, positive / n if n else 0.0


def _count(sample: DataFrame) -> DataFrame:
    """h and its numbers of positive and of unlabelled documents."""
    schema = pa.schema([("h", pa.int64()), ("p", pa.int64()), ("u", pa.int64())])

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                p, u = (np.asarray(rows.column(k).to_numpy(zero_copy_only=False), np.int64) for k in (0, 1))
                at, h = _present(raw, off, None)
                values, inverse = np.unique(h, return_inverse=True)
                yield arrow_rows(schema, [values.view(np.int64), *(np.bincount(inverse, weights=x[at], minlength=len(values)).astype(np.int64) for x in (p, u))])

    return sample.mapInArrow(lean(run), "h long, p long, u long").groupBy("h").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def _matrix(sample: DataFrame, keep: np.ndarray):
    schema = pa.schema([("p", pa.bool_()), ("u", pa.bool_()), ("at", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                at, j = _present(raw, off, keep)
                ends = np.searchsorted(at, np.arange(rows.num_rows + 1))
                yield arrow_rows(schema, [rows.column(0), rows.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(j, pa.int32()))])

    table = sample.mapInArrow(lean(run), "p boolean, u boolean, at array<int>").toArrow().combine_chunks()
    lists = table["at"].combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int32()))
    lens = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return table["p"].to_numpy().astype(bool), table["u"].to_numpy().astype(bool), np.repeat(np.arange(len(lens)), lens), lists.flatten().to_numpy(zero_copy_only=False)


def risk_parts(p, u, rows, cols, w: np.ndarray, b: float, prior: float) -> tuple[float, float, np.ndarray]:
    """The positive part of the risk, the corrected negative part, and the slope of each document's z in the step's direction: of their sum, or, where the
    negative part is below zero, of that part turned round."""
    wp, wu = p / max(1, p.sum()), u / max(1, u.sum())
    z = np.bincount(rows, weights=w[cols], minlength=len(p)) + b
    s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))  # the slope of l(-z); that of l(z) is s - 1
    plus, minus = float(prior * wp @ np.logaddexp(0, -z)), float((wu - prior * wp) @ np.logaddexp(0, z))
    slope = (wu - prior * wp) * s
    return plus, minus, prior * wp * (s - 1) + slope if minus >= 0 else -slope


def _fit(p, u, rows, cols, n_features: int, prior: float, cfg: Config) -> tuple[np.ndarray, float]:
    w, b = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for step in range(1, cfg.steps + 1):
        g = risk_parts(p, u, rows, cols, w, b, prior)[2]
        gw, gb = np.bincount(cols, weights=g[rows], minlength=n_features) + cfg.decay * w, float(g.sum())
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.99**step
        w -= cfg.rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
        b -= cfg.rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
    return w, b


def fit(docs: DataFrame, labels: DataFrame, cfg: Config = Config()) -> Model:
    sample, prior = _sample(docs, labels, cfg)
    n_p, n_u = sample.agg(F.count_if("p"), F.count_if("u")).first()
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -40.0, prior)
    if not n_p or prior <= 0:
        dropped(sample)
        return none
    prior = min(prior, 0.95)
    a, b = F.col("p") / n_p, (F.col("u") + 0.5) / (n_u + 1)
    z = (a - b) / F.sqrt(a * (1 - a) / n_p + b * (1 - b) / (n_u + 1) + 1e-9)
    best = _count(sample).where(F.col("p") >= cfg.least_documents).select("h", F.round(z, 9).alias("z")).where(F.col("z") >= cfg.least_z)
    keep = np.sort(best.orderBy(F.desc("z"), "h").limit(cfg.max_features).select("h").toArrow()["h"].to_numpy().view(np.uint64))
    if not len(keep):
        dropped(sample)
        return none
    w, c = _fit(*_matrix(sample, keep), len(keep), prior, cfg)
    dropped(sample)
    return Model(keep, w, c, prior)


def _scores(raw, off, keep, weights, intercept) -> np.ndarray:
    at, j = _present(raw, off, keep)
    z = np.bincount(at, weights=weights[j], minlength=len(off) - 1) + intercept
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def score(docs: DataFrame, model: Model, cfg: Config = Config()) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted. The model is of bounded size and goes with the task."""
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                yield arrow_rows(schema, [rows.column(0), _scores(raw, off, *shared.value)])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % cfg.folds == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def rejecting(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score is below the threshold, with all their columns. Null and empty texts stay, unless the intercept alone reaches it."""
    shared = docs.sparkSession.sparkContext.broadcast((model.features, model.weights, model.intercept))

    def run(batches):
        for batch in batches:
            for rows, raw, off in slices(batch):
                yield rows.filter(pa.array(_scores(raw, off, *shared.value) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, cfg: Config = Config()) -> DataFrame:
    return score(docs, fit(docs, labels, cfg), cfg)
