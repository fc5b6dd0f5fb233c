"""Vector search: cosine scores of unit vectors, filters before the limit, batched queries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def payload_filter(source_id=None, source_type=None, title_contains=None, language=None, min_chars=None, max_chars=None, custom: list[Column] | None = None) -> Column | None:
    """All of the given conditions; None if none is given."""
    conds = [F.col(k) == v for k, v in (("source_id", source_id), ("source_type", source_type), ("language", language)) if v]
    if title_contains:
        conds.append(F.col("title").contains(title_contains))
    if min_chars is not None:
        conds.append(F.col("char_count") >= min_chars)
    if max_chars is not None:
        conds.append(F.col("char_count") <= max_chars)
    conds += custom or []
    return reduce(lambda a, b: a & b, conds) if conds else None


def key_value_filter(text: str, columns: list[str]) -> Column:
    """key=value; the value is compared in the column's own type."""
    key, found, value = (x.strip() for x in text.partition("="))
    if not found:
        raise ValueError(f"not key=value: {text}")
    if key not in columns:
        raise ValueError(f"no column {key}")
    return F.col(key) == F.lit(value)


def top_k(points: DataFrame, query: list[float], k: int = 5, where: Column | None = None, threshold: float | None = None) -> DataFrame:
    """id and score of the k nearest; ties go to the lesser id."""
    found = points if where is None else points.where(where)
    scored = found.withColumn("score", F.round(dot(F.col("embedding"), F.array(*map(F.lit, query))), 6))
    if threshold is not None:
        scored = scored.where(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), "id").limit(k)


#: Queries go to the workers in blocks of about this many, points are scored in slices of so many rows.
MOST_QUERIES, SLICE = 10_000, 256


def _best(held: list[np.ndarray], k: int) -> list[np.ndarray]:
    """Of (query, id, score) triples the k best of each query: the greatest score, then the least id."""
    q, ids, scores = held
    order = np.lexsort((ids, -scores, q))
    q = q[order]
    first = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return [x[order][rank < k] for x in held]


def _scored(vectors, k: int):
    """mapInArrow function: (id, embedding) to the k best (query number, id, score) of the partition for each of the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = vectors.value
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        least = np.full(len(matrix), -np.inf)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids, v = part.column(0).to_numpy(zero_copy_only=False), part.column(1)
                points = v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
                scores = np.round(matrix @ points.T, 6)
                q, p = np.nonzero(scores >= least[:, None])
                held = _best([np.concatenate(x) for x in zip(held, (q, ids[p], scores[q, p]))], k)
                ends = np.flatnonzero(np.append(held[0][1:] != held[0][:-1], True)) if len(held[0]) else np.zeros(0, int)
                full = ends[np.bincount(held[0], minlength=len(matrix))[held[0][ends]] == k]
                least[held[0][full]] = held[2][full]
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.float64())], names=["n", "id", "score"])

    return run


def top_k_per_query(points: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score of the k points (id long, embedding) nearest to each of queries (query_id, query); ties go to the lesser id.

    Each block of queries is one matrix that every task multiplies its points with; a task gives k rows a query at most, and
    these are merged. Points and queries that are null, hold a null or NaN, or aren't of the queries' size have no score.
    """
    spark = points.sparkSession
    full = lambda c: c.isNotNull() & ~F.exists(c, lambda x: x.isNull() | F.isnan(x))
    queries = queries.where(full(F.col("query")))
    size = queries.agg(F.max(F.size("query")).alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-size["rows"] // MOST_QUERIES))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    usable = points.where(full(F.col("embedding")) & (F.size("embedding") == (size["n"] or 0))).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))

    def found(some: DataFrame) -> DataFrame:
        rows = some.select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()  # MOST_QUERIES or little more
        matrix = rows.column("query").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, size["n"] or 0))
        names = F.broadcast(spark.createDataFrame(list(enumerate(rows.column("query_id").to_pylist())), f"n long, query_id {queries.schema['query_id'].dataType.simpleString()}"))
        best = usable.mapInArrow(_scored(spark.sparkContext.broadcast(matrix), k), "n long, id long, score double")
        return best.join(names, "n").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    same = queries.where(F.size("query") == (size["n"] or 0))
    return reduce(DataFrame.unionByName, [found(same.where(block == i) if blocks > 1 else same) for i in range(blocks)])
