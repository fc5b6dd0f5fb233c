"""Embeddings: a function on batches of texts, applied in Arrow batches; by default hashed tokens, which need no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], np.ndarray]


def hashed(dimension: int = 384) -> Callable[[], Embedder]:
    """Counts of lower-cased words in `dimension` signed buckets, as unit vectors; a text without words is all zero."""

    def load() -> Embedder:
        import zlib

        def embed(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dimension), np.float32)
            for i, text in enumerate(texts):
                for word in text.lower().split():
                    h = zlib.crc32(word.encode())
                    out[i, h % dimension] += 1 if h & 0x80000000 else -1
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return out / np.where(norm > 0, norm, 1)

        return embed

    return load


def embedded(chunks: DataFrame, load: Callable[[], Embedder] = hashed(), text: str = "text", batch: int = 256) -> DataFrame:
    """chunks with their embedding. load runs once for each task and gives the function from texts to rows of unit length."""
    names = chunks.columns

    def run(batches):
        embed = load()
        for rows in batches:
            for at in range(0, rows.num_rows, batch):
                part = rows.slice(at, batch)
                vectors = embed([t or "" for t in part.column(text).to_pylist()])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(vectors) + 1) * vectors.shape[1], pa.int32()), pa.array(vectors.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*names, "embedding"])

    return chunks.mapInArrow(run, T.StructType([*chunks.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def points(chunks: DataFrame, source_hash: str = "source_hash") -> DataFrame:
    """Chunks as points: a key that is the same whenever source and text are."""
    from ..functions.text import chunk_key

    out = chunks.withColumn("id", chunk_key(F.col("source_id").cast("string"), F.col("text")))
    return out if source_hash in chunks.columns else out.withColumn(source_hash, F.lit(None).cast("string"))
