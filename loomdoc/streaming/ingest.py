"""Streaming ingest: a file stream whose batches replace their sources' rows in a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_sources(spark: SparkSession, table: str, key: str = "source_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: overwrites the partitions of the sources in the batch, so that a batch that comes twice changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(table)

    return write


def ingest(spark: SparkSession, path: str, schema, table: str, checkpoint: str, made: Callable[[DataFrame], DataFrame] = lambda d: d, key: str = "source_id", glob: str | None = None):
    """Reads what is new under path (a folder, or a pattern of folders and files), makes its rows and replaces their sources in table; ends when nothing is left. Where nothing came the table is empty."""
    stream = spark.readStream.schema(schema)
    if glob:
        stream = stream.option("pathGlobFilter", glob)
    rows = made(stream.parquet(path)).where(F.col(key).isNotNull())
    query = rows.writeStream.foreachBatch(replace_sources(spark, table, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark.createDataFrame([], rows.schema).write.mode("ignore").partitionBy(key).parquet(table)
    return spark.read.schema(rows.schema).parquet(table)
