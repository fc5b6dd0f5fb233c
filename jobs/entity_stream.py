"""Incremental job: entities of the documents that are new or have changed, and the totals of all.

    python -m jobs.entity_stream --documents PATH --output PATH [--config jobs/entity_stream.json]

A file stream with a checkpoint takes the files that it hasn't seen and ends. Of its documents (doc_id, text, source) those that stand in the ledger with the same
text are passed over; the others are searched for the patterns of the settings, and a document that has changed counts with its newest text only.

PATH/mentions (doc_id, name, n), a partition for each batch and type; PATH/ledger (doc_id, digest), a partition for each batch; PATH/entities
(name, n_docs, n_mentions, first_doc), a partition for each type, made anew from the two. PATH/checkpoint is the stream's. A batch overwrites its own partitions and reads
those of the batches before it, so that one that comes again after a failure leaves the same. A run without new files changes nothing.

Rows without doc_id are dropped. Of several texts that a batch has for a doc_id the one of the least digest counts. A null text is empty.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.operators import ner

from . import observed

log = logging.getLogger("jobs.entity_stream")

DOCUMENTS = "doc_id long, text string, source string"
LEDGER = "doc_id long, digest string, batch long"
MENTIONS = "doc_id long, name string, n long, batch long, type string"
ENTITIES = "name string, n_docs long, n_mentions long, first_doc long, type string"


@dataclass(frozen=True)
class Config:
    patterns: tuple[str, ...] = ("email", "phone", "percentage")
    files_per_batch: int = 1000

    @staticmethod
    def read(path: str) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - {f.name for f in fields(Config)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Config(**given | {"patterns": tuple(given.get("patterns", Config.patterns))})


def mentions(documents: DataFrame, cfg: Config) -> DataFrame:
    """doc_id, type, name, n: how often each entity stands in a document."""

    def of(name: str) -> DataFrame:
        kind = next(p[1] for p in ner.PATTERNS if p[0] == name)
        found = ner.matches(F.col("text"), ner.pattern(name), ner.NEEDED.get(name))
        return documents.select("doc_id", F.lit(kind).alias("type"), F.explode(found).alias("name"))

    every = reduce(DataFrame.unionByName, map(of, cfg.patterns))
    return every.groupBy("doc_id", "type", F.lower("name").alias("name")).agg(F.count("*").alias("n"))


def _stands(spark: SparkSession, path: str, schema: str, *by: str) -> None:
    """An empty table where there is none yet."""
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy(*by).parquet(path)


def _batch(output: str, cfg: Config, totals: dict[str, int]):
    """For foreachBatch: the mentions and the ledger's rows of what is new in a batch."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        text = F.coalesce("text", F.lit(""))
        seen, fresh = Observation(), Observation()
        rows = batch.observe(seen, F.count("*").alias("read"), F.count_if(F.col("doc_id").isNull()).alias("no_id")).where("doc_id is not null")
        one = rows.groupBy("doc_id").agg(F.min(F.struct(T.hash16(text).alias("digest"), text.alias("text"))).alias("d")).select("doc_id", "d.*")
        before = spark.read.schema(LEDGER).parquet(f"{output}/ledger").where(F.col("batch") < number).groupBy("doc_id").agg(F.max_by("digest", "batch").alias("old"))
        state = F.when(F.col("old").isNull(), "new").when(F.col("old") == F.col("digest"), "unchanged").otherwise("changed")
        told = one.join(before, "doc_id", "left").withColumn("state", state).observe(fresh, *(F.count_if(F.col("state") == s).alias(s) for s in ("new", "changed", "unchanged")))
        taken = told.where("state <> 'unchanged'").select("doc_id", "digest", "text").persist()
        save = lambda df, name, *by: df.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")
        save(mentions(taken, cfg), "mentions", "batch", "type")
        save(taken.select("doc_id", "digest"), "ledger", "batch")  # last: what stands here is done
        taken.unpersist()
        counts = {**seen.get, **fresh.get}
        for k, v in counts.items():
            totals[k] = totals.get(k, 0) + v
        log.info("batch %d: %s", number, counts)

    return write


def totals_of(spark: SparkSession, output: str) -> DataFrame:
    """name, n_docs, n_mentions, first_doc, type over the newest text of each document."""
    newest = spark.read.schema(LEDGER).parquet(f"{output}/ledger").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    rows = spark.read.schema(MENTIONS).parquet(f"{output}/mentions").join(newest, ["doc_id", "batch"])
    return rows.groupBy("name", "type").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_mentions"), F.min("doc_id").alias("first_doc")).select("name", "n_docs", "n_mentions", "first_doc", "type")


def run(spark: SparkSession, documents: str, output: str, cfg: Config = Config()) -> dict[str, int]:
    """Takes what is new in documents, writes below output, and returns the counts of this run."""
    _stands(spark, f"{output}/ledger", LEDGER, "batch")
    _stands(spark, f"{output}/mentions", MENTIONS, "batch", "type")
    counts: dict[str, int] = {"read": 0, "no_id": 0, "new": 0, "changed": 0, "unchanged": 0}
    log.info("reading what is new in %s", documents)
    with observed(spark):
        at = documents.rstrip("/")  # as a pattern, so that one file will do as well as a folder, which a stream asks for otherwise
        stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", cfg.files_per_batch).parquet(f"{at[:-1]}[{at[-1]}]")
        query = stream.writeStream.foreachBatch(_batch(output, cfg, counts)).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        entities = Observation()
        made = totals_of(spark, output).observe(entities, F.count("*").alias("entities"))
        made.repartition("type", F.pmod(F.xxhash64("name"), F.lit(16))).write.mode("overwrite").partitionBy("type").parquet(f"{output}/entities")
    counts |= entities.get
    log.info("read %(read)d documents: %(no_id)d without id, %(new)d new, %(changed)d changed, %(unchanged)d as before; %(entities)d entities stand", counts)
    log.info("wrote %s/mentions, %s/ledger and %s/entities", output, output, output)
    return counts


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("--documents", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("entity_stream").getOrCreate()
    try:
        run(spark, given.documents, given.output, Config.read(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
