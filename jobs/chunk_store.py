"""Batch job: raw documents to a store of chunks, ready for an embedding.

    python -m jobs.chunk_store --documents PATH --output PATH [--config jobs/chunk_store.json]

Documents (doc_id, text, lang, source) are cleaned; those that are empty or say little go; of equal texts the least doc_id stays. The rest is packed
into chunks of whole sentences. A chunk's key is a hash of its source and text; of equal keys the first by doc_id and place stays.

PATH/chunks is Parquet, one partition a language; PATH/report is one JSON row of what was read, dropped and written. Both are overwritten, so that a run after a
failed or a finished one leaves the same. Rows without doc_id are dropped and counted; a null lang is `und`, a null source empty.
"""

from __future__ import annotations

import argparse
import json
import logging
from dataclasses import dataclass, fields
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomdoc.functions import text as T
from loomdoc.operators import chunking

from . import observed

log = logging.getLogger("jobs.chunk_store")

CHUNKS = "chunk_hash string, source_id string, doc_id long, chunk_index long, total_chunks long, char_count long, word_count long, text string, lang string"


@dataclass(frozen=True)
class Config:
    max_chars: int = 1200
    overlap_chars: int = 100
    min_words: int = 20
    alpha_share: float = 0.3

    @staticmethod
    def read(path: str) -> Config:
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - {f.name for f in fields(Config)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return Config(**given)


def unique_documents(documents: DataFrame, cfg: Config, read: Observation, kept: Observation) -> DataFrame:
    """doc_id, source_id, lang, text (cleaned) of the documents that say something, one for each text."""
    text = T.clean(F.coalesce("text", F.lit("")))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("source_id"), F.coalesce("lang", F.lit("und")).alias("lang"), text.alias("text"))
    why = F.when(F.col("doc_id").isNull(), "no_id").when(F.col("text") == "", "empty").when(T.low_signal(F.col("text"), cfg.min_words, cfg.alpha_share, squeezed=True), "low_signal").otherwise("")
    rows = rows.withColumn("why", why).observe(read, F.count("*").alias("read"), *(F.count_if(F.col("why") == w).alias(w) for w in ("no_id", "empty", "low_signal")))
    first = rows.where("why = ''").groupBy(F.sha2("text", 256).alias("digest")).agg(F.min(F.struct("doc_id", "source_id", "lang", "text")).alias("d"))
    return first.select("d.*").observe(kept, F.count("*").alias("unique"))


def chunks(documents: DataFrame, cfg: Config) -> DataFrame:
    """Rows of CHUNKS of unique documents."""
    parts = chunking.packed(chunking.sentences(F.col("text")), cfg.max_chars, cfg.overlap_chars)
    # an outer one, as Spark would pack twice more to see whether there are parts
    rows = documents.select("doc_id", "source_id", "lang", parts.alias("parts")).select("doc_id", "source_id", "lang", F.size("parts").cast("long").alias("total_chunks"), F.posexplode_outer("parts").alias("chunk_index", "text")).where("text is not null")
    rows = rows.withColumn("chunk_hash", T.chunk_key(F.col("source_id"), F.col("text")))
    first = rows.groupBy("chunk_hash").agg(F.min(F.struct("doc_id", "chunk_index", "source_id", "lang", "total_chunks", "text")).alias("c")).select("chunk_hash", "c.*")
    return first.select("chunk_hash", "source_id", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "total_chunks", F.length("text").cast("long").alias("char_count"), T.n_words_squeezed(F.col("text")).cast("long").alias("word_count"), "text", "lang")


def run(spark: SparkSession, documents: str, output: str, cfg: Config = Config()) -> dict[str, int]:
    """Reads documents, writes output/chunks and output/report, and returns the counts of the report."""
    read, kept, written = Observation(), Observation(), Observation()
    log.info("reading %s", documents)
    rows = chunks(unique_documents(spark.read.parquet(documents), cfg, read, kept), cfg).observe(written, F.count("*").alias("chunks"))
    # a language's rows in tasks by key, so that a large one is written by many and a small one in few files
    with observed(spark):
        rows.repartition("lang", F.pmod(F.xxhash64("chunk_hash"), F.lit(16))).write.mode("overwrite").partitionBy("lang").parquet(f"{output}/chunks")
    counts = {**read.get, **kept.get, **written.get}
    counts["repeated"] = counts["read"] - counts["no_id"] - counts["empty"] - counts["low_signal"] - counts["unique"]
    spark.createDataFrame([counts]).coalesce(1).write.mode("overwrite").json(f"{output}/report")
    log.info("read %(read)d documents: %(no_id)d without id, %(empty)d empty, %(low_signal)d of low signal, %(repeated)d repeated; wrote %(chunks)d chunks", counts)
    log.info("wrote %s/chunks and %s/report", output, output)
    return counts


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    args.add_argument("--documents", required=True)
    args.add_argument("--output", required=True)
    args.add_argument("--config", default=str(Path(__file__).with_suffix(".json")))
    given = args.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("chunk_store").getOrCreate()
    try:
        run(spark, given.documents, given.output, Config.read(given.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
