"""A training corpus from raw documents: five stages, each on what the one before kept.

1. toxicity: documents whose score reaches 0.5 go. Null and empty texts stay.
2. minhash: of each group of near duplicates (5-word shingles, similarity 0.8, linked through others too) the document with the least doc_id stays. Rows that repeat a doc_id go.
3. substring: passages of 50 words or more that stand in an earlier document are cut out; documents of which nothing is left go.
4. decontamination: words within windows of benchmark items are cut out; documents of which half the words are such go.
5. packing: the rest is packed into sequences of 1024 tokens.

Stages 1 to 4 return the columns of documents, n_chars counted anew where texts change. Rows without doc_id pass the second and third stage as they are. A null text stays null, and is packed
as an empty one. Extra columns pass. An empty table of documents gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdoc.llm import decontam, minhash, packing, substring, toxicity
from loomdoc.plans.scratch import dropped, settled
from loomdoc.plans.ship import ship


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.rejecting(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return minhash.deduplicated(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _sized(substring.deduplicated(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return _sized(decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs, packing.Config(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("substring", cut_repeated_passages),
    ("decontamination", cut_benchmark),
    ("packing", pack),
]

#: A fitted classifier, seeds and alignments have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
