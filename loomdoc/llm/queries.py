"""Queries over whole tables, one for each operator, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, htmlmain, license, minhash, ngramjoin, packing, prefixtrie, quality, substring, tokenbin, tokencount, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a passage of 50 words or more that stands in another document too."""
    return substring.repeated(_table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), minhash.Config(words=2))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = tokenbin.Config(public_tokenizers.path("byte_bpe_50k.json"))
    return tokenbin.documents_of(spark, tokenbin.write(_table(spark, sf_dir, "documents"), cfg))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(_table(spark, sf_dir, "documents"), tokencount.Config(public_tokenizers.path("piece_bpe_32k.model")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), packing.Config(public_tokenizers.path("byte_bpe_50k.json")))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(_table(spark, sf_dir, "pages"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.licences(_table(spark, sf_dir, "documents").withColumn("path", F.expr(license.PATH_SQL)))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, each begun with turns of the first one of its five."""
    return prefixtrie.report(_table(spark, sf_dir, "conversations"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents joined by the similarity of their sets of five words."""
    return ngramjoin.jaccard_components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring, op2_minhash, op3_toxicity, op4_token_shards, op5_token_counts, op6_packing, op7_main_text, op8_decontamination, op9_quality, op10_licences, op11_prefix_trie, op12_jaccard_join)}
ORACLES = {"op2_minhash": minhash.oracle(), "op8_decontamination": decontam.oracle(), "op10_licences": license.oracle(), "op11_prefix_trie": prefixtrie.oracle(), "op12_jaccard_join": ngramjoin.oracle()}
