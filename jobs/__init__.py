"""Runnable jobs: python -m jobs.<name> --help."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_RULES = "spark.sql.adaptive.optimizer.excludedRules"


@contextmanager
def observed(spark: SparkSession) -> Iterator[None]:
    """While this holds, stages whose rows are observed stay in the plan where they turn out to be empty, so that their counts come through."""
    before = spark.conf.get(_RULES, None)
    rule = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"
    spark.conf.set(_RULES, f"{before},{rule}" if before else rule)
    try:
        yield
    finally:
        spark.conf.unset(_RULES) if before is None else spark.conf.set(_RULES, before)
