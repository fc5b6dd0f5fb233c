"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Tables that were written and not dropped yet.
_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset: a new local one if driver and executors are one process (tests), else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomdoc-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/loomdoc/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: a lost executor costs no recomputation of what stands before."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    _open.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that nothing reads any more."""
    for table in tables:
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            _delete(table.sparkSession, name)
            _open[:] = [p for p in _open if p.rsplit("/", 1)[1] != name.rsplit("/", 1)[1]]


def settled(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """What make gives, written; the tables that it left on its way are deleted, as nothing reads them any more."""
    before = set(_open)
    out = written(make(), tag)
    last = _open[-1]
    for path in [p for p in _open if p not in before and p != last]:
        _delete(out.sparkSession, path)
        _open.remove(path)
    return out
