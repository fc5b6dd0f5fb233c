"""Collections of points (id, source_id, embedding and any payload) as Parquet tables, one partition for each source.

A source is the unit of replacement: a write touches the partitions of its sources only, and writing twice changes nothing.
A point's key is its source_id and id.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Collections:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def _points(self, name: str) -> str:
        return f"{self.root}/{name}/points"

    def names(self) -> list[str]:
        if not self._fs.exists(self._path(self.root)):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.root)) if self.exists(s.getPath().getName()))

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}/settings.json"))

    def create(self, name: str, schema: T.StructType, dimension: int = 384, distance: str = "Cosine", recreate: bool = False) -> bool:
        """False where it stands already and recreate is not asked for."""
        if self.exists(name):
            if not recreate:
                return False
            self.drop(name)
        self._fs.mkdirs(self._path(self._points(name)))
        out = self._fs.create(self._path(f"{self.root}/{name}/settings.json"), True)
        out.write(bytearray(json.dumps({"dimension": dimension, "distance": distance, "schema": json.loads(schema.json())}).encode()))
        out.close()
        return True

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def settings(self, name: str) -> dict:
        if not self.exists(name):
            raise ValueError(f"no collection {name}")
        return json.loads(self.spark.read.text(f"{self.root}/{name}/settings.json", wholetext=True).first()[0])

    def read(self, name: str) -> DataFrame:
        schema = T.StructType.fromJson(self.settings(name)["schema"])
        return self.spark.read.schema(schema).parquet(self._points(name)).select(*schema.names)

    def _replace(self, name: str, points: DataFrame) -> None:
        points.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(self._points(name))

    def replace_sources(self, name: str, points: DataFrame) -> None:
        """The points become all that their sources have."""
        self._replace(name, self._checked(name, points))

    def upsert(self, name: str, points: DataFrame) -> None:
        """points replace those with their keys; others of their sources stay. Of several with a key one is kept."""
        new = self._checked(name, points).dropDuplicates(["source_id", "id"])
        old = self.read(name).join(new.select("source_id").distinct(), "source_id", "left_semi").join(new.select("source_id", "id"), ["source_id", "id"], "left_anti")
        staged = f"{self.root}/_staged-{uuid.uuid4().hex}"
        old.unionByName(new).write.parquet(staged)  # what is read is not what is overwritten
        self._replace(name, self.spark.read.schema(self.read(name).schema).parquet(staged))
        self._fs.delete(self._path(staged), True)

    def delete_source(self, name: str, source_id: str) -> int:
        """The number of points that went."""
        n = self.read(name).where(F.col("source_id") == source_id).count()
        if n:
            part = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(source_id))
            self._fs.delete(self._path(f"{self._points(name)}/source_id={part}"), True)
        return n

    def _checked(self, name: str, points: DataFrame) -> DataFrame:
        """points with the collection's columns; a vector of another size is an error. Points without source_id or id are left out."""
        found = self.settings(name)
        n, names = found["dimension"], T.StructType.fromJson(found["schema"]).names
        vector = F.when(F.size("embedding") == n, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"a vector of {name} has {n} values, not "), F.size("embedding").cast("string"))))
        return points.where("source_id is not null and id is not null").withColumn("embedding", vector).select(*names)

    def info(self, name: str) -> DataFrame:
        """name, points_count, sources, dimension and distance."""
        s = self.settings(name)
        return self.read(name).agg(F.count("*").alias("points_count"), F.count_distinct("source_id").alias("sources")).select(F.lit(name).alias("name"), "points_count", "sources", F.lit(s["dimension"]).alias("dimension"), F.lit(s["distance"]).alias("distance"))
