"""A keyed table in hash buckets: a change rewrites the buckets it touches, and a new manifest puts them in force at once."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentloom.operators import tables

#: Buckets of a new table. A change reads and writes whole buckets, so a large table wants as many as make one bucket a task's work.
BUCKETS = 64


class BucketTable:
    """``rows/version=v/bucket=b`` holds the rows of a bucket as the writer of v has written them; ``manifest/n`` says for the n-th state of the table where each bucket is read from.

    A manifest counts once Spark has committed it (``_SUCCESS``), and the newest one is in force. A writer that ends early leaves files that no manifest names; a reader keeps the manifest that it has opened.
    Of two writers that start from one state the second one to commit fails, as its manifest is there already.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.parquet(f"{self.path}/about").first()
        self.key, self.n, self.schema = about.key, about.buckets, StructType.fromJson(json.loads(about.schema))
        self.version = max(self._committed())
        self.manifest = {x.bucket: x.version for x in spark.read.parquet(f"{self.path}/manifest/{self.version}").collect()}

    @staticmethod
    def create(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> BucketTable:
        """Writes a table whose keys are not null and occur once. The folder is new."""
        spark, path = df.sparkSession, path.rstrip("/")
        spark.createDataFrame([(key, buckets, df.schema.json())], "key string, buckets int, schema string").coalesce(1).write.parquet(f"{path}/about")
        _commit(spark, path, 0, _write(df.withColumn("bucket", _bucket(F.col(key), buckets)), path, 0, buckets))
        return BucketTable(spark, path)

    def _committed(self) -> list[int]:
        fs, folder = _fs(self.spark, f"{self.path}/manifest")
        return [int(x.getPath().getName()) for x in fs.listStatus(folder) if fs.exists(_path(self.spark, f"{x.getPath()}/_SUCCESS"))]

    def rows(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or some of its buckets: one scan of the folders in force."""
        folders = [f"{self.path}/rows/version={v}/bucket={b}" for b, v in sorted(self.manifest.items()) if buckets is None or b in buckets]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def upsert(self, changes: DataFrame) -> BucketTable:
        """The table with new values where a change has some (not null), and with the keys that only changes have. Changes have each key once; null keys are left out."""
        return self._changed(changes.filter(F.col(self.key).isNotNull()), lambda own, part: tables.upsert(own, part, self.key))

    def delete(self, keys: DataFrame) -> BucketTable:
        """The table without some keys."""
        return self._changed(keys.select(self.key), lambda own, part: tables.delete(own, part, self.key))

    def _changed(self, changes: DataFrame, change) -> BucketTable:
        place = _bucket(F.col(self.key), self.n)
        touched = sorted(x[0] for x in changes.select(place.alias("b")).distinct().collect() if x[0] is not None)  # at most as many as there are buckets
        if not touched:
            return self
        new = self.version + 1
        made = change(self.rows(touched), changes).select(*(F.col(f.name).cast(f.dataType) for f in self.schema.fields))
        written = _write(made.withColumn("bucket", place), self.path, new, len(touched))
        _commit(self.spark, self.path, new, {b: v for b, v in self.manifest.items() if b not in touched} | written)
        return BucketTable(self.spark, self.path)


def _bucket(key: Column, n: int) -> Column:
    return F.when(key.isNotNull(), F.pmod(F.xxhash64(key.cast("string")), F.lit(n)).cast("int"))


def _write(rows: DataFrame, path: str, version: int, buckets: int) -> dict[int, str]:
    """Writes files of each bucket into a folder of this writer's own; the buckets that have rows, with its name."""
    name = f"{version}-{uuid.uuid4().hex}"
    rows.repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{path}/rows/version={name}")
    fs, folder = _fs(rows.sparkSession, f"{path}/rows/version={name}")
    found = (x.getPath().getName() for x in fs.listStatus(folder))
    return {int(x.removeprefix("bucket=")): name for x in found if x.startswith("bucket=")}


def _path(spark: SparkSession, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _fs(spark: SparkSession, name: str):
    path = _path(spark, name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _commit(spark: SparkSession, path: str, version: int, manifest: dict[int, str]) -> None:
    spark.createDataFrame(sorted(manifest.items()), "bucket int, version string").coalesce(1).write.mode("error").parquet(f"{path}/manifest/{version}")
