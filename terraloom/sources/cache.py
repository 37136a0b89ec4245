"""A cache of fetched content, found by the key of the request that asked for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.operators import records

SCHEMA = "key string, content binary, sha256 string"


class RequestCache:
    """Parquet table (key, content, sha256) under a path that the cluster shares. A key is
    stored once; what is there already is never fetched again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def index(self) -> DataFrame:
        """(key, sha256) of all that is stored; empty before the first store()."""
        files = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not files.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(files):
            return self.spark.createDataFrame([], "key string, sha256 string")
        return self._table().select("key", "sha256")

    def _table(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def split(self, requests: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
        """(hits, misses): requests whose content is stored, and the others. Rows without a
        key are misses."""
        known = self.index().select(F.col("key").alias(key))
        return requests.join(known, key, "left_semi"), requests.join(known, key, "left_anti")

    def store(self, fetched: DataFrame, key: str = "key", content: str = "content") -> None:
        """Add contents of new keys; of repeated keys that of the least hash."""
        rows = fetched.select(F.col(key).alias("key"), F.col(content).cast("binary").alias("content"))
        rows = rows.filter("key IS NOT NULL").withColumn("sha256", records.content_hash(F.col("content")))
        once = rows.groupBy("key").agg(F.min_by(F.struct("content", "sha256"), "sha256").alias("c")).select("key", "c.*")
        self.split(once)[1].write.mode("append").parquet(self.path)

    def read(self, requests: DataFrame, key: str = "key") -> DataFrame:
        """Hits with their content."""
        return requests.join(self._table().select(F.col("key").alias(key), "content"), key)

    def damaged(self) -> DataFrame:
        """Keys whose content no longer has the hash it was stored with."""
        return self._table().filter(F.col("sha256") != records.content_hash(F.col("content"))).select("key")
