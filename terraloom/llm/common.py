"""Shared helpers of the language-model operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that an Arrow batch holds at most; long texts then stay within a worker's memory.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_ROWS rows unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Only where that is unset and the session runs on this machine alone, as in tests, a
    folder of this machine is set for it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            base = found.get()
        elif spark.sparkContext.master.partition("[")[0] == "local":
            base = "file://" + tempfile.mkdtemp(prefix="terraloom-")
            spark.sparkContext.setCheckpointDir(base)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
    return f"{base.rstrip('/')}/terraloom-{uuid.uuid4().hex}"


def written(df: DataFrame, **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut there, and a lost
    executor costs no more than a new read of that table. The table goes when the
    application ends, or with discard()."""
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    files, at = _files(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def _files(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing reads any more."""
    for df in tables:
        files, at = _files(df.sparkSession, df.scratch)
        files.delete(at, True)


def without(batch: pa.RecordBatch, *names: str) -> list[int]:
    """Indexes of the columns of a batch that are not named."""
    return [i for i, n in enumerate(batch.schema.names) if n not in names]


def utf8(column: pa.Array) -> Iterator[bytes | None]:
    """The bytes of a string column, row by row; None for null."""
    return iter(column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist())


def rows_of(batches: Iterable[pa.RecordBatch], key: str, text: str) -> Iterator[tuple[list, list]]:
    """Key values and text bytes of each batch."""
    for b in batches:
        yield b.column(key).to_pylist(), list(utf8(b.column(text)))


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links (a, b: long): one row (node, component) per linked
    node, component being the smallest node that it reaches.

    Alternates large-star and small-star steps: every step moves a link per neighbour
    at most, so no star is ever expanded into pairs. A hub's neighbours are met by a
    minimum per key, which Spark forms before its shuffle. Empty links give no rows;
    self links, repeats and nulls are ignored."""
    edges = links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        old = edges
        # large star: each neighbour above a node goes to the smallest node around it
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = written(both.filter("b > a").join(first, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # small star: each neighbour below a node, and the node, go to the smallest of them
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select("b", "m").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct())
        discard(old, first, large, least)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
