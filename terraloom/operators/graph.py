"""Connected components of pixel masks."""

from __future__ import annotations

import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir), for tables between
    steps. Only a session on this machine alone, as in tests, may do without the setting;
    it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not base and found.isDefined():
        return found.get()
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the cluster shares")
        base = "file://" + mkdtemp(prefix="terraloom-")
    if not found.isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage is cut there, readers take
    the columns they need, and the table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/terraloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def pixel_components(mask: DataFrame, width: int) -> DataFrame:
    """(row, col, label) of set pixels, 8-connected; label is the smallest row * width +
    col of the component. Labels spread over neighbours and jump to their label's label
    in each round, so rounds grow with the logarithm of a component's length."""
    at = lambda r, c: r * width + c
    px = mask.select("row", "col", at(F.col("row"), F.col("col")).alias("id"))
    step = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)))
    near = px.withColumn("s", F.explode(step)).select("id", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    edges = cut(near.join(px.select("row", "col", F.col("id").alias("other")), ["row", "col"]).select("id", "other"))
    label = cut(px.select("id", F.col("id").alias("label")))
    while True:
        offered = edges.join(label.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("best"))
        lower = label.join(offered, "id", "left").select("id", F.least("label", "best").alias("label"), F.col("label").alias("before"))
        jump = lower.select(F.col("id").alias("label"), F.col("label").alias("further"))
        new = cut(lower.join(jump, "label", "left").select("id", F.least("label", "further").alias("label"), "before"))
        changed = new.filter("label <> before").limit(1).count()
        label = new.select("id", "label")
        if not changed:
            return px.join(label, "id").select("row", "col", "label")
