"""Job event logs: batch views and Structured Streaming over appended JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schema of an event line.
EVENT = "job string, seq long, time timestamp, type string, stage string, seconds double, value double"


def with_seq(df: DataFrame, job: str, *order: str) -> DataFrame:
    """df with gap-free sequence numbers from 0 for each job."""
    return df.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)).cast("long") - 1)


def after(df: DataFrame, seq: int, job: str | None = None) -> DataFrame:
    """Events behind an offset, of one job or of all: a client's replay."""
    out = df.filter(F.col("seq") > seq)
    return out.filter(F.col("job") == job) if job is not None else out


def progress(stage_index: Column, done: Column, stages: int) -> Column:
    """Share of a job done when a stage has begun (0.3 of it counts) or ended."""
    return F.round((stage_index + F.when(done, 1.0).otherwise(0.3)) / stages, 3)


def latest_status(df: DataFrame, restarted: bool = False) -> DataFrame:
    """(job, status, seq) by each job's last event; after a restart jobs that were not
    finished have failed."""
    last = df.groupBy("job").agg(F.max_by("status", "seq").alias("status"), F.max("seq").alias("seq"))
    return last.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status"))) if restarted else last


def durations(df: DataFrame) -> DataFrame:
    """(job, stage, began, ended, seconds): each start with the next end of its stage."""
    w = Window.partitionBy("job", "stage").orderBy("time", "seq")
    nxt = df.withColumn("_t", F.lead("type").over(w)).withColumn("_e", F.lead("time").over(w))
    return nxt.filter("type = 'start' AND _t IN ('done', 'failed')").select("job", "stage", F.col("time").alias("began"), F.col("_e").alias("ended"), (F.col("_e").cast("double") - F.col("time").cast("double")).alias("seconds"))


def stream(spark: SparkSession, path: str, schema: str = EVENT) -> DataFrame:
    """A stream over JSON lines appended under a path."""
    return spark.readStream.schema(schema).json(path)


def windowed(df: DataFrame, time: str, by: str, width: str, slide: str | None = None, late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Counts and sums by time window; on a stream, a watermark closes windows and late
    events behind it are dropped."""
    t = F.col(time).cast("timestamp")
    x = df.withColumn(time, t)
    x = x.withWatermark(time, late) if df.isStreaming else x
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return x.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(df: DataFrame, time: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of each key, closed by a gap."""
    x = df.withColumn(time, F.col(time).cast("timestamp"))
    x = x.withWatermark(time, late) if df.isStreaming else x
    return x.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def live_status(df: DataFrame) -> DataFrame:
    """(job, status, seq) updates of a stream of status events: a small state a job keeps
    the newest, so late and repeated events change nothing."""

    def update(key, frames, state):
        import pandas as pd

        seq, status = state.get if state.exists else (-1, None)
        before = seq
        for pdf in frames:
            i = pdf["seq"].idxmax()
            if pdf["seq"][i] > seq:
                seq, status = int(pdf["seq"][i]), pdf["status"][i]
        state.update((seq, status))
        if seq > before:
            yield pd.DataFrame({"job": [key[0]], "status": [status], "seq": [seq]})

    return df.groupBy("job").applyInPandasWithState(update, "job string, status string, seq long", "seq long, status string", "update", "NoTimeout")


def drain(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream holds now, as a table in memory (for small results and tests)."""
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def run_batches(df: DataFrame, path: str, checkpoint: str, mode: str = "update") -> None:
    """Append all that a stream holds now to JSON lines under `path`; the checkpoint
    remembers offsets and state, so the next call continues behind the last event. A
    batch that is run again replaces its own folder and adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    q = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def append(df: DataFrame, path: str) -> None:
    """Add events to a log of JSON lines."""
    df.write.mode("append").json(path)
