"""Event logs: sequences, replay, state, windows; and the same as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraloom.operators import graph
from terraloom.plans.base import Registry
from terraloom.session import table
from terraloom.streaming import events as V

query = Registry()
QUERIES, SQL = query.queries, query.sql
C = F.col

#: The events table as a job log: jobs are users, stages are event types.
L = """lg AS (SELECT CAST(user_id AS VARCHAR) AS job, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS seq, ts AS time, CASE WHEN event_id % 3 = 0 THEN 'start' WHEN event_id % 3 = 1 THEN 'done' ELSE 'failed' END AS type, event_type AS stage, value FROM events)"""


def log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind = F.when(C("event_id") % 3 == 0, "start").when(C("event_id") % 3 == 1, "done").otherwise("failed")
    x = e.select(C("user_id").cast("string").alias("job"), "event_id", C("ts").alias("time"), kind.alias("type"), C("event_type").alias("stage"), "value")
    return V.with_seq(x, "job", "time", "event_id").drop("event_id")


@query("wn11_event_sequence_sr1", f"WITH {L} SELECT job, seq, stage FROM lg")
def wn11(spark, sf_dir):
    return log(spark, sf_dir).select("job", "seq", "stage")


@query("wn12_replay_after_sr2_sr3", f"WITH {L} SELECT job, seq, type FROM lg WHERE seq > 50")
def wn12(spark, sf_dir):
    return V.after(log(spark, sf_dir), 50).select("job", "seq", "type")


@query("wn13_stage_progress_sr6", f"WITH {L}, s(stage, i) AS (SELECT stage, row_number() OVER (ORDER BY stage) - 1 FROM (SELECT DISTINCT event_type AS stage FROM events)) SELECT job, max(round((i + CASE WHEN type <> 'start' THEN 1.0e0 ELSE 0.3e0 END) / 10, 3)) AS progress FROM lg JOIN s USING (stage) GROUP BY job")
def wn13(spark, sf_dir):
    x = log(spark, sf_dir)
    names = [r["stage"] for r in x.select("stage").distinct().orderBy("stage").collect()]
    dim = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "stage string, i int")
    return x.join(F.broadcast(dim), "stage").groupBy("job").agg(F.max(V.progress(C("i"), C("type") != "start", 10)).alias("progress"))


@query("wn14_first_and_last_fifth", f"WITH {L}, n AS (SELECT *, greatest(1, count(*) OVER (PARTITION BY job) // 5) AS k, count(*) OVER (PARTITION BY job) AS n FROM lg) SELECT job, round(avg(value) FILTER (WHERE seq < k), 6) + 0.0 AS first_mean, round(avg(value) FILTER (WHERE seq >= n - k), 6) + 0.0 AS last_mean FROM n GROUP BY job")
def wn14(spark, sf_dir):
    x = log(spark, sf_dir)
    n = x.groupBy("job").agg(F.count("*").alias("n"))
    k = F.greatest(F.lit(1), F.floor(C("n") / 5))
    return x.join(n, "job").groupBy("job").agg((F.round(F.avg(F.when(C("seq") < k, C("value"))), 6) + F.lit(0.0)).alias("first_mean"), (F.round(F.avg(F.when(C("seq") >= C("n") - k, C("value"))), 6) + F.lit(0.0)).alias("last_mean"))


@query("sr4_latest_status", f"WITH {L} SELECT job, arg_max(CASE type WHEN 'start' THEN 'running' ELSE type END, seq) AS before, max(seq) AS seq, CASE WHEN arg_max(type, seq) = 'start' THEN 'failed' ELSE arg_max(type, seq) END AS after FROM lg GROUP BY job")
def sr4(spark, sf_dir):
    x = log(spark, sf_dir).withColumn("status", F.when(C("type") == "start", "running").otherwise(C("type")))
    a = V.latest_status(x).withColumnRenamed("status", "before")
    return a.join(V.latest_status(x, True).select("job", C("status").alias("after")), "job")


@query("sr5_stage_durations", f"WITH {L}, n AS (SELECT *, lead(type) OVER w AS t, lead(time) OVER w AS e FROM lg WINDOW w AS (PARTITION BY job, stage ORDER BY time, seq)) SELECT job, stage, time AS began, CAST(round(epoch(e) - epoch(time), 3) AS DOUBLE) AS seconds FROM n WHERE type = 'start' AND t IN ('done', 'failed')")
def sr5(spark, sf_dir):
    d = V.durations(log(spark, sf_dir).withColumn("time", C("time").cast("timestamp")))
    return d.select("job", "stage", C("began").cast("timestamp_ntz").alias("began"), F.round("seconds", 3).alias("seconds"))


def _batch(name, width, slide):
    def run(spark, sf_dir):
        w = V.windowed(table(spark, sf_dir, "events"), "ts", "event_type", width, slide)
        return w.select(C("start").cast("timestamp_ntz").alias("start"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))

    return query(name, f"WITH e AS (SELECT *, epoch(ts) AS t FROM events), k AS (SELECT *, floor(t / {_S[slide or width]}) - i AS b FROM e, range({_S[width] // _S[slide or width]}) x(i)) SELECT make_timestamp(CAST(b * {_S[slide or width]} * 1000000 AS BIGINT)) AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM k GROUP BY 1, 2")(run)


_S = {"1 hour": 3600, "30 minutes": 1800}
_batch("baseline_tumbling_windows", "1 hour", None)
_batch("baseline_sliding_windows", "1 hour", "30 minutes")


def _streamed(spark, sf_dir):
    """The events as a stream: a log written and read again, one file after the other."""
    path = f"{graph.shared_folder(spark).rstrip('/')}/log-{uuid.uuid4().hex}"
    V.append(table(spark, sf_dir, "events").select(C("user_id").cast("string").alias("job"), C("event_id").alias("seq"), C("ts").cast("timestamp").alias("time"), C("event_type").alias("type"), C("event_type").alias("stage"), F.lit(None).cast("double").alias("seconds"), "value"), path)
    return V.stream(spark, path), path + "-checkpoint"


@query("sr2_stream_complete", "SELECT event_type AS type, count(*) AS n FROM events GROUP BY 1")
def sr2(spark, sf_dir):
    x, checkpoint = _streamed(spark, sf_dir)
    return V.drain(x.groupBy("type").agg(F.count("*").alias("n")), f"s{uuid.uuid4().hex}", checkpoint, "complete")


#: Windows that the watermark, ten minutes behind the last event, has closed.
@query("sr2_stream_windows_append", "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2) SELECT start, type, n, total FROM w WHERE start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)")
def sr2w(spark, sf_dir):
    x, checkpoint = _streamed(spark, sf_dir)
    w = V.drain(V.windowed(x, "time", "type", "1 hour"), f"s{uuid.uuid4().hex}", checkpoint)
    return w.select(C("start").cast("timestamp_ntz").alias("start"), "type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


@query("sr4_stream_state", "SELECT CAST(user_id AS VARCHAR) AS job, max(event_id) AS seq FROM events GROUP BY 1")
def sr4s(spark, sf_dir):
    x, checkpoint = _streamed(spark, sf_dir)
    live = V.live_status(x.select("job", C("type").alias("status"), "seq"))
    return V.drain(live, f"s{uuid.uuid4().hex}", checkpoint, "update").groupBy("job").agg(F.max("seq").alias("seq"))
