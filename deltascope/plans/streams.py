"""Streaming queries, each run until all that has arrived is processed."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.functions.hashing import hash01
from deltascope.plans.logs import EVENT, STATUS, status_events
from deltascope.plans.registry import query
from deltascope.session import work_dir
from deltascope.sources.tables import read_table
from deltascope.streaming import jobs


def _arrived(spark, sf):
    """Log records as several files of JSON lines."""
    path = work_dir(spark, "arrived")
    status_events(spark, sf).repartition(4, "event_id").write.json(path)
    return path


@query("stream_route", f"""
SELECT CASE WHEN event_type IN ('purchase', 'signup') THEN 'success' ELSE 'failure' END AS bucket, event_id, user_id, {STATUS} AS status, value FROM events""")
def stream_route(spark, sf):
    out = work_dir(spark, "routed")
    stream = jobs.arriving(spark, _arrived(spark, sf), EVENT, files_per_trigger=2)
    jobs.route(stream, out, work_dir(spark, "checkpoint"))
    return spark.read.parquet(out).select("bucket", *EVENT.names)


KEYED = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                      T.StructField("ts", T.TimestampType())])


@query("stream_dedup_resume", "SELECT user_id, event_type, 1 AS times FROM events GROUP BY user_id, event_type")
def stream_dedup_resume(spark, sf):
    """Two waves of records with a restart between them; keys of the first wave come again."""
    path, out, checkpoint = (work_dir(spark, p) for p in ("waves", "once", "checkpoint"))
    events = read_table(spark, sf, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    first = hash01(82, F.col("event_id")) < 0.5
    for wave in (first, ~first):
        events.filter(wave).drop("event_id").write.mode("append").json(path)
        jobs.dedup(jobs.arriving(spark, path, KEYED), ["user_id", "event_type"], out, checkpoint)
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("times"))


@query("stream_run_stats", f"SELECT {STATUS} AS status, count(*) AS n FROM events GROUP BY 1")
def stream_run_stats(spark, sf):
    out = work_dir(spark, "stats")
    stream = jobs.arriving(spark, _arrived(spark, sf), EVENT, files_per_trigger=1)
    jobs.running_stats(stream, "status", out, work_dir(spark, "checkpoint"))
    return jobs.latest_snapshot(spark, out)
