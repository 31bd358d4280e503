"""Structured Streaming jobs over arriving log records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from deltascope.sources.logs import bucket_of


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of JSON lines records from a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def _run(writer, checkpoint: str) -> StreamingQuery:
    """Process all that has arrived and stop; a later start goes on from the checkpoint."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def route(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append each record to the success or the failure log as it arrives.

    A batch that is run again replaces its own files, so records are not
    written twice.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("bucket", bucket_of(F.col("status"))).withColumn("batch", F.lit(batch_id))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket", "batch").parquet(out))
    return _run(stream.writeStream.foreachBatch(write), checkpoint)


def dedup(stream: DataFrame, keys: Sequence[str], out: str, checkpoint: str,
          event_time: str | None = None, delay: str = "1 hour") -> StreamingQuery:
    """Write each key once, across restarts.

    The keys seen are state. With ``event_time`` a key is remembered only for
    the watermark delay, which bounds the state.
    """
    if event_time:
        once = stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
    else:
        once = stream.dropDuplicates(list(keys))
    return _run(once.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


def running_stats(stream: DataFrame, key: str, out: str, checkpoint: str) -> StreamingQuery:
    """Running totals per key; every micro-batch saves a snapshot of all totals."""
    totals = stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/snapshot={batch_id}")
    return _run(totals.writeStream.outputMode("complete").foreachBatch(save), checkpoint)


def latest_snapshot(spark: SparkSession, out: str) -> DataFrame:
    saved = spark.read.parquet(out)
    return saved.filter(F.col("snapshot") == saved.agg(F.max("snapshot")).scalar()).drop("snapshot")
