"""Session settings, shared work folder and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "deltascope",
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with AQE and skew handling on; cluster settings win when given."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # state on disk: keys seen by a stream grow without bound
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``.

    A temporary folder is used only in local mode, where driver and executors
    are one process.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), f"deltascope-{spark.sparkContext.applicationId}")


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder name under the shared folder; Spark creates it on write."""
    return f"{shared_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table survives the loss of executors, which a local
    checkpoint would not.
    """
    spark = df.sparkSession
    path = work_dir(spark, "table")
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
