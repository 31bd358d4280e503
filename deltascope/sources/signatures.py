"""Saved value dictionary, signatures and LSH index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from deltascope.operators import similar


@dataclass(frozen=True)
class SignatureStore:
    dictionary: DataFrame
    signatures: DataFrame
    index: DataFrame


def save_store(dictionary: DataFrame, path: str, bands: int, rows: int) -> SignatureStore:
    """Write dictionary, signatures and index; each part is computed from the written one before.

    The index is written in ranges of (band, bucket), so that a lookup of few
    buckets reads few row groups.
    """
    spark = dictionary.sparkSession
    _missing.discard(path)
    dictionary.write.mode("overwrite").parquet(f"{path}/dictionary")
    saved = spark.read.parquet(f"{path}/dictionary")
    similar.minhash(saved, "value").write.mode("overwrite").parquet(f"{path}/signatures")
    signatures = spark.read.parquet(f"{path}/signatures")
    (similar.lsh_index(signatures, "value", bands, rows).repartitionByRange("band", "bucket")
     .sortWithinPartitions("band", "bucket").write.mode("overwrite").partitionBy("band").parquet(f"{path}/index"))
    return load_store(spark, path)


_missing: set[str] = set()


def load_store(spark: SparkSession, path: str) -> SignatureStore:
    """A saved store; a store that could not be read is not tried again."""
    if path in _missing:
        raise FileNotFoundError(f"no signature store at {path}")
    try:
        index = spark.read.parquet(f"{path}/index")
        return SignatureStore(spark.read.parquet(f"{path}/dictionary"), spark.read.parquet(f"{path}/signatures"),
                              index.withColumn("band", index["band"].cast("bigint")))
    except AnalysisException as err:
        _missing.add(path)
        raise FileNotFoundError(f"no signature store at {path}") from err
