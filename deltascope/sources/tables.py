"""A database as a set of named Parquet tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


_schemas: dict[str, StructType] = {}


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table. Its schema is read from the file footer once per process."""
    path = f"{directory}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def read_database(spark: SparkSession, directory: str,
                  names: Iterable[str] = TABLE_NAMES) -> dict[str, DataFrame]:
    """All tables of a database by name; nothing is read until a query needs it."""
    return {name: read_table(spark, directory, name) for name in names}
