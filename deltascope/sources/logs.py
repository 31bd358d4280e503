"""JSON sources and sinks: arrays, tolerant JSON lines, routed logs, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


def read_json_array(spark: SparkSession, path: str, schema: T.StructType,
                    record_per_line: bool = False) -> DataFrame:
    """Records of files that each hold one JSON array.

    A free-form array can only be read by one task per file. With
    ``record_per_line`` (brackets and records on lines of their own) the files
    are split like any text.
    """
    if not record_per_line:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    body = F.regexp_replace(F.trim("value"), r"^\[|,$|\]$", "")
    lines = spark.read.text(path).select(F.trim(body).alias("line")).filter("line <> ''")
    return lines.select(F.from_json("line", schema).alias("r")).select("r.*")


def parse_json_lines(lines: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of a ``value`` column; blank lines count as neither."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = lines.filter(F.trim("value") != "").select(
        F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("r"))
    good = parsed.filter(F.col(f"r.{CORRUPT}").isNull()).select(*[F.col(f"r.{f.name}") for f in schema.fields])
    return good, parsed.filter(F.col(f"r.{CORRUPT}").isNotNull()).select(F.col(f"r.{CORRUPT}").alias("line"))


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(records, corrupt lines) of JSON lines files, from one scan."""
    return parse_json_lines(spark.read.text(path), schema)


def bucket_of(status: Column) -> Column:
    return F.when(status == "success", "success").otherwise("failure")


def write_routed(records: DataFrame, path: str, status: str = "status") -> None:
    """Append records to the success or the failure log."""
    records.withColumn("bucket", bucket_of(F.col(status))).write.mode("append").partitionBy("bucket").json(path)


def read_routed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Both logs with their ``bucket``."""
    wide = T.StructType([*schema.fields, T.StructField("bucket", T.StringType())])
    return spark.read.schema(wide).json(path)


def consolidate(log: DataFrame, path: str, key: str = "id") -> DataFrame:
    """Merge a log into one export sorted by key, as range-partitioned Parquet."""
    log.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def nest_results(flat: DataFrame, record: list[str], evaluation: list[str], penalties: list[str]) -> DataFrame:
    """Flat analysis rows as nested results: record, evaluation, penalty map."""
    pairs = [x for p in penalties for x in (F.lit(p), F.col(p))]
    return flat.select(F.struct(*record).alias("record"), F.struct(
        *evaluation, F.create_map(*pairs).alias("tool_penalty_breakdown")).alias("evaluation"))


def flatten_results(nested: DataFrame, penalties: list[str]) -> DataFrame:
    """Nested results as one flat row each; the penalty map becomes columns."""
    inner = [f.name for f in nested.schema["evaluation"].dataType.fields if f.name != "tool_penalty_breakdown"]
    return nested.select("record.*", *[F.col(f"evaluation.{n}") for n in inner],
                         *[F.col("evaluation.tool_penalty_breakdown")[p].alias(p) for p in penalties])
