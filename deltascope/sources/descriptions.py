"""Column description CSV files in unknown encodings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a description file.
COLUMNS = ("original_column_name", "column_name", "column_description", "data_format", "value_description")
SCHEMA = ", ".join(f"{c} string" for c in COLUMNS)

_HIGH = [b for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", errors="ignore")]
_LATIN = "".join(chr(b) for b in _HIGH)
_WINDOWS = "".join(bytes([b]).decode("cp1252") for b in _HIGH)


def file_encodings(spark: SparkSession, path: str) -> DataFrame:
    """(file, encoding): UTF-16 by its mark at the start, else the first of UTF-8, cp1252, Latin-1 that fits.

    A file is looked at as a whole, in its task; only its first two bytes can be a mark.
    """
    content = F.col("content")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "[!_.]*").option("recursiveFileLookup", True).load(path)
    return files.filter(F.col("length") > 0).select(
        F.col("path").alias("file"),
        F.when(F.hex(F.substring(content, 1, 2)).isin("FFFE", "FEFF"), "UTF-16")
        .when(F.is_valid_utf8(content.cast("string")), "UTF-8")
        .when(~F.decode(content, "ISO-8859-1").rlike(r"[\x81\x8D\x8F\x90\x9D]"), "cp1252").otherwise("ISO-8859-1").alias("encoding"))


def _table_name() -> Column:
    return F.lower(F.trim(F.url_decode(F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv(?:/part-[^/]*)?$", 1))))


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """All description rows under ``path``, with the table name from the file (or folder) name.

    Only the list of files and encodings, one row per file, passes the driver.
    """
    by_encoding: dict[str, list[str]] = {}
    for row in file_encodings(spark, path).collect():
        by_encoding.setdefault(row["encoding"], []).append(row["file"])
    parts = []
    for encoding, files in sorted(by_encoding.items()):
        # the reader knows no cp1252; it differs from Latin-1 in one block of characters
        charset = "ISO-8859-1" if encoding == "cp1252" else encoding
        raw = (spark.read.schema(SCHEMA).option("header", True).option("multiLine", True).option("encoding", charset)
               .option("quote", '"').option("escape", '"').csv(files))
        fix = (lambda c: F.translate(c, _LATIN, _WINDOWS)) if encoding == "cp1252" else (lambda c: F.col(c))
        first = F.regexp_replace(fix(COLUMNS[0]), "^\ufeff", "")
        parts.append(raw.select(_table_name().alias("table_name"), first.alias(COLUMNS[0]),
                                *[fix(c).alias(c) for c in COLUMNS[1:]], F.lit(encoding).alias("encoding")))
    if not parts:
        return spark.createDataFrame([], f"table_name string, {SCHEMA}, encoding string")
    return reduce(DataFrame.unionByName, parts)
