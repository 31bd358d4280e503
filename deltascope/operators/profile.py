"""Column statistics, value dictionaries, keys and value probes over whole databases.

Columns are brought to the long form (table_name, column_name, value), so one
job profiles all columns of all tables.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Thresholds and name parts of the column rules.
SKIP_NAME_PARTS = ("_id", " id", "url", "email", "web", "time", "phone", "date", "address")
MAX_AVERAGE = 25
SMALL_COUNT = 100
CATEGORICAL_BELOW = 20
SKIP_CHARS, SKIP_AVERAGE = 50_000, 20
EXAMPLES, OTHER_EXAMPLES, EXAMPLE_CHARS = 5, 3, 50


def type_name(dtype: T.DataType) -> str:
    """Declared type name of a column."""
    if isinstance(dtype, T.IntegralType):
        return "INTEGER"
    if isinstance(dtype, (T.DoubleType, T.FloatType, T.DecimalType)):
        return "REAL"
    if isinstance(dtype, T.StringType):
        return "TEXT"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return "ARRAY" if isinstance(dtype, T.ArrayType) else "BLOB"


def schema_rows(tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> list[tuple]:
    """(table, column, type, ordinal, is key) from the schemas; reads no data."""
    return [(t, f.name, type_name(f.dataType), i, f.name in keys.get(t, ()))
            for t, df in tables.items() for i, f in enumerate(df.schema.fields)]


def catalog(spark: SparkSession, tables: Mapping[str, DataFrame], keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Catalog table; its size is the number of columns."""
    return spark.createDataFrame(
        schema_rows(tables, keys),
        "table_name string, column_name string, type string, ordinal int, is_key boolean")


def as_text(df: DataFrame, name: str) -> Column:
    """A column as text; doubles keep all their digits, and the two zeros are one."""
    col = F.col(name)
    if isinstance(df.schema[name].dataType, T.DoubleType):
        col = col + F.lit(0.0)
    return col.cast("string")


def column_values(tables: Mapping[str, DataFrame],
                  columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Long form of the given (or all) columns; a name with commas is a compound key.

    Every row becomes one row per column; how many pieces a scan has is a
    matter of ``spark.sql.files.maxPartitionBytes``.
    """
    parts = []
    for table, df in tables.items():
        names = list(df.columns if columns is None else columns.get(table, ()))
        if not names:
            continue
        texts = [(F.concat_ws(",", *[as_text(df, p) for p in n.split(",")]) if "," in n else as_text(df, n)).alias(n)
                 for n in names]
        needed = sorted({p for n in names for p in n.split(",")})
        parts.append(df.select(*needed).select(*texts).unpivot([], names, "column_name", "value")
                     .select(F.lit(table).alias("table_name"), "column_name", "value"))
    return reduce(DataFrame.unionByName, parts)


def _value_key(value: Column) -> Column:
    """Short stand-in for a value: itself up to 64 characters, else its 256-bit hash."""
    return F.when(F.length(value) <= 64, F.concat(F.lit("="), value)).otherwise(F.sha2(value, 256))


def column_statistics(values: DataFrame) -> DataFrame:
    """Rows, non-NULL values, distinct values, NULLs and lengths per column, exact.

    Copies collapse before the shuffle and long texts travel as hashes.
    """
    distinct = (values.groupBy("table_name", "column_name", _value_key(F.col("value")).alias("k"))
                .agg(F.count(F.lit(1)).alias("n"), F.max(F.length("value")).alias("chars")))
    return distinct.groupBy("table_name", "column_name").agg(
        F.sum("n").alias("row_count"),
        F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("non_null"),
        F.count("k").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("null_count"),
        F.coalesce(F.sum("chars"), F.lit(0)).cast("bigint").alias("sum_lengths"))


def average_length() -> Column:
    return F.col("sum_lengths") / F.when(F.col("distinct_count") > 0, F.col("distinct_count"))


def statistics_text() -> Column:
    """The total counts non-NULL values only, as the text always did."""
    return F.concat(F.lit("Total count "), F.col("non_null"), F.lit(" - Distinct count "),
                    F.col("distinct_count"), F.lit(" - Null count "), F.col("null_count"))


def is_categorical() -> Column:
    """Fewer than 20 distinct values, NULL counting as one."""
    return F.col("distinct_count") + (F.col("null_count") > 0).cast("int") < CATEGORICAL_BELOW


def text_columns(rows: Sequence[tuple]) -> dict[str, list[str]]:
    """Text columns worth indexing, by type and name alone (schema metadata only)."""
    key_names = {c.lower() for _, c, _, _, is_key in rows if is_key}
    picked: dict[str, list[str]] = {}
    for table, column, kind, _, _ in rows:
        low = column.lower()
        skipped = low in key_names or column.endswith("Id") or any(p in low for p in SKIP_NAME_PARTS)
        if "TEXT" in kind and not skipped:
            picked.setdefault(table, []).append(column)
    return picked


def dictionary_column(max_chars: int | None = None) -> Column:
    """Does a column hold names, short values or few values, whatever its size.

    ``max_chars`` leaves out columns with more distinct text (2.5 times as much for names).
    """
    low = F.lower("column_name").contains("name")
    wanted = low | (average_length() < MAX_AVERAGE)
    if max_chars is not None:
        wanted = wanted & (F.col("sum_lengths") < F.when(low, 2.5 * max_chars).otherwise(max_chars))
    return wanted | (F.col("distinct_count") < SMALL_COUNT)


def listed(stats: DataFrame) -> dict[str, list[str]]:
    """Names of the columns in ``stats``, by table; as many as the schema has columns."""
    names: dict[str, list[str]] = {}
    for table, column in stats.select("table_name", "column_name").sort("table_name", "column_name").collect():
        names.setdefault(table, []).append(column)
    return names


def distinct_values(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """Distinct non-NULL values of the named columns; the scan reads no other column."""
    return column_values(tables, columns).filter(F.col("value").isNotNull()).distinct()


def value_dictionary(tables: Mapping[str, DataFrame], rows: Sequence[tuple], max_chars: int | None = None) -> DataFrame:
    """Distinct values (table_name, column_name, value) of the columns worth indexing.

    The statistics run first; then only the chosen columns are read, so long
    texts that do not qualify are never shuffled.
    """
    stats = column_statistics(column_values(tables, text_columns(rows)))
    wanted = listed(stats.filter((F.col("distinct_count") > 0) & dictionary_column(max_chars)))
    return distinct_values(tables, wanted)


def column_skip(stats: DataFrame) -> DataFrame:
    """Columns too long to index: no "name" in the name, much text, long values."""
    skip = (~F.lower("column_name").contains("name")) & (F.col("sum_lengths") > SKIP_CHARS) & (average_length() > SKIP_AVERAGE)
    return stats.filter(F.col("distinct_count") > 0).select("table_name", "column_name", skip.alias("skip"))


def example_values(values: DataFrame, stats: DataFrame, date_columns: Sequence[tuple[str, str]],
                   some: DataFrame | None = None) -> DataFrame:
    """First values per column in text order: 5 for categorical columns, else 3 short ones.

    Date columns get 3 whether categorical or not. The ranking keeps at most 5
    values per column and task before the shuffle. ``some`` may be any part of
    ``values``: the fifth value of the whole is no greater than the fifth of a
    part, so greater values need no shuffle. The result is the same without.
    """
    first = Window.partitionBy("table_name", "column_name").orderBy("value")
    given = values.filter(F.col("value").isNotNull())
    if some is not None:
        fifth = (some.filter(F.col("value").isNotNull()).distinct().withColumn("rank", F.row_number().over(first))
                 .filter(F.col("rank") == EXAMPLES).select("table_name", "column_name", F.col("value").alias("fifth")))
        given = given.join(F.broadcast(fifth), ["table_name", "column_name"], "left").filter(
            F.col("fifth").isNull() | (F.col("value") <= F.col("fifth"))).drop("fifth")
    distinct = given.distinct()
    best = distinct.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= EXAMPLES)
    gathered = best.groupBy("table_name", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("best"))
    dated = F.lit(False)
    for table, column in date_columns:
        dated = dated | ((F.col("table_name") == table) & (F.col("column_name") == column))
    kinds = stats.select("table_name", "column_name", is_categorical().alias("categorical"))
    values_of = F.transform("best", lambda b: b["value"])
    short = F.length(F.get(values_of, F.lit(0))) < EXAMPLE_CHARS
    three = F.slice(values_of, 1, OTHER_EXAMPLES)
    chosen = (F.when(dated & short, three)
              .when(F.col("categorical"), values_of)
              .when(short, three))
    return (gathered.join(F.broadcast(kinds), ["table_name", "column_name"])
            .select("table_name", "column_name", chosen.alias("examples"))
            .filter(F.col("examples").isNotNull()))


def key_columns(stats: DataFrame, declared: Sequence[tuple[str, str]]) -> DataFrame:
    """Declared keys and columns that could be keys, checked against the data."""
    unique = (F.col("row_count") == F.col("distinct_count")) & (F.col("null_count") == 0)
    listed = F.lit(False)
    for table, column in declared:
        listed = listed | ((F.col("table_name") == table) & (F.col("column_name") == column))
    return (stats.select("table_name", F.col("column_name").alias("key"), listed.alias("declared"), unique.alias("is_unique"))
            .filter(F.col("declared") | F.col("is_unique")))


def orphan_counts(tables: Mapping[str, DataFrame], edges: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Foreign keys with the rows that refer and the rows that refer to nothing.

    Child keys are counted first, so a key with very many rows joins as one.
    """
    parts = []
    for table, column, ref_table, ref_column in edges:
        child = tables[table].groupBy(F.col(column).cast("bigint").alias("k")).agg(F.count(F.lit(1)).alias("n"))
        parent = tables[ref_table].select(F.col(ref_column).cast("bigint").alias("k")).distinct()
        joined = child.filter(F.col("k").isNotNull()).join(parent.withColumn("found", F.lit(True)), "k", "left")
        parts.append(joined.agg(
            F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_rows"),
            F.coalesce(F.sum(F.when(F.col("found").isNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("n_orphans"),
        ).select(F.lit(f"{table}.{column}").alias("source"), F.lit(f"{ref_table}.{ref_column}").alias("target"),
                 "n_rows", "n_orphans"))
    return reduce(DataFrame.unionByName, parts)


def _grams(text: Column, size: int) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(
        F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size)))


def value_exists(values: DataFrame, probes: DataFrame) -> DataFrame:
    """One match per probe: the least value of the column that contains the literal.

    ASCII and other letters match in any case. Instead of testing every value
    against every probe, values and probes meet on three-letter pieces: each
    probe looks only at the values with its rarest piece. Literals of one or
    two letters meet the least value per piece, which is counted beforehand.
    All joins are merges: Spark takes pieces for fewer than they are and would
    broadcast them.
    """
    on = ["table_name", "column_name"]
    lowered = values.withColumn("low", F.lower("value"))
    asked = (probes.select(*on, "literal").distinct()
             .withColumn("needle", F.lower("literal")).filter(F.length("needle") > 0))

    def pieces(size: int) -> DataFrame:
        return lowered.select(*on, "value", "low", F.explode(_grams(F.col("low"), size)).alias("piece"))

    short = (pieces(1).unionByName(pieces(2)).groupBy(*on, "piece").agg(F.min("value").alias("match")))
    by_short = (asked.filter(F.length("needle") < 3).join(
        short.withColumnRenamed("piece", "needle").hint("merge"), [*on, "needle"])
                .select(*on, "literal", "match"))

    three = pieces(3)
    counts = three.groupBy(*on, "piece").agg(F.count(F.lit(1)).alias("n"))
    long = asked.filter(F.length("needle") >= 3)
    anchors = (long.withColumn("piece", F.explode(_grams(F.col("needle"), 3)))
               .join(counts.hint("merge"), [*on, "piece"], "left")
               .groupBy(*on, "literal", "needle")
               .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
               .filter(F.col("least.n") > 0)
               .select(*on, "literal", "needle", F.col("least.piece").alias("piece")))
    by_long = (anchors.join(three.hint("merge"), [*on, "piece"]).filter(F.col("low").contains(F.col("needle")))
               .groupBy(*on, "literal").agg(F.min("value").alias("match")))
    return probes.join(by_short.unionByName(by_long).hint("merge"), [*on, "literal"], "left")


def select_capped(df: DataFrame, order: Sequence[str], max_rows: int) -> DataFrame:
    """First rows of a result in an explicit order; runs as a distributed top-n."""
    return df.orderBy(*order).limit(max_rows)


def seeded_pick(df: DataFrame, draw: Column) -> DataFrame:
    """One row of a result, chosen by the least draw."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.agg(F.min_by(packed, F.struct(draw, packed)).alias("r")).select("r.*")
