"""Queries that profile all columns of the database."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01
from deltascope.operators import profile
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.registry import query
from deltascope.session import cut_lineage
from deltascope.sources.tables import read_database, read_table

ALL_COLUMNS = fx.schema_columns()
TEXTS: dict[str, list[str]] = {}
for _t, _c, _kind, _, _ in ALL_COLUMNS:
    if _kind == "TEXT":
        TEXTS.setdefault(_t, []).append(_c)
INDEXED = profile.text_columns(ALL_COLUMNS)
BOUNDING_ROWS = 1000  # rows a table that bound the search for the first values of all rows
DATE_COLUMNS = [(t, c) for t, c, kind, _, _ in ALL_COLUMNS if kind == "DATE" or "date" in c.lower()]


def text_values(columns: dict[str, list[str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {c} AS value FROM {t}"
                              for t, cols in columns.items() for c in cols)


def _lengths(columns: dict[str, list[str]]) -> str:
    return f"""SELECT table_name, column_name, sum(length(value))::BIGINT AS sum_lengths, count(*) AS n_distinct
FROM (SELECT DISTINCT * FROM ({text_values(columns)}) WHERE value IS NOT NULL) GROUP BY ALL"""


# CTE dict(table_name, column_name, value), to follow WITH
VALUE_DICTIONARY = f"""dict AS (SELECT DISTINCT v.* FROM ({text_values(INDEXED)}) v JOIN ({_lengths(INDEXED)}) s
  ON v.table_name = s.table_name AND v.column_name = s.column_name WHERE v.value IS NOT NULL AND (
  contains(lower(s.column_name), 'name') OR sum_lengths / n_distinct < 25
  OR n_distinct < 100))"""


def value_dictionary_of(spark, sf):
    tables = read_database(spark, sf)
    return profile.value_dictionary(tables, profile.schema_rows(tables, fx.PRIMARY_KEYS))


def declared_catalog(spark, sf):
    return profile.catalog(spark, read_database(spark, sf), fx.PRIMARY_KEYS)


def fk_rows():
    return [(t, c, rt, rc or fx.PRIMARY_KEYS[rt][0]) for t, c, rt, rc in fx.FOREIGN_KEYS]


def fk_edges(spark):
    return spark.createDataFrame(fk_rows(), "table_name string, column_name string, ref_table string, ref_column string")


@query("schema_catalog", f"""
WITH n AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS table_rows FROM {t}" for t in fx.SCHEMA)})
SELECT c.table_name, column_name, type, ordinal, is_key, table_rows FROM ({fx.CATALOG}) c JOIN n ON c.table_name = n.table_name""")
def schema_catalog(spark, sf):
    from deltascope.operators.diff import table_row_counts
    counts = table_row_counts(read_database(spark, sf)).withColumnRenamed("n_rows", "table_rows")
    return declared_catalog(spark, sf).join(counts, "table_name")


@query("profile_lengths", f"""
SELECT *, round(sum_lengths / n_distinct, 4) AS avg_length FROM ({_lengths(TEXTS)})""")
def profile_lengths(spark, sf):
    stats = profile.column_statistics(profile.column_values(read_database(spark, sf, TEXTS), TEXTS))
    return stats.filter(F.col("distinct_count") > 0).select(
        "table_name", "column_name", "sum_lengths", F.col("distinct_count").alias("n_distinct"),
        F.round(profile.average_length(), 4).alias("avg_length"))


@query("value_dictionary", f"WITH {VALUE_DICTIONARY} SELECT * FROM dict")
def value_dictionary(spark, sf):
    return value_dictionary_of(spark, sf)


@query("column_skip", f"""
SELECT table_name, column_name, NOT contains(lower(column_name), 'name') AND sum_lengths > 50000
  AND sum_lengths / n_distinct > 20 AS skip FROM ({_lengths(TEXTS)})""")
def column_skip(spark, sf):
    return profile.column_skip(profile.column_statistics(
        profile.column_values(read_database(spark, sf, TEXTS), TEXTS)))


@query("categorical_columns", f"""
WITH v AS ({fx.ALL_VALUES}), s AS ({fx.COLUMN_STATS})
SELECT DISTINCT v.table_name, v.column_name, v.value FROM v JOIN s ON v.table_name = s.table_name AND v.column_name = s.column_name
WHERE v.value IS NOT NULL AND distinct_count + CASE WHEN null_count > 0 THEN 1 ELSE 0 END < 20""")
def categorical_columns(spark, sf):
    tables = read_database(spark, sf)
    stats = profile.column_statistics(profile.column_values(tables))
    return profile.distinct_values(tables, profile.listed(stats.filter(profile.is_categorical())))


@query("value_statistics", f"""
SELECT table_name, column_name, row_count, 'Total count ' || non_null || ' - Distinct count ' || distinct_count
  || ' - Null count ' || null_count AS value_statics FROM ({fx.COLUMN_STATS})""")
def value_statistics(spark, sf):
    stats = profile.column_statistics(profile.column_values(read_database(spark, sf)))
    return stats.select("table_name", "column_name", "row_count", profile.statistics_text().alias("value_statics"))


@query("value_statistics_nulls", f"""
SELECT 'o_orderstatus' AS column_name, count(o_orderstatus) AS non_null, count(DISTINCT o_orderstatus) AS distinct_count,
  count_if(o_orderstatus IS NULL) AS null_count FROM ({fx.ORDERS_NULLABLE})
UNION ALL SELECT 'o_totalprice', count(o_totalprice), count(DISTINCT o_totalprice), count_if(o_totalprice IS NULL) FROM ({fx.ORDERS_NULLABLE})""")
def value_statistics_nulls(spark, sf):
    values = profile.column_values({"orders": fx.orders_nullable(spark, sf)},
                                   {"orders": ["o_orderstatus", "o_totalprice"]})
    return profile.column_statistics(values).select("column_name", "non_null", "distinct_count", "null_count")


# CTE ex(table_name, column_name, examples VARCHAR[]), to follow WITH
EXAMPLES = f"""s_ AS ({fx.COLUMN_STATS}), b_ AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY value) AS r
  FROM (SELECT DISTINCT * FROM ({fx.ALL_VALUES}) WHERE value IS NOT NULL)),
g_ AS (SELECT table_name, column_name, list(value ORDER BY r) AS best FROM b_ WHERE r <= 5 GROUP BY ALL),
ex AS (SELECT * FROM (SELECT g_.table_name, g_.column_name,
  CASE WHEN contains(lower(g_.column_name), 'date') AND length(best[1]) < 50 THEN best[1:3]
    WHEN distinct_count + CASE WHEN null_count > 0 THEN 1 ELSE 0 END < 20 THEN best
    WHEN length(best[1]) < 50 THEN best[1:3] END AS examples
  FROM g_ JOIN s_ ON g_.table_name = s_.table_name AND g_.column_name = s_.column_name) WHERE examples IS NOT NULL)"""


def examples_of(spark, sf):
    """Examples and statistics of all columns; the statistics are written, as several joins read them."""
    tables = read_database(spark, sf)
    values = profile.column_values(tables)
    stats = cut_lineage(profile.column_statistics(values))
    some = cut_lineage(profile.column_values({t: df.limit(BOUNDING_ROWS) for t, df in tables.items()}))
    return profile.example_values(values, stats, DATE_COLUMNS, some), stats


@query("example_values", f"""
WITH {EXAMPLES} SELECT table_name, column_name, array_to_string(examples, ' | ') AS examples FROM ex""")
def example_values(spark, sf):
    examples, _ = examples_of(spark, sf)
    return examples.withColumn("examples", F.array_join("examples", " | "))


_COMPOUND = {t: ",".join(k) for t, k in fx.PRIMARY_KEYS.items() if len(k) > 1}
_DECLARED = [(t, ",".join(k)) for t, k in fx.PRIMARY_KEYS.items() if k]


@query("primary_keys", f"""
WITH v AS (SELECT table_name, column_name AS key, row_count = distinct_count AND null_count = 0 AS is_unique FROM ({fx.COLUMN_STATS})
UNION ALL SELECT 'conversations', 'conv_id,turn', count(*) = count(DISTINCT (conv_id, turn)) FROM conversations)
SELECT *, (table_name, key) IN (VALUES {", ".join(f"('{t}', '{k}')" for t, k in _DECLARED)}) AS declared FROM v
WHERE is_unique OR (table_name, key) IN (VALUES {", ".join(f"('{t}', '{k}')" for t, k in _DECLARED)})""")
def primary_keys(spark, sf):
    tables = read_database(spark, sf)
    columns = {t: [*df.columns, *([_COMPOUND[t]] if t in _COMPOUND else [])] for t, df in tables.items()}
    return profile.key_columns(profile.column_statistics(profile.column_values(tables, columns)), _DECLARED)


@query("foreign_key_edges", " UNION ALL ".join(
    f"""SELECT '{t}.{c}' AS source, '{rt}.{rc}' AS target, count({c}) AS n_rows,
  count_if({c} IS NOT NULL AND {c} NOT IN (SELECT {rc} FROM {rt})) AS n_orphans FROM {t}""" for t, c, rt, rc in fk_rows()))
def foreign_key_edges(spark, sf):
    return profile.orphan_counts(read_database(spark, sf), fk_rows())


PROBES = """SELECT 'part' AS table_name, 'p_name' AS column_name, upper(substr(p_name, 2, 5)) AS literal FROM part
UNION SELECT 'part', 'p_brand', substr(p_brand, 6, 2) FROM part
UNION SELECT 'part', 'p_type', substr(p_brand, 1, 1) FROM part
UNION SELECT 'customer', 'c_name', right(c_name, 4) FROM customer
UNION SELECT 'customer', 'c_mktsegment', right(c_name, 3) FROM customer
UNION SELECT 'nation', 'n_name', 'nation_' || (p_size % 30) FROM part"""


def probes(spark, sf):
    part, customer = read_table(spark, sf, "part"), read_table(spark, sf, "customer")

    def ask(df, table, column, literal):
        return df.select(F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), literal.alias("literal"))

    return (ask(part, "part", "p_name", F.upper(F.substring("p_name", 2, 5)))
            .union(ask(part, "part", "p_brand", F.substring("p_brand", 6, 2)))
            .union(ask(part, "part", "p_type", F.substring("p_brand", 1, 1)))
            .union(ask(customer, "customer", "c_name", F.expr("right(c_name, 4)")))
            .union(ask(customer, "customer", "c_mktsegment", F.expr("right(c_name, 3)")))
            .union(ask(part, "nation", "n_name", F.concat(F.lit("nation_"), F.col("p_size") % 30)))).distinct()


@query("value_exists", f"""
WITH {VALUE_DICTIONARY}, p AS ({PROBES})
SELECT p.table_name, p.column_name, p.literal, min(value) AS match FROM p LEFT JOIN dict d
  ON p.table_name = d.table_name AND p.column_name = d.column_name AND contains(lower(value), lower(literal)) GROUP BY ALL""")
def value_exists(spark, sf):
    return profile.value_exists(cut_lineage(value_dictionary_of(spark, sf)), probes(spark, sf))


@query("select_capped", f"""
WITH t AS (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_totalprice > 200000)
SELECT * FROM (SELECT 'capped' AS mode, * FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 500)
UNION ALL SELECT * FROM (SELECT 'one', * FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'one_of_ten', * FROM (SELECT * FROM t ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
  ORDER BY {u(48, 'o_orderkey')} LIMIT 1)""")
def select_capped(spark, sf):
    rows = read_table(spark, sf, "orders").filter(F.col("o_totalprice") > 200000).select(
        "o_orderkey", "o_custkey", "o_totalprice")
    order = [F.desc("o_totalprice"), "o_orderkey"]
    ten = profile.select_capped(rows, order, 10)
    modes = {"capped": profile.select_capped(rows, order, 500), "one": profile.select_capped(rows, order, 1),
             "one_of_ten": profile.seeded_pick(ten, hash01(48, F.col("o_orderkey")))}
    parts = [df.select(F.lit(m).alias("mode"), "*") for m, df in modes.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
