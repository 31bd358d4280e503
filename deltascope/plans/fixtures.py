"""Derived inputs of the registered queries, and their SQL twins for the oracle.

Everything here grows with the given tables; draws come from ``hash01``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01, hash01_sql
from deltascope.operators.alter import Alteration, apply_sequence
from deltascope.sources.tables import read_table

ORDER_BUCKET = 100_000  # order keys per ranking bucket


def copy_key(key: Column) -> Column:
    """Key of an inserted copy: negative, so it meets no key of the table, whatever its size."""
    return -key - 1


def copy_key_sql(key: str) -> str:
    return f"(-({key}) - 1)"


def u(seed: int, key: str) -> str:
    """``hash01`` in DuckDB SQL."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key}), 1, 8)) AS BIGINT) / 4294967296.0)"


def orders_base(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the date as text, so that results print the same everywhere."""
    return read_table(spark, sf, "orders").withColumn(
        "o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


ORDERS_BASE = ("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, "
               "strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders")


def orders_changes(base: DataFrame) -> list[Alteration]:
    """The standard corruption: 1 % deleted, 2 % updated, 1 % inserted."""
    copies = base.filter(hash01(3, F.col("o_orderkey")) < 0.01).withColumn(
        "o_orderkey", copy_key(F.col("o_orderkey")))
    return [
        Alteration("orders", "delete", hash01_sql(1, "o_orderkey") + " < 0.01"),
        Alteration("orders", "update", hash01_sql(2, "o_orderkey") + " < 0.02",
                   {"o_totalprice": "o_totalprice * 2", "o_orderstatus": "'X'"}),
        Alteration("orders", "insert", rows=copies),
    ]


def orders_altered(spark: SparkSession, sf: str) -> DataFrame:
    base = orders_base(spark, sf)
    return apply_sequence({"orders": base}, orders_changes(base))["orders"]


_ALT_UPDATE = f"""SELECT o_orderkey, o_custkey,
  CASE WHEN {u(2, 'o_orderkey')} < 0.02 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN {u(2, 'o_orderkey')} < 0.02 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  o_orderdate, o_orderpriority FROM base WHERE NOT ({u(1, 'o_orderkey')} < 0.01)"""
_ALT_INSERT = f"""SELECT {copy_key_sql('o_orderkey')} AS o_orderkey, o_custkey, o_orderstatus, o_totalprice,
  o_orderdate, o_orderpriority FROM base WHERE {u(3, 'o_orderkey')} < 0.01"""

# CTEs base and alt, to be followed by a SELECT
WITH_ORDERS = f"""WITH base AS ({ORDERS_BASE}),
alt AS ({_ALT_UPDATE} UNION ALL {_ALT_INSERT})"""


def part_changes() -> list[Alteration]:
    return [
        Alteration("part", "delete", hash01_sql(1, "p_partkey") + " < 0.01"),
        Alteration("part", "update", hash01_sql(2, "p_partkey") + " < 0.02",
                   {"p_retailprice": "p_retailprice + p_size", "p_size": "p_size + 1"}),
    ]


WITH_PART = f"""part_alt AS (SELECT p_partkey, p_name, p_brand, p_type,
  CASE WHEN {u(2, 'p_partkey')} < 0.02 THEN p_size + 1 ELSE p_size END AS p_size,
  CASE WHEN {u(2, 'p_partkey')} < 0.02 THEN p_retailprice + p_size ELSE p_retailprice END AS p_retailprice
  FROM part WHERE NOT ({u(1, 'p_partkey')} < 0.01))"""


def lineitem_dup(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Lineitem, and lineitem with a second copy of some rows."""
    base = read_table(spark, sf, "lineitem").withColumn(
        "l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return base, base.unionByName(base.filter(hash01(4, F.col("l_orderkey")) < 0.01))


def orders_nullable(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with NULLs in status and price."""
    price = F.when(hash01(5, F.col("o_orderkey")) >= 0.05, F.col("o_totalprice"))
    return orders_base(spark, sf).withColumn("o_totalprice", price).withColumn(
        "o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))


ORDERS_NULLABLE = f"""SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
  CASE WHEN {u(5, 'o_orderkey')} >= 0.05 THEN o_totalprice END AS o_totalprice,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders"""


def orders_fixed(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Altered orders after a full, a partial (deletes only) and a bad repair."""
    base, altered = orders_base(spark, sf), orders_altered(spark, sf)
    key = F.col("o_orderkey")
    lost = base.filter(hash01(1, key) < 0.01)
    partial = altered.unionByName(lost)
    untouched = altered.filter((key >= 0) & ~(hash01(2, key) < 0.02))
    updated = base.filter((hash01(2, key) < 0.02) & ~(hash01(1, key) < 0.01))
    full = untouched.unionByName(updated).unionByName(lost)
    bad = full.filter(hash01(16, key) >= 0.01)
    return {"full": full, "partial": partial, "bad": bad}


# CTEs fixed_full, fixed_partial and fixed_bad, to follow WITH_ORDERS
WITH_FIXED = f"""fixed_full AS (SELECT * FROM base),
fixed_partial AS (SELECT * FROM alt UNION ALL SELECT * FROM base WHERE {u(1, 'o_orderkey')} < 0.01),
fixed_bad AS (SELECT * FROM base WHERE {u(16, 'o_orderkey')} >= 0.01)"""


def order_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Keyed deltas of 50 records over orders; some keys are touched by two records."""
    base = orders_base(spark, sf).select("o_orderkey", "o_totalprice")
    key = F.col("o_orderkey")
    parts = []
    for pick, record, kind in ((11, 12, 13), (14, 15, 16)):
        draw = hash01(kind, key)
        op = F.when(draw < 0.34, "delete").when(draw < 0.67, "insert").otherwise("update")
        parts.append(base.filter(hash01(pick, key) < 0.05).select(
            (F.floor(hash01(record, key) * 50) + 50 * len(parts)).cast("bigint").alias("record_id"),
            op.alias("op"),
            F.when(op == "insert", copy_key(key)).otherwise(key).alias("o_orderkey"),
            F.when(op != "delete", F.col("o_totalprice") + 100).alias("o_totalprice")))
    return parts[0].unionByName(parts[1])


def _delta_sql(pick: int, record: int, kind: int, shift: int) -> str:
    d = u(kind, "o_orderkey")
    op = f"CASE WHEN {d} < 0.34 THEN 'delete' WHEN {d} < 0.67 THEN 'insert' ELSE 'update' END"
    return f"""SELECT CAST(floor({u(record, 'o_orderkey')} * 50) AS BIGINT) + {shift} AS record_id, {op} AS op,
  CASE WHEN {op} = 'insert' THEN {copy_key_sql('o_orderkey')} ELSE o_orderkey END AS o_orderkey,
  CASE WHEN {op} <> 'delete' THEN o_totalprice + 100 END AS o_totalprice
  FROM orders WHERE {u(pick, 'o_orderkey')} < 0.05"""


ORDER_DELTAS = f"{_delta_sql(11, 12, 13, 0)} UNION ALL {_delta_sql(14, 15, 16, 50)}"


RECORDS = 60  # altered databases whose fixes are scored


def record_fixes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Alterations of many records over orders, their fixes, and the fixes that fail.

    A tenth of the orders is altered by one record each. By the record number
    modulo 4 the fix undoes all, undoes only what was deleted, undoes all but
    removes other orders, or undoes all and touches a cheap
    order, which the gold query does not see. Every tenth fix fails.
    """
    base = orders_base(spark, sf)
    key, record = F.col("o_orderkey"), F.floor(hash01(42, F.col("o_orderkey")) * RECORDS).cast("bigint")
    draw = hash01(43, key)
    op = F.when(draw < 0.34, "delete").when(draw < 0.67, "insert").otherwise("update")
    picked = base.filter(hash01(41, key) < 0.1).select(record.alias("record_id"), op.alias("op"), "*")
    altered = picked.withColumn("o_totalprice", F.when(F.col("op") == "update", F.col("o_totalprice") * 2).otherwise(F.col("o_totalprice"))).withColumn(
        "o_orderkey", F.when(F.col("op") == "insert", copy_key(key)).otherwise(key))
    kind = F.col("record_id") % 4
    inverse = picked.filter((kind != 1) | (F.col("op") == "delete")).withColumn(
        "o_orderkey", F.when(F.col("op") == "insert", copy_key(key)).otherwise(key)).withColumn(
        "op", F.when(F.col("op") == "insert", "delete").when(F.col("op") == "delete", "insert").otherwise("update"))
    side = base.filter(hash01(41, key) >= 0.1).select(record.alias("record_id"), "*")
    lost = side.filter((kind == 2) & (hash01(44, key) < 0.01)).withColumn("op", F.lit("delete"))
    touched = side.filter((kind == 3) & (F.col("o_totalprice") < 50000) & (hash01(44, key) < 0.05)).withColumn(
        "op", F.lit("update")).withColumn("o_orderstatus", F.lit("X"))
    fixes = inverse.unionByName(lost).unionByName(touched)
    failed = picked.select("record_id").distinct().filter(F.col("record_id") % 10 == 7).select(
        "record_id", F.concat(F.lit("no such table: orders_"), F.col("record_id")).alias("error"))
    return altered, fixes, failed


_RECORD = f"CAST(floor({u(42, 'o_orderkey')} * {RECORDS}) AS BIGINT)"
_ROP = f"CASE WHEN {u(43, 'o_orderkey')} < 0.34 THEN 'delete' WHEN {u(43, 'o_orderkey')} < 0.67 THEN 'insert' ELSE 'update' END"
_REST = "o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
RECORD_ALTERATIONS = f"""SELECT {_RECORD} AS record_id, {_ROP} AS op,
  CASE WHEN {_ROP} = 'insert' THEN {copy_key_sql('o_orderkey')} ELSE o_orderkey END AS o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN {_ROP} = 'update' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
  FROM base WHERE {u(41, 'o_orderkey')} < 0.1"""
RECORD_FIXES = f"""SELECT {_RECORD} AS record_id, CASE {_ROP} WHEN 'insert' THEN 'delete' WHEN 'delete' THEN 'insert' ELSE 'update' END AS op,
  CASE WHEN {_ROP} = 'insert' THEN {copy_key_sql('o_orderkey')} ELSE o_orderkey END AS o_orderkey, {_REST}
  FROM base WHERE {u(41, 'o_orderkey')} < 0.1 AND ({_RECORD} % 4 <> 1 OR {_ROP} = 'delete')
UNION ALL SELECT {_RECORD}, 'delete', o_orderkey, {_REST} FROM base WHERE {u(41, 'o_orderkey')} >= 0.1 AND {_RECORD} % 4 = 2 AND {u(44, 'o_orderkey')} < 0.01
UNION ALL SELECT {_RECORD}, 'update', o_orderkey, o_custkey, 'X', o_totalprice, o_orderdate, o_orderpriority FROM base
  WHERE {u(41, 'o_orderkey')} >= 0.1 AND {_RECORD} % 4 = 3 AND o_totalprice < 50000 AND {u(44, 'o_orderkey')} < 0.05"""
RECORD_ERROR = "CASE WHEN record_id % 10 = 7 THEN 'no such table: orders_' || record_id END"


# A log of query texts: one per order, from a template filled with the order's values.
QUERY_TEMPLATES = (
    "SELECT o.o_orderkey, c.c_name FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey "
    "WHERE c.c_custkey = {c} LIMIT 10",
    "SELECT COUNT(*) FROM orders WHERE o_orderstatus = '{s}'",
    "select o_orderpriority, count(*) as n from Orders group by o_orderpriority -- limit 5",
    "SELECT credit_limit FROM accounts WHERE id = {k}",
    "SELECT p_name FROM part WHERE p_name LIKE '%RING%' AND p_size > 10",
    "WITH t AS (SELECT * FROM lineitem) DELETE FROM orders WHERE o_orderkey = {k}",
    "DELETE FROM orders WHERE o_orderkey = {k}; SELECT 1",
    "SELECT l.l_orderkey, SUM(l.l_extendedprice) AS revenue FROM lineitem l INNER JOIN orders o "
    "ON l.l_orderkey = o.o_orderkey AND l.l_suppkey = o.o_custkey WHERE o.o_orderpriority = '{p}' GROUP BY l.l_orderkey",
    "SELECT c_name\nFROM customer\nWHERE c_mktsegment = \\\"BUILDING\\\"\n  AND c_nationkey = {c}",
    "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name LIKE '%xyz%'",
    "SELECT AVG(o_totalprice) FROM orders WHERE LOWER(o_orderstatus) = '{s}'",
    "  ;  ; UPDATE customer SET c_acctbal = 0 WHERE c_custkey = {c}",
    "SELECT c.c_name FROM orders JOIN customer c ON (orders.o_custkey = c.c_custkey) WHERE c.c_acctbal > -99.75",
    "SELECT c_name FROM customer WHERE c_name = 'it''s {c}' AND c_acctbal = 1234.5",
)


def _fill(index, row):
    template = F.element_at(F.array(*[F.lit(t) for t in QUERY_TEMPLATES]), index.cast("int") + 1)
    for mark, col in row.items():
        template = F.replace(template, F.lit(mark), F.col(col).cast("string"))
    return template


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    """(query_id, user_id, query, predicted, response) for every order."""
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    row = {"{k}": "o_orderkey", "{c}": "o_custkey", "{s}": "o_orderstatus", "{p}": "o_orderpriority"}
    key, n = F.col("o_orderkey"), len(QUERY_TEMPLATES)
    gold = _fill(key % n, row)
    predicted = _fill(F.when(hash01(31, key) < 0.5, key % n).otherwise((key + 1) % n), row)
    logged = orders.select(key.alias("query_id"), F.col("o_custkey").alias("user_id"),
                           gold.alias("query"), predicted.alias("predicted"))
    draw = hash01(32, F.col("query_id"))
    response = (F.when(draw < 0.3, F.col("query"))
                .when(draw < 0.6, F.concat(F.lit("Sure.\n```sql\n"), F.col("query"), F.lit("\n```\nDone.")))
                .otherwise(F.concat(F.lit("```sql SELECT 1```\nor\n```sql\n "), F.col("query"), F.lit("  \n```"))))
    return logged.withColumn("response", response)


def _template_sql(index: str) -> str:
    quoted = ", ".join("'" + t.replace("'", "''") + "'" for t in QUERY_TEMPLATES)
    text = f"([{quoted}])[CAST({index} AS INT) + 1]"
    for mark, col in (("{k}", "o_orderkey"), ("{c}", "o_custkey"), ("{s}", "o_orderstatus"), ("{p}", "o_orderpriority")):
        text = f"replace({text}, '{mark}', CAST({col} AS VARCHAR))"
    return text


_N = len(QUERY_TEMPLATES)
# CTE qlog, to follow WITH
QUERY_LOG = f"""qlog AS (SELECT *, CASE WHEN {u(32, 'query_id')} < 0.3 THEN query
  WHEN {u(32, 'query_id')} < 0.6 THEN 'Sure.' || chr(10) || '```sql' || chr(10) || query || chr(10) || '```' || chr(10) || 'Done.'
  ELSE '```sql SELECT 1```' || chr(10) || 'or' || chr(10) || '```sql' || chr(10) || ' ' || query || '  ' || chr(10) || '```' END AS response
  FROM (SELECT o_orderkey AS query_id, o_custkey AS user_id, {_template_sql(f'o_orderkey % {_N}')} AS query,
    {_template_sql(f"CASE WHEN {u(31, 'o_orderkey')} < 0.5 THEN o_orderkey % {_N} ELSE (o_orderkey + 1) % {_N} END")} AS predicted
  FROM orders))"""


def samples(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as samples: (doc_id, db_id, question, evidence)."""
    return read_table(spark, sf, "documents").select(
        "doc_id", F.col("lang").alias("db_id"), F.concat(F.lit("q"), F.col("doc_id")).alias("question"),
        F.col("source").alias("evidence"))


SAMPLES = "SELECT doc_id, lang AS db_id, 'q' || doc_id AS question, source AS evidence FROM documents"


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Four attempts per customer: (c_custkey, attempt, is_valid, call_failed, error)."""
    tries = read_table(spark, sf, "customer").select(
        "c_custkey", F.explode(F.expr("sequence(1L, 4L)")).alias("attempt"))
    key = F.concat_ws("-", F.col("c_custkey").cast("string"), F.col("attempt").cast("string"))
    failed = hash01(8, key) < 0.1
    valid = ~failed & (hash01(7, key) < 0.4)
    error = F.when(failed, F.concat(F.lit("call failed at "), F.col("attempt"))).when(
        ~valid, F.concat(F.lit("invalid at "), F.col("attempt")))
    return tries.select("*", valid.alias("is_valid"), failed.alias("call_failed"), error.alias("error"))


_AKEY = "c_custkey || '-' || attempt"
ATTEMPTS = f"""SELECT *, CASE WHEN call_failed THEN 'call failed at ' || attempt WHEN NOT is_valid THEN 'invalid at ' || attempt END AS error
FROM (SELECT *, NOT call_failed AND {u(7, _AKEY)} < 0.4 AS is_valid FROM (
  SELECT *, {u(8, _AKEY)} < 0.1 AS call_failed FROM (SELECT c_custkey, unnest(range(1, 5)) AS attempt FROM customer)))"""


# Declared schema of the database: files carry no keys.
SCHEMA = {
    "region": "r_regionkey INTEGER, r_name TEXT",
    "nation": "n_nationkey INTEGER, n_name TEXT, n_regionkey INTEGER",
    "customer": "c_custkey INTEGER, c_name TEXT, c_nationkey INTEGER, c_acctbal REAL, c_mktsegment TEXT",
    "supplier": "s_suppkey INTEGER, s_name TEXT, s_nationkey INTEGER, s_acctbal REAL",
    "part": "p_partkey INTEGER, p_name TEXT, p_brand TEXT, p_type TEXT, p_size INTEGER, p_retailprice REAL",
    "orders": "o_orderkey INTEGER, o_custkey INTEGER, o_orderstatus TEXT, o_totalprice REAL, "
              "o_orderdate TIMESTAMP, o_orderpriority TEXT",
    "lineitem": "l_orderkey INTEGER, l_partkey INTEGER, l_suppkey INTEGER, l_linenumber INTEGER, l_quantity REAL, "
                "l_extendedprice REAL, l_discount REAL, l_tax REAL, l_returnflag TEXT, l_linestatus TEXT, "
                "l_shipdate TIMESTAMP",
    "events": "event_id INTEGER, ts TIMESTAMP, user_id INTEGER, event_type TEXT, value REAL, props TEXT",
    "documents": "doc_id INTEGER, text TEXT, lang TEXT, source TEXT, n_chars INTEGER",
    "embeddings": "vec_id INTEGER, embedding ARRAY, label INTEGER",
    "pages": "page_id INTEGER, url TEXT, html TEXT",
    "benchmark": "item_id INTEGER, text TEXT",
    "labels": "doc_id INTEGER, quality INTEGER, toxic INTEGER",
    "conversations": "conv_id INTEGER, turn INTEGER, role TEXT, text TEXT",
}
PRIMARY_KEYS = {
    "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
    "part": ["p_partkey"], "orders": ["o_orderkey"], "events": ["event_id"], "documents": ["doc_id"],
    "embeddings": ["vec_id"], "pages": ["page_id"], "benchmark": ["item_id"], "labels": ["doc_id"],
    "conversations": ["conv_id", "turn"], "lineitem": [],
}
# (table, column, referenced table, referenced column or None = its first key column)
FOREIGN_KEYS = [
    ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", None),
    ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", None),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("labels", "doc_id", "documents", "doc_id"),
]


def schema_columns() -> list[tuple[str, str, str, int, bool]]:
    """(table, column, type, ordinal, is key) of the declared schema."""
    return [(t, *c.split(), i, c.split()[0] in PRIMARY_KEYS[t])
            for t, cols in SCHEMA.items() for i, c in enumerate(cols.split(", "))]


def quoted(value: object) -> str:
    if value is None:
        return "NULL"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value).lower()


CATALOG = ("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in schema_columns())
           + ") v(table_name, column_name, type, ordinal, is_key)")
FK_EDGES = ("SELECT * FROM (VALUES " + ", ".join(
    "(" + ", ".join(quoted(v) for v in (t, c, rt, rc or PRIMARY_KEYS[rt][0])) + ")" for t, c, rt, rc in FOREIGN_KEYS)
    + ") v(table_name, column_name, ref_table, ref_column)")


def _as_text(column: str, kind: str) -> str:
    return f"CAST({column} + 0.0::DOUBLE AS VARCHAR)" if kind == "REAL" else f"CAST({column} AS VARCHAR)"


# every value of every column as (table_name, column_name, value)
ALL_VALUES = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {_as_text(c, kind)} AS value FROM {t}"
    for t, c, kind, _, _ in schema_columns())
COLUMN_STATS = f"""SELECT table_name, column_name, count(*) AS row_count, count(value) AS non_null,
  count(DISTINCT value) AS distinct_count, count(*) - count(value) AS null_count FROM ({ALL_VALUES}) GROUP BY ALL"""
