"""Queries over snapshots: alterations, differences, restore checks, repairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from deltascope.functions.hashing import hash01, hash01_sql
from deltascope.operators import alter, diff, repair
from deltascope.plans import fixtures as fx
from deltascope.plans.fixtures import u
from deltascope.plans.registry import query
from deltascope.session import cut_lineage
from deltascope.sources.tables import read_database, read_table

ORDER_COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("alter_delete", f"""
WITH t AS ({fx.ORDERS_NULLABLE})
SELECT o_orderkey, o_orderstatus, o_totalprice FROM t WHERE NOT coalesce(o_totalprice > 250000, false)""")
def alter_delete(spark, sf):
    return (alter.delete_rows(fx.orders_nullable(spark, sf), "o_totalprice > 250000")
            .select("o_orderkey", "o_orderstatus", "o_totalprice"))


@query("alter_update", f"""
WITH t AS ({fx.ORDERS_NULLABLE})
SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_totalprice < 50000 THEN o_orderstatus || CASE WHEN o_totalprice < 25000 THEN '-LOW' ELSE '-MID' END
       ELSE o_orderstatus END AS o_orderstatus FROM t""")
def alter_update(spark, sf):
    changed = alter.update_rows(fx.orders_nullable(spark, sf), "o_totalprice < 50000", {
        "o_totalprice": "o_totalprice * 2",
        "o_orderstatus": "if(o_orderstatus is null, null, concat(o_orderstatus, if(o_totalprice < 25000, '-LOW', '-MID')))"})
    return changed.select("o_orderkey", "o_totalprice", "o_orderstatus")


@query("alter_insert", f"""
WITH new AS (SELECT CASE WHEN {u(17, 'o_orderkey')} < 0.5 THEN o_orderkey ELSE {fx.copy_key_sql('o_orderkey')} END AS o_orderkey,
  o_custkey, o_totalprice FROM orders WHERE {u(3, 'o_orderkey')} < 0.01)
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, false AS collides FROM orders
UNION ALL SELECT o_orderkey, o_custkey, NULL, o_totalprice,
  o_orderkey IN (SELECT o_orderkey FROM orders) FROM new""")
def alter_insert(spark, sf):
    """All new rows, marked where their key is taken, as half of them are."""
    base = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    key = F.col("o_orderkey")
    rows = base.filter(hash01(3, key) < 0.01).select(
        F.when(hash01(17, key) < 0.5, key).otherwise(fx.copy_key(key)).alias("o_orderkey"),
        "o_custkey", "o_totalprice")
    taken = alter.key_collisions(base, rows, ["o_orderkey"]).select("o_orderkey").distinct()
    marked = rows.join(taken.withColumn("collides", F.lit(True)), "o_orderkey", "left").withColumn(
        "collides", F.coalesce("collides", F.lit(False)))
    return alter.insert_rows(base.withColumn("collides", F.lit(False)), marked)


@query("alter_sequence", fx.WITH_ORDERS + ", " + fx.WITH_PART + """
SELECT 'orders' AS table_name, o_orderkey AS key, o_totalprice AS amount, o_orderstatus AS label FROM alt
UNION ALL SELECT 'part', p_partkey, p_retailprice, p_name FROM part_alt
UNION ALL SELECT 'customer', c_custkey, c_acctbal, c_name FROM customer""")
def alter_sequence(spark, sf):
    base = read_database(spark, sf, ["customer", "part"]) | {"orders": fx.orders_base(spark, sf)}
    altered = alter.apply_sequence(base, fx.orders_changes(base["orders"]) + fx.part_changes())
    picks = {"orders": ("o_orderkey", "o_totalprice", "o_orderstatus"),
             "part": ("p_partkey", "p_retailprice", "p_name"),
             "customer": ("c_custkey", "c_acctbal", "c_name")}
    parts = [altered[t].select(F.lit(t).alias("table_name"), F.col(k).alias("key"),
                               F.col(v).alias("amount"), F.col(label).alias("label"))
             for t, (k, v, label) in picks.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("snapshot_delta", f"""
WITH delta AS ({fx.ORDER_DELTAS}), per_record AS (
  SELECT record_id,
    count_if(op <> 'delete') - count_if(o.o_orderkey IS NOT NULL) AS d_rows,
    sum(CASE WHEN op <> 'delete' THEN CAST(delta.o_totalprice AS DECIMAL(18,2)) ELSE 0 END
      - coalesce(CAST(o.o_totalprice AS DECIMAL(18,2)), 0)) AS d_sum
  FROM delta LEFT JOIN orders o ON delta.o_orderkey = o.o_orderkey GROUP BY record_id)
SELECT record_id, CAST((SELECT count(*) FROM orders) + d_rows AS BIGINT) AS n_rows,
  CAST((SELECT sum(CAST(o_totalprice AS DECIMAL(18,2))) FROM orders) + d_sum AS DOUBLE) AS sum_o_totalprice
FROM per_record""")
def snapshot_delta(spark, sf):
    return alter.snapshot_totals(fx.orders_base(spark, sf), fx.order_deltas(spark, sf),
                                 ["o_orderkey"], "o_totalprice")


@query("snapshot_changes", f"""
WITH delta AS ({fx.ORDER_DELTAS})
SELECT record_id, op, delta.o_orderkey, o.o_totalprice AS old_o_totalprice, delta.o_totalprice AS new_o_totalprice
FROM delta LEFT JOIN orders o ON delta.o_orderkey = o.o_orderkey""")
def snapshot_changes(spark, sf):
    return alter.snapshot_changes(fx.orders_base(spark, sf), fx.order_deltas(spark, sf),
                                  ["o_orderkey"], ["o_totalprice"]).drop("had")


@query("diff_set", fx.WITH_ORDERS + """
SELECT 'original' AS side, * FROM (SELECT * FROM base EXCEPT SELECT * FROM alt)
UNION ALL SELECT 'altered', * FROM (SELECT * FROM alt EXCEPT SELECT * FROM base)""")
def diff_set(spark, sf):
    return diff.diff_set(fx.orders_base(spark, sf), fx.orders_altered(spark, sf))


@query("diff_bag", f"""
WITH a AS (SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem),
b AS (SELECT * FROM a UNION ALL SELECT * FROM a WHERE {u(4, 'l_orderkey')} < 0.01)
SELECT 'original' AS side, count(*) AS copies, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT 'altered', count(*), * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL""")
def diff_bag(spark, sf):
    return diff.diff_bag(*fx.lineitem_dup(spark, sf))


@query("diff_bag_wide", f"""
WITH b AS (SELECT doc_id, CASE WHEN {u(2, 'doc_id')} < 0.02 THEN text || ' (changed)' ELSE text END AS text, lang, source, n_chars
  FROM documents WHERE NOT ({u(1, 'doc_id')} < 0.01))
SELECT 'original' AS side, count(*) AS copies, * FROM (SELECT * FROM documents EXCEPT ALL SELECT * FROM b) GROUP BY ALL
UNION ALL SELECT 'altered', count(*), * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM documents) GROUP BY ALL""")
def diff_bag_wide(spark, sf):
    base = read_table(spark, sf, "documents")
    altered = alter.update_rows(alter.delete_rows(base, hash01_sql(1, "doc_id") + " < 0.01"),
                                hash01_sql(2, "doc_id") + " < 0.02", {"text": "concat(text, ' (changed)')"})
    return diff.diff_bag(base, altered, wide=True)


_KEYED_OUT = ", ".join([f"a.{c} AS old_{c}" for c in ORDER_COLUMNS] + [f"b.{c} AS new_{c}" for c in ORDER_COLUMNS])
_KEYED_CHANGED = "concat_ws(',', " + ", ".join(
    f"CASE WHEN a.{c} IS DISTINCT FROM b.{c} THEN '{c}' END" for c in ORDER_COLUMNS) + ")"
_KEYED = f"""SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey,
  CASE WHEN b.o_orderkey IS NULL THEN 'deleted' WHEN a.o_orderkey IS NULL THEN 'inserted' ELSE 'modified' END AS change,
  CASE WHEN a.o_orderkey IS NOT NULL AND b.o_orderkey IS NOT NULL THEN {_KEYED_CHANGED} END AS changed_columns,
  {_KEYED_OUT}
FROM base a FULL JOIN alt b ON a.o_orderkey = b.o_orderkey
WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR {" OR ".join(f"a.{c} IS DISTINCT FROM b.{c}" for c in ORDER_COLUMNS)}"""


def orders_keyed_diff(spark, sf, wide=False):
    return diff.diff_keyed(fx.orders_base(spark, sf), fx.orders_altered(spark, sf), ["o_orderkey"], wide)


@query("diff_keyed", fx.WITH_ORDERS + _KEYED)
def diff_keyed(spark, sf):
    return orders_keyed_diff(spark, sf)


@query("diff_keyed_wide", fx.WITH_ORDERS + _KEYED)
def diff_keyed_wide(spark, sf):
    return orders_keyed_diff(spark, sf, wide=True)


def database_pair(spark, sf):
    """Customer, orders and part before and after the standard alterations."""
    base = read_database(spark, sf, ["customer", "part"]) | {"orders": fx.orders_base(spark, sf)}
    return base, alter.apply_sequence(base, fx.orders_changes(base["orders"]) + fx.part_changes())


def _counts_sql(table: str, a: str, b: str) -> str:
    return f"""SELECT '{table}' AS table_name, (SELECT count(*) FROM {a}) AS n_original, (SELECT count(*) FROM {b}) AS n_candidate,
  (SELECT count(*) FROM (SELECT * FROM {a} EXCEPT SELECT * FROM {b})) AS only_original,
  (SELECT count(*) FROM (SELECT * FROM {b} EXCEPT SELECT * FROM {a})) AS only_candidate,
  (SELECT count(*) FROM (SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b})) AS copies_original,
  (SELECT count(*) FROM (SELECT * FROM {b} EXCEPT ALL SELECT * FROM {a})) AS copies_candidate"""


_COUNTS = " UNION ALL ".join([_counts_sql("orders", "base", "alt"), _counts_sql("part", "part", "part_alt"),
                              _counts_sql("customer", "customer", "customer")])


@query("diff_counts", f"{fx.WITH_ORDERS}, {fx.WITH_PART} {_COUNTS}")
def diff_counts(spark, sf):
    return diff.diff_counts(*database_pair(spark, sf))


_FIRST = ("customer", "documents", "events", "labels", "lineitem", "orders", "part", "supplier")
_SECOND = ("customer", "documents", "events", "lineitem", "orders", "orders_backup", "part")


def _table_list(names, backup="orders"):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {backup if n == 'orders_backup' else n}) AS n" for n in names)


@query("diff_table_sets", f"""
WITH a AS ({_table_list(_FIRST)}), b AS ({_table_list(_SECOND)})
SELECT coalesce(a.table_name, b.table_name) AS table_name,
  CASE WHEN b.n IS NULL THEN 'missing' WHEN a.n IS NULL THEN 'extra' ELSE 'common' END AS status,
  a.n AS n_first, b.n AS n_second FROM a FULL JOIN b ON a.table_name = b.table_name""")
def diff_table_sets(spark, sf):
    tables = read_database(spark, sf) | {"orders_backup": read_table(spark, sf, "orders")}
    return diff.diff_table_sets({n: tables[n] for n in _FIRST}, {n: tables[n] for n in _SECOND})


@query("diff_verdict", f"""{fx.WITH_ORDERS}, {fx.WITH_PART}, counts AS ({_COUNTS}), msg AS (
SELECT table_name, CASE WHEN n_original <> n_candidate THEN
    'table ''' || table_name || ''': row count differs (original=' || format('{{:,}}', n_original) || ', candidate=' || format('{{:,}}', n_candidate) || ')'
  WHEN copies_original > 0 OR copies_candidate > 0 THEN
    'table ''' || table_name || ''': ' || copies_original || ' row(s) only in original, ' || copies_candidate || ' row(s) only in candidate'
  END AS m FROM counts)
SELECT count(m) = 0 AS matches, coalesce(string_agg(m, '; ' ORDER BY table_name), '') AS summary FROM msg""")
def diff_verdict(spark, sf):
    return diff.diff_verdict(*database_pair(spark, sf))


def _restore_sql(fix: str, table: str, a: str, b: str) -> str:
    return f"""SELECT '{fix}' AS fix, '{table}' AS table_name, (SELECT count(*) FROM {a}) AS n_original,
  (SELECT count(*) FROM {b}) AS n_fixed, (SELECT count(*) FROM (SELECT * FROM {a} EXCEPT SELECT * FROM {b})) AS missing_rows"""


@query("restore_check", f"""{fx.WITH_ORDERS}, {fx.WITH_FIXED}, c AS (
{" UNION ALL ".join(_restore_sql(f, "orders", "base", f"fixed_{f}") for f in ("full", "partial", "bad"))}
UNION ALL SELECT f, 'part', (SELECT count(*) FROM part), NULL, NULL FROM (VALUES ('full'), ('partial'), ('bad')) v(f))
SELECT *, CASE WHEN n_fixed IS NULL THEN 'table ''' || table_name || ''' missing or unreadable in fixed DB'
  WHEN n_original <> n_fixed THEN 'table ''' || table_name || ''': row count changed from ' || format('{{:,}}', n_original)
     || ' to ' || format('{{:,}}', n_fixed) || ' after fix'
  WHEN missing_rows > 0 THEN 'table ''' || table_name || ''': ' || missing_rows || ' original row(s) missing after fix' END AS message
FROM c""")
def restore_check(spark, sf):
    original = {"orders": fx.orders_base(spark, sf), "part": read_table(spark, sf, "part")}
    parts = [diff.restore_check(original, {"orders": fixed}).withColumn("fix", F.lit(name))
             for name, fixed in fx.orders_fixed(spark, sf).items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_RENDER = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]


def _line(cells: list[str], left: str, mid: str, right: str) -> str:
    return f"'{left}' || " + f" || '{mid}' || ".join(cells) + f" || '{right}'"


@query("diff_render", f"""{fx.WITH_ORDERS}, d AS (
SELECT 'original' AS side, * FROM (SELECT * FROM base EXCEPT SELECT * FROM alt)
UNION ALL SELECT 'altered', * FROM (SELECT * FROM alt EXCEPT SELECT * FROM base)),
t AS (SELECT side, o_orderkey AS k, o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey,
  CASE WHEN o_orderstatus = 'X' THEN 'NULL' ELSE o_orderstatus END AS o_orderstatus,
  CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS o_totalprice, o_orderdate FROM d),
w AS (SELECT side, {", ".join(f"greatest(max(length({c})), {len(c)}) AS w_{c}" for c in _RENDER)} FROM t GROUP BY side)
SELECT 'orders' AS table_name, t.side, 2 + row_number() OVER (PARTITION BY t.side ORDER BY k) AS line_no,
  {_line([f"rpad({c}, w_{c}::INT, ' ')" for c in _RENDER], "| ", " | ", " |")} AS line FROM t JOIN w ON t.side = w.side
UNION ALL SELECT 'orders', side, 0, upper(side[1]) || side[2:] || ' Records:' FROM w
UNION ALL SELECT 'orders', side, 1, {_line([f"rpad('{c}', w_{c}::INT, ' ')" for c in _RENDER], "| ", " | ", " |")} FROM w
UNION ALL SELECT 'orders', side, 2, {_line([f"repeat('-', w_{c})" for c in _RENDER], "|-", "-|-", "-|")} FROM w""")
def diff_render(spark, sf):
    # the changes are written once: widths, numbers and lines read them
    d = cut_lineage(diff.diff_set(fx.orders_base(spark, sf), fx.orders_altered(spark, sf)))
    shown = (d.withColumn("k", F.col("o_orderkey"))
             .withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
             .withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'X')")))
    return diff.render_diff("orders", shown, _RENDER, ["k"], F.floor(F.col("k") / fx.ORDER_BUCKET))


@query("fix_evaluate", f"""WITH base AS ({fx.ORDERS_BASE}), alt AS ({fx.RECORD_ALTERATIONS}), fixes AS ({fx.RECORD_FIXES}),
touched AS (SELECT record_id, o_orderkey FROM alt UNION SELECT record_id, o_orderkey FROM fixes),
recs AS (SELECT DISTINCT record_id FROM touched),
altered AS (SELECT r.record_id, b.* FROM recs r, base b WHERE NOT EXISTS (SELECT 1 FROM alt a WHERE a.record_id = r.record_id AND a.o_orderkey = b.o_orderkey)
  UNION ALL SELECT record_id, {", ".join(["o_orderkey", *ORDER_COLUMNS])} FROM alt WHERE op <> 'delete'),
fixed AS (SELECT b.* FROM altered b WHERE NOT EXISTS (SELECT 1 FROM fixes f WHERE f.record_id = b.record_id AND f.o_orderkey = b.o_orderkey)
  UNION ALL SELECT record_id, {", ".join(["o_orderkey", *ORDER_COLUMNS])} FROM fixes WHERE op <> 'delete'),
gold AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM base WHERE o_totalprice > 100000 GROUP BY ALL),
got AS (SELECT record_id, o_orderstatus, o_orderpriority, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM fixed WHERE o_totalprice > 100000 GROUP BY ALL),
want AS (SELECT record_id, gold.* FROM recs, gold),
miss AS (SELECT record_id, count(*) AS k FROM (SELECT * FROM want EXCEPT SELECT * FROM got) GROUP BY 1),
more AS (SELECT record_id, count(*) AS k FROM (SELECT * FROM got EXCEPT SELECT * FROM want) GROUP BY 1),
sizes AS (SELECT record_id, count(*) AS k FROM got GROUP BY 1),
tb AS (SELECT record_id, b.* FROM touched JOIN base b USING (o_orderkey)),
tf AS (SELECT record_id, {", ".join(["o_orderkey", *ORDER_COLUMNS])} FROM fixed JOIN touched USING (record_id, o_orderkey)),
undone AS (SELECT record_id, count(DISTINCT o_orderkey) AS k FROM (
  (SELECT * FROM tb EXCEPT SELECT * FROM tf) UNION ALL (SELECT * FROM tf EXCEPT SELECT * FROM tb)) GROUP BY 1),
x AS (SELECT r.record_id, coalesce(miss.k, 0) AS missing_rows, coalesce(more.k, 0) AS extra_rows, coalesce(undone.k, 0) AS unrestored,
  coalesce(sizes.k, 0) AS n_got, {fx.RECORD_ERROR} AS error FROM recs r LEFT JOIN miss USING (record_id) LEFT JOIN more USING (record_id)
  LEFT JOIN undone USING (record_id) LEFT JOIN sizes USING (record_id))
SELECT record_id, (error IS NULL AND missing_rows + extra_rows = 0)::INT::DOUBLE AS gold_result_score,
  (error IS NULL AND missing_rows + extra_rows + unrestored = 0)::INT::DOUBLE AS full_restore_score,
  CASE WHEN error IS NULL THEN missing_rows ELSE 0 END AS missing_rows, CASE WHEN error IS NULL THEN extra_rows ELSE 0 END AS extra_rows,
  CASE WHEN error IS NULL THEN unrestored ELSE 0 END AS unrestored,
  CASE WHEN error IS NOT NULL THEN 'Fix SQL execution failed: ' || error
    WHEN missing_rows + extra_rows + unrestored = 0 THEN 'gold_result matches and DB fully restored to original'
    WHEN missing_rows + extra_rows = 0 THEN 'gold_result matches but DB not fully restored'
    ELSE 'gold_sql result mismatch: expected ' || (SELECT count(*) FROM gold) || ' row(s), got ' || n_got || ' row(s). Missing: '
      || missing_rows || ' row(s), extra: ' || extra_rows || ' row(s)' END AS description FROM x""")
def fix_evaluate(spark, sf):
    base = fx.orders_base(spark, sf)
    altered, fixes, errors = fx.record_fixes(spark, sf)
    return repair.evaluate_fixes(base, altered, fixes, ["o_orderkey"], errors, "o_totalprice > 100000",
                                 ["o_orderstatus", "o_orderpriority"], "o_totalprice")


@query("repair_from_diff", f"""{fx.WITH_ORDERS}, d AS ({_KEYED})
SELECT CASE change WHEN 'deleted' THEN 'insert' WHEN 'modified' THEN 'update' ELSE 'delete' END AS op,
  o_orderkey, {", ".join(f"old_{c} AS {c}" for c in ORDER_COLUMNS)} FROM d""")
def repair_from_diff(spark, sf):
    return repair.repair_from_diff(orders_keyed_diff(spark, sf), ["o_orderkey"], ORDER_COLUMNS)
