import pytest
from conftest import rows
from pyspark.sql import functions as F

from deltascope.operators import alter, diff, repair
from deltascope.operators.alter import Alteration
from deltascope.plans import fixtures as fx


def table(spark, data, schema="k long, v double, s string"):
    return spark.createDataFrame(data, schema)


BASE = [(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None)]


def test_delete_keeps_rows_with_null_predicate(spark):
    assert rows(alter.delete_rows(table(spark, BASE), "v > 0").select("k")) == [(2,)]


def test_update_sees_the_old_row_and_keeps_types(spark):
    out = alter.update_rows(table(spark, BASE), "k = 1", {"k": "k + 10", "v": "k", "s": "concat(s, k)"})
    assert (11, 1.0, "a1") in rows(out)
    assert [f.dataType for f in out.schema] == [f.dataType for f in table(spark, BASE).schema]


def test_update_of_unknown_column_fails(spark):
    with pytest.raises(ValueError):
        alter.update_rows(table(spark, BASE), "true", {"nope": "1"})


def test_insert_fills_missing_columns_and_finds_collisions(spark):
    new = spark.createDataFrame([(3, 9), (4, 9)], "k int, v int")
    out = alter.insert_rows(table(spark, BASE), new)
    assert (4, 9.0, None) in rows(out)
    assert rows(alter.key_collisions(table(spark, BASE), new, ["k"]).select("k")) == [(3,)]


def test_sequence_leaves_other_tables_alone_and_applies_nothing_on_error(spark):
    tables = {"a": table(spark, BASE), "b": table(spark, BASE)}
    out = alter.apply_sequence(tables, [Alteration("a", "delete", "k = 1")])
    assert out["b"] is tables["b"]
    with pytest.raises(KeyError):
        alter.apply_sequence(tables, [Alteration("zzz", "delete", "true")])


def test_snapshot_totals_equal_each_materialised_snapshot(spark, sf):
    base = fx.orders_base(spark, sf).select("o_orderkey", "o_totalprice")
    deltas = fx.order_deltas(spark, sf)
    totals = {r["record_id"]: r for r in alter.snapshot_totals(base, deltas, ["o_orderkey"], "o_totalprice").collect()}
    for record in (3, 60):
        one = alter.snapshot(base, deltas.filter(F.col("record_id") == record), ["o_orderkey"])
        n, total = one.agg(F.count("*"), F.sum(F.col("o_totalprice").cast("decimal(20,2)")).cast("double")).first()
        assert (totals[record]["n_rows"], totals[record]["sum_o_totalprice"]) == (n, total)


def test_set_diff_misses_copies_that_bag_diff_sees(spark):
    a = table(spark, [BASE[0], BASE[0], BASE[1]])
    b = table(spark, [BASE[0], BASE[1], BASE[1]])
    assert diff.diff_set(a, b).count() == 0
    assert rows(diff.diff_bag(a, b).select("side", "copies", "k")) == [("altered", 1, 2), ("original", 1, 1)]
    verdict = diff.diff_verdict({"t": a}, {"t": b}).first()
    assert not verdict["matches"] and "1 row(s) only in original, 1 row(s) only in candidate" in verdict["summary"]


def test_diff_of_equal_tables_is_empty_and_mirrors(spark, sf):
    a, b = fx.orders_base(spark, sf), fx.orders_altered(spark, sf)
    assert diff.diff_bag(a, a).count() == 0 and diff.diff_keyed(a, a, ["o_orderkey"]).count() == 0
    there = rows(diff.diff_set(a, b).filter("side = 'original'").drop("side"))
    back = rows(diff.diff_set(b, a).filter("side = 'altered'").drop("side"))
    assert there == back and there


def test_wide_diff_equals_plain_diff(spark, sf):
    a, b = fx.orders_nullable(spark, sf), fx.orders_altered(spark, sf)
    assert rows(diff.diff_bag(a, b)) == rows(diff.diff_bag(a, b, wide=True))
    assert rows(diff.diff_keyed(a, b, ["o_orderkey"])) == rows(diff.diff_keyed(a, b, ["o_orderkey"], wide=True))


def test_diff_does_not_depend_on_partitions(spark, sf):
    a, b = fx.orders_base(spark, sf), fx.orders_altered(spark, sf)
    assert rows(diff.diff_bag(a, b)) == rows(diff.diff_bag(a.repartition(1), b.repartition(7)))


def test_repair_undoes_the_alteration(spark, sf):
    a, b = fx.orders_base(spark, sf), fx.orders_altered(spark, sf)
    values = [c for c in a.columns if c != "o_orderkey"]
    delta = repair.repair_from_diff(diff.diff_keyed(a, b, ["o_orderkey"]), ["o_orderkey"], values)
    fixed = alter.snapshot(b, delta, ["o_orderkey"])
    assert diff.diff_bag(a, fixed).count() == 0


def test_verdict_names_missing_tables(spark):
    t = table(spark, BASE)
    out = diff.diff_verdict({"a": t, "b": t}, {"a": t, "c": t}).first()
    assert out["summary"] == "tables missing from second db: ['b']; extra tables in second db: ['c']"
    assert diff.diff_verdict({"a": t}, {"a": t}).first()["matches"]


def test_copies_keep_apart_from_keys_of_any_size(spark):
    a = spark.createDataFrame([(10**9 + 5, 1), (3, 2), (2**62, 3)], "k long, v int")
    copies = a.withColumn("k", fx.copy_key(F.col("k")))
    b = a.unionByName(copies)
    assert {r["change"] for r in diff.diff_keyed(a, b, ["k"]).collect()} == {"inserted"}
    delta = repair.repair_from_diff(diff.diff_keyed(a, b, ["k"]), ["k"], ["v"])
    assert diff.diff_bag(a, alter.snapshot(b, delta, ["k"])).count() == 0


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, v int")
    b = spark.createDataFrame([(None, 3), (2, 2)], "k int, v int")
    for wide in (False, True):
        assert diff.diff_keyed(a, a, ["k"], wide=wide).count() == 0
        assert rows(diff.diff_keyed(a, b, ["k"], wide=wide).select("k", "change")) == [(None, "modified")]


def test_insert_refuses_taken_and_repeated_keys(spark):
    t = spark.createDataFrame([(1, 1), (2, 2)], "k int, v int")
    good = spark.createDataFrame([(3, 3), (4, 4)], "k int, v int")
    assert alter.apply_one({"t": t}, Alteration("t", "insert", rows=good, pk=["k"]))["t"].count() == 4
    for bad in ([(1, 9)], [(5, 1), (5, 2)]):
        new = spark.createDataFrame(bad, "k int, v int")
        with pytest.raises(Exception, match="key is taken"):
            alter.apply_one({"t": t}, Alteration("t", "insert", rows=new, pk=["k"]))["t"].collect()


def test_a_fix_is_applied_to_the_altered_table(spark):
    base = spark.createDataFrame([(1, "a", 200.0), (2, "a", 300.0), (3, "b", 50.0)], "k long, g string, p double")
    cols = "record_id long, op string, k long, g string, p double"
    altered = spark.createDataFrame([(1, "delete", 1, None, None), (2, "delete", 1, None, None), (3, "update", 3, "b", 60.0),
                                     (4, "insert", -2, "c", 500.0), (5, "delete", 1, None, None)], cols)
    fixes = spark.createDataFrame([(1, "insert", 1, "a", 200.0), (2, "insert", 1, "a", 201.0), (3, "update", 2, "a", 300.0)], cols)
    errors = spark.createDataFrame([(5, "no such table")], "record_id long, error string")
    out = {r["record_id"]: r for r in repair.evaluate_fixes(base, altered, fixes, ["k"], errors, "p > 100", ["g"], "p").collect()}
    assert [(out[i]["gold_result_score"], out[i]["full_restore_score"]) for i in range(1, 6)] == [(1, 1), (0, 0), (1, 0), (0, 0), (0, 0)]
    assert out[2]["description"] == "gold_sql result mismatch: expected 1 row(s), got 1 row(s). Missing: 1 row(s), extra: 1 row(s)"
    assert out[4]["description"] == "gold_sql result mismatch: expected 1 row(s), got 2 row(s). Missing: 0 row(s), extra: 1 row(s)"
    assert out[5]["description"] == "Fix SQL execution failed: no such table"


def test_insert_keeps_rows_whose_key_is_taken(spark, tmp_path):
    """Every drawn row is there, marked, whether its key is taken or not."""
    from __spark_entry__ import queries
    spark.range(4000).selectExpr("id o_orderkey", "id o_custkey", "'O' o_orderstatus", "1.5D o_totalprice").write.parquet(
        str(tmp_path / "orders.parquet"))
    out = queries()["alter_insert"](spark, str(tmp_path)).filter("o_orderstatus IS NULL").groupBy("collides").count()
    found = dict(rows(out))
    drawn = spark.range(4000).filter(fx.hash01(3, F.col("id")) < 0.01).count()
    assert set(found) == {True, False} and sum(found.values()) == drawn
