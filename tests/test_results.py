import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from deltascope.functions.hashing import row_key
from deltascope.functions.ranking import bucketed_neighbour, bucketed_row_number
from deltascope.operators import sampling, validate


def test_row_key_normalises_numbers_and_keeps_nulls(spark):
    a = spark.createDataFrame([(1.0, 'x"y', None)], "b double, a string, c string")
    b = spark.createDataFrame([(None, 'x"y', 1)], "c string, a string, b int")
    key = a.select(row_key(a)).first()[0]
    assert key == b.select(row_key(b)).first()[0]
    assert key == '{"a": "x\\"y", "b": 1, "c": null}'
    half = spark.createDataFrame([(0.5,)], "b double")
    assert half.select(row_key(half)).first()[0] == '{"b": 0.5}'


def test_row_key_of_large_numbers(spark):
    a = spark.createDataFrame([(1e16,)], "a double")
    b = spark.createDataFrame([(10**16,)], "a long")
    assert a.select(row_key(a)).first() == b.select(row_key(b)).first()
    c = spark.createDataFrame([(1e30,), (float("nan"),)], "a double")
    assert c.select(row_key(c)).first()[0] == '{"a": 1000000000000000000000000000000}'


def test_rows_without_an_order_value_get_numbers(spark):
    df = spark.createDataFrame([("a", None), ("a", 5), ("a", 250)], "k string, v int")
    got = bucketed_row_number(df, ["k"], [F.col("v")], F.floor(F.col("v") / 100))
    assert rows(got.select("v", "row_no")) == rows(spark.createDataFrame([(None, 1), (5, 2), (250, 3)], "v int, n long"))
    near = bucketed_neighbour(df, ["k"], ["v"], F.floor(F.col("v") / 100), ["v"], "next")
    assert near.count() == 3


def long(spark, data):
    return spark.createDataFrame(data, "sample_id long, v string, n double")


def compared(spark, gold, altered, target=()):
    return validate.compare_results(long(spark, gold), long(spark, altered), long(spark, list(target)), ["v", "n"])


def test_targets_must_vanish(spark):
    c = compared(spark, [(1, "a", 1.0), (1, "b", None), (1, "c", 3.0)], [(1, "b", None), (1, "d", 4.0)],
                 [(1, "a", 1.0), (1, "b", None)])
    assert {r["v"]: r["status"] for r in validate.targeted(c).collect()} == {"a": "missing_targeted", "b": "still_present"}
    assert [r["v"] for r in validate.unintended(c).collect()] == ["c"]
    assert [r["v"] for r in validate.new_rows(c).collect()] == ["d"]
    r = validate.report(c, ["v", "n"]).first()
    assert not r["is_valid"]
    assert r["error_message"] == '1 targeted record(s) still present in altered result: [{"n": null, "v": "b"}]'


def test_insert_rule(spark):
    same = [(1, "a", 1.0)]
    c = compared(spark, same, same)
    r = validate.report_insert(c, F.lit(True)).first()
    assert r["error_message"] == f"{validate.SAME_RESULT} | {validate.NOT_DISPLACED}"
    grown = compared(spark, same, same + [(1, "b", 2.0)])
    assert validate.report_insert(grown, F.lit(False)).first()["is_valid"]
    assert validate.report_insert(grown, F.lit(True)).first()["error_message"] == validate.NOT_DISPLACED


def test_aggregate_rule(spark):
    samples = spark.createDataFrame([(1,), (2,), (3,)], "sample_id long")
    gold = spark.createDataFrame([(1, 5), (2, 5)], "sample_id long, n int")
    altered = spark.createDataFrame([(1, 5), (2, 6)], "sample_id long, n int")
    out = {r["sample_id"]: r for r in validate.report_aggregate(samples, gold, altered, ["n"]).collect()}
    assert 'Gold: {"n": 5} | Altered: {"n": 5}' in out[1]["error_message"]
    assert out[2]["is_valid"] and out[3]["error_message"] == validate.EMPTY_RESULT


def test_execution_match_rules(spark):
    gold = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    twice = gold.union(gold).toDF("p", "q")
    assert tuple(validate.execution_match(twice, gold).first()) == (1, "--")
    empty = gold.limit(0)
    assert tuple(validate.execution_match(empty, empty).first()) == (0, "incorrect answer")
    assert tuple(validate.execution_match(None, gold, "timeout").first()) == (0, "timeout")


def test_positional_diff_shows_ten(spark):
    a = spark.range(30).select(F.col("id").alias("k"), F.lit("x").alias("s"))
    b = a.withColumn("s", F.when(F.col("k") < 12, None).otherwise(F.col("s")))
    m = validate.positional_diff(a, b, ["k"], ["k", "s"], F.floor(F.col("k") / 7))
    text = validate.positional_summary(a, b, ["k"], ["k", "s"], F.floor(F.col("k") / 7)).first()["message"]
    assert text.startswith("12 row(s) differ") and text.endswith("… and 2 more mismatched row(s)")
    assert "Row 0: column 's': original=\"x\", restored=null" in text and text.count("\nRow ") == 10


def skewed(spark):
    """One key holds most rows."""
    return spark.range(2000).select(F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 5).alias("k"),
                                    (F.col("id") * 7919 % 2003).alias("v"))


def test_bucketed_numbers_equal_a_window(spark):
    df = skewed(spark)
    expected = df.withColumn("row_no", F.row_number().over(Window.partitionBy("k").orderBy("v")))
    got = bucketed_row_number(df, ["k"], [F.col("v")], F.floor(F.col("v") / 100))
    assert rows(got.select("k", "v", "row_no")) == rows(expected.select("k", "v", "row_no"))
    whole = bucketed_row_number(df, [], [F.col("v")], F.floor(F.col("v") / 100))
    ordered = [r["v"] for r in df.orderBy("v").collect()]
    assert [tuple(r) for r in whole.select("v", "row_no").orderBy("row_no").collect()] == [
        (v, i + 1) for i, v in enumerate(ordered)]


def test_bucketed_neighbours_equal_lead_and_lag(spark):
    df = skewed(spark).filter("v % 3 = 0")
    w = Window.partitionBy("k").orderBy("v")
    expected = df.select("k", "v", F.lead("v").over(w).alias("n"), F.lag("v").over(w).alias("p"))
    after = bucketed_neighbour(df, ["k"], ["v"], F.floor(F.col("v") / 50), ["v"], "after")
    both = bucketed_neighbour(after, ["k"], ["v"], F.floor(F.col("v") / 50), ["v"], "before", backward=True)
    assert rows(both.select("k", "v", "after.v", "before.v")) == rows(expected)


def test_draws(spark):
    u = spark.createDataFrame([(0.0,), (0.33999,), (0.34,), (0.669,), (0.68,)], "u double")
    assert [r[0] for r in u.select(sampling.draw_type(F.col("u"))).collect()] == [
        "delete", "delete", "insert", "insert", "modify"]
    assert [r[0] for r in u.select(sampling.fallback_type(F.col("u"), 0.0, 1.0)).collect()] == [
        "delete", "delete", "delete", "modify", "modify"]  # no weight at all: one half
    with pytest.raises(ValueError):
        sampling.draw_type(F.lit(0.1), 0.7, 0.7)


def test_sample_does_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    a = rows(sampling.seeded_sample(df.repartition(1), "k", 7, 20))
    assert a == rows(sampling.seeded_sample(df.repartition(9), "k", 7, 20)) and len(a) == 20
    assert sampling.seeded_sample(df, "k", 7, 0).count() == 500


def test_ids_continue_without_gaps(spark):
    out = sampling.assign_ids(spark.range(300).withColumnRenamed("id", "k"), "k", F.lit(40), 5)
    assert sorted(r["record_id"] for r in out.collect()) == list(range(41, 341))


def test_targets_are_bounded_and_distinct(spark):
    df = skewed(spark).select(F.col("k").alias("sample_id"), "v").distinct()
    picked = sampling.target_pick(df, "v", 3).groupBy("sample_id").agg(
        F.count("*").alias("n"), F.max("num_targets").alias("k"), F.countDistinct("v").alias("d")).collect()
    assert all(r["n"] == r["k"] == r["d"] <= 5 for r in picked)


def test_first_valid_attempt_wins(spark):
    attempts = spark.createDataFrame([
        (1, 1, False, True, "call"), (1, 2, True, False, None), (1, 3, True, False, None),
        (2, 1, False, False, "bad 1"), (2, 2, False, False, "bad 2"), (2, 3, False, True, "call 3"),
        (2, 4, True, False, None)], "k long, attempt long, is_valid boolean, call_failed boolean, error string")
    out = {r["k"]: r for r in sampling.select_attempt(attempts, "k").collect()}
    assert (out[1]["status"], out[1]["valid_attempt"], out[1]["attempts_made"], out[1]["last_error"]) == ("success", 2, 2, "call")
    assert (out[2]["status"], out[2]["attempts_made"], out[2]["last_error"]) == ("failed_llm", 3, "call 3")


def test_numbers_by_drawn_ranges(spark):
    """Skewed, NULL and tied keys of several columns."""
    from deltascope.functions.ranking import ranged_row_number
    df = spark.range(2000).select(F.when(F.col("id") % 50 > 0, F.lit(7)).otherwise(F.col("id") * 10**15).alias("a"),
                                  F.when(F.col("id") % 9 > 0, F.col("id") % 400).alias("b"), "id")
    got = sorted(((r["row_no"], r["a"], r["b"], r["id"]) for r in ranged_row_number(df, ["a", "b", "id"]).collect()))
    want = sorted(((r["a"], r["b"], r["id"]) for r in df.collect()), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
    assert got == [(i + 1, *r) for i, r in enumerate(want)]
