import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deltascope.functions import text
from deltascope.operators import score


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "q string").select(expression(F.col("q"))).first()[0]


def test_last_block_wins_and_spaces_collapse(spark):
    reply = "```sql SELECT 1 ```\nthen ```sql\nSELECT\n   2\n```"
    assert one(spark, reply, text.extract_sql_block) == "SELECT 2"
    assert one(spark, "  SELECT\n\t3 ", text.extract_sql_block) == "SELECT 3"


def test_cleaning(spark):
    assert one(spark, 'a\n"b" \\\\\\"c\\\'', text.clean_query) == "a 'b' 'c'"


@pytest.mark.parametrize("sql, aggregate, limit, word", [
    ("SELECT COUNT(*) FROM t", True, False, False),
    ("SELECT a, count(*) FROM t GROUP BY a", False, False, False),
    ("SELECT credit_limit FROM t", False, True, False),
    ("SELECT a FROM t -- limit 5", False, False, False),
    ("SELECT a FROM t limit 5", False, True, True),
])
def test_shape_flags(spark, sql, aggregate, limit, word):
    assert one(spark, sql, text.is_aggregate) is aggregate
    assert one(spark, sql, text.has_limit) is limit
    assert one(spark, sql, lambda q: text.has_limit(q, whole_word=True)) is word


def test_ngrams_leave_out_aliases(spark):
    sql = "SELECT o.a AS total FROM orders AS o JOIN part p ON o.a = p.b"
    assert set(one(spark, sql, text.ngrams)) == {"select", "a", "from", "orders", "join", "part", "on", "b"}
    assert "select a" in one(spark, sql, lambda q: text.ngrams(q, 2))
    assert one(spark, "x", lambda q: text.ngrams(q, 2)) == []


def test_jaccard_of_nothing_is_zero(spark):
    assert one(spark, "", lambda q: text.jaccard(text.ngrams(q), text.ngrams(q))) == 0.0
    assert one(spark, "a b", lambda q: text.jaccard(text.ngrams(q), text.ngrams(F.lit("b c")))) == pytest.approx(1 / 3)


def test_join_pairs_resolve_aliases(spark):
    sql = "select * from A x join B as y on x.i = y.j and y.k = 3 and x.m = y.n left join C on C.p = x.q where x.r = y.s"
    got = [(p["left"], p["right"]) for p in one(spark, sql, text.join_pairs)]
    assert got == [("a.i", "b.j"), ("a.m", "b.n"), ("c.p", "a.q")]


def test_joins_after_a_bare_table_and_in_brackets(spark):
    sql = "SELECT c.x FROM orders JOIN customer c ON (orders.k = c.k)"
    assert [(p["left"], p["right"]) for p in one(spark, sql, text.join_pairs)] == [("orders.k", "customer.k")]
    assert set(one(spark, sql, text.aliases)) == {"c"}


def test_literals_stay_whole(spark):
    got = one(spark, "where a = 99.75 and b > -3 and c = 'it''s' and d = -0.5", text.conditions)
    assert [c["literal"] for c in got] == ["99.75", "-3", "it's", "-0.5"]


def test_numbers_in_conditions(spark):
    got = one(spark, "where a = 1e5 and b < .5 and c > -2.5E-3 and d = 7abc and e = 12", text.conditions)
    assert [(c["column"], c["literal"]) for c in got] == [("a", "1e5"), ("b", ".5"), ("c", "-2.5E-3"), ("e", "12")]


def test_conditions(spark):
    got = one(spark, "WHERE t.a = 'x y' AND UPPER(b) <> 'Q' and c LIKE '%z%' and d >= 10", text.conditions)
    assert [(c["column"], c["op"], c["literal"], c["in_call"]) for c in got] == [
        ("a", "=", "x y", False), ("b", "<>", "Q", True), ("c", "like", "%z%", False), ("d", ">=", "10", False)]


def test_replies(spark):
    schema = T.StructType([T.StructField("action", T.StringType())])
    for raw, action in [('{"action": "done"}', "done"), ('```json\n{"action": "done"}\n```', "done"),
                        ('[{"action": "a"}]', "a"), ("no json", None), ("[]", None)]:
        r = one(spark, raw, lambda q: text.parse_response(q, schema))
        assert (r["action"] if r else None) == action


def test_final_score_example(spark):
    runs = spark.createDataFrame([(3, 2, 1, 0, 1.0), (3, 2, 1, 2, 1.0), (6, 4, 30, 0, 1.0)],
                                 "explanation_query_turns long, fix_query_turns long, questions_asked long, retry_count long, gold_result_score double")
    got = score.final_scores(runs).select("tool_penalty", "final_score").collect()
    assert [tuple(r) for r in got] == [(0.12, 0.88), (0.12, 0.22), (1.64, 0.0)]


def test_scores_snap_down_on_ties(spark):
    df = spark.createDataFrame([("0.25",), ("0.2501",), ("0.75",), ("0.76",), ("n/a",), (None,), ("-3",), ("7",)], "raw string")
    assert [r[0] for r in df.select(score.snap_score(F.col("raw"), F.lit(False))).collect()] == [0.0, 0.5, 0.5, 1.0, 0.0, 0.0, 0.0, 1.0]


def test_type_synonyms(spark):
    df = spark.createDataFrame([(" Deletion", "delete"), ("UPDATE", "modify"), ("insert", "delete"), (None, "insert")], "p string, t string")
    assert [r[0] for r in df.select(score.type_score(F.col("p"), F.col("t"), F.lit(False))).collect()] == [1.0, 1.0, 0.0, 0.0]


def test_fix_attempts_stop(spark):
    tries = spark.createDataFrame([
        (1, 0, False, False, "a"), (1, 1, True, False, "b"), (2, 0, False, True, "a"), (2, 1, True, False, "b"),
        (3, 0, False, False, "a"), (3, 1, False, False, "b"), (3, 2, True, False, "c")],
        "k long, attempt long, passed boolean, is_fallback boolean, fix_text string")
    got = {r["k"]: (r["retry_count"], r["outcome"], r["fix_attempts"]) for r in score.resolve_fix_attempts(tries, "k").collect()}
    assert got == {1: (1, "passed", ["a", "b"]), 2: (0, "fallback", ["a"]), 3: (1, "exhausted", ["a", "b"])}


def test_fallback_rules(spark):
    events = spark.createDataFrame([
        ("ok", 1, "run_query", "x"), ("ok", 2, "done", "fix"), ("late", 1, "run_query", ""), ("late", 2, "run_query", ""), ("late", 3, "done", "x"),
        ("empty", 1, "done", " "), ("broken", 1, "failed", ""), ("broken", 2, "done", "x")], "r string, turn long, action string, text string")
    got = {r["r"]: (r["turns_used"], r["is_fallback"]) for r in score.detect_fallback(events, "r", 2).collect()}
    assert got == {"ok": (2, False), "late": (2, True), "empty": (1, True), "broken": (1, True)}


def test_pair_scores(spark):
    p = spark.createDataFrame([("g", "a", "b"), ("g", "b", "a"), ("g", "c", "d"), ("only", "x", "y")], "g string, a string, b string")
    a = spark.createDataFrame([("g", "b", "a"), ("h", "x", "y")], "g string, a string, b string")
    assert rows(score.pair_precision_recall(p, a, "g")) == [("g", 0.5, 1.0), ("h", 0.0, 0.0), ("only", 0.0, 0.0)]


def test_hard_pick_and_counts(spark):
    c = spark.createDataFrame([(1, 1, 0, True, "v"), (1, 0, 3, True, "i"), (1, 0, 1, False, "v"), (2, 0, 0, False, "v")],
                              "k long, tier long, candidate_idx long, wrong boolean, label string")
    hard = score.pick_hard(c, "k")
    assert rows(hard) == [(1, "strong", 3, "i")]
    s = spark.createDataFrame([(1, False), (2, False), (3, True)], "k long, failed boolean")
    assert tuple(score.hard_easy_counts(s, hard, "k").first()) == (1, 1, 1)


def test_stats_of_nothing(spark):
    schema = ", ".join(f"{n} double" for n in score.AVERAGES) + ", retry_count long"
    r = score.run_stats(spark.createDataFrame([], schema)).first()
    assert r["total_records"] == 0 and r["avg_final_score"] is None and r["fix_retried_count"] is None
    empty = spark.createDataFrame([], "status string, is_aggregate boolean")
    assert score.status_stats(empty).first()["success_rate"] == "0.0%"


def test_empty_bins_are_zero(spark):
    runs = spark.createDataFrame([(1.0, 0.5, 1.0, 0.0)], ", ".join(f"{n} double" for n in score.SCORE_BINS))
    got = {(r["score_name"], r["bin"]): r["n"] for r in score.score_distributions(runs).collect()}
    assert got[("explanation_score", "score_0.5")] == 1 and got[("explanation_score", "score_0.0")] == 0 and len(got) == 9
