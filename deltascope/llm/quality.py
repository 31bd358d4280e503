"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import let, named
from deltascope.session import cut_lineage

SPACES = " \t\n\x0b\x0c\r"
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Documents, about, on which costs and rejections are estimated; the verdicts don't depend on it.
SAMPLE_ROWS = 2000


def words_of(text: Column) -> Column:
    """The words of a text, none for a NULL or blank one."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE))


def _met_again(keyed: Column) -> Column:
    """Positions, ascending, of the (key, i) structs whose key is there twice or more."""
    return let(F.sort_array(keyed), lambda s: F.sort_array(F.transform(F.filter(
        F.transform(s, lambda x, j: F.struct(
            x["i"].alias("i"),
            (((j > 0) & (F.get(s, j - 1)["key"] == x["key"]))
             | ((j < F.size(s) - 1) & (F.get(s, j + 1)["key"] == x["key"]))).alias("twice"))),
        lambda y: y["twice"]), lambda y: y["i"])))


def _covered(starts: Column, width: int) -> Column:
    """Number of positions in windows of ``width`` at the ascending ``starts``."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    return F.aggregate(starts, zero, lambda acc, p: F.struct(
        (p + width).alias("end"), (acc["n"] + p + width - F.greatest(p, acc["end"])).alias("n")), lambda acc: acc["n"])


def repeated_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more in the text.

    Hashes find the windows that may repeat; those are compared as text.
    """
    def window(w: Column, i: Column) -> list[Column]:
        return [F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)]

    def compare(w: Column, hashes: Column) -> Column:
        likely = _met_again(F.transform(hashes, lambda h, i: F.struct(h.alias("key"), i.alias("i"))))
        exact = _met_again(F.transform(likely, lambda i: F.struct(F.concat_ws(" ", *window(w, i)).alias("key"), i.alias("i"))))
        return _covered(exact, 3)

    def count(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(*window(w, i)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(compare(w, h)))

    return F.when(F.size(words) < 4, 0).otherwise(count(words))


def base_columns(text: Column) -> dict[str, Column]:
    """Expressions of the base figures; ``of_words`` is a struct of those taken from the list of words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    of_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        repeated_words(w).cast("long").alias("n_repeat_words")))
    return {
        "of_words": of_words,
        "n_symbols": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(SYMBOL)).cast("long"),
        "of_lines": let(lines, lambda x: F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))),
    }


@dataclass(frozen=True)
class Rule:
    """A document that meets ``rejects`` goes."""
    name: str
    rejects: Column


def default_rules(text: Column, figures: dict[str, Column] | None = None) -> list[Rule]:
    """Rules over a text, or over figures that are there already.

    Few words; more than half of the words in repeated windows; more than
    three symbols on ten words; half of the lines are copies of earlier ones;
    words of under 2 or over 14 characters on average; under half of the
    characters in words are letters.
    """
    text = F.coalesce(text, F.lit(""))
    f = figures or {}
    n_words = f.get("n_words", F.regexp_count(text, F.lit(WORD + "+")).cast("long"))
    n_symbols = f.get("n_symbols", F.regexp_count(text, F.lit(SYMBOL)).cast("long"))
    chars = f.get("word_chars", F.length(F.translate(text, SPACES, "")).cast("long"))
    repeats = (100 * f["n_repeat_words"] > 50 * n_words if "n_repeat_words" in f else
               let(words_of(text), lambda w: 100 * repeated_words(w) > 50 * F.size(w)))
    lines = (2 * f["n_dup_lines"] >= f["n_lines"] if "n_lines" in f else
             let(base_columns(text)["of_lines"], lambda x: 2 * x["n_dup_lines"] >= x["n_lines"]))
    return [
        Rule("few_words", n_words < 50),
        Rule("repeated_words", repeats),
        Rule("symbols", 10 * n_symbols > 3 * n_words),
        Rule("copied_lines", lines),
        Rule("word_length", (chars < 2 * n_words) | (chars > 14 * n_words)),
        Rule("few_letters", 2 * F.regexp_count(text, F.lit(r"\p{L}")) < chars),
    ]


def plan_cascade(docs: DataFrame, rules: list[Rule], id_column: str = "doc_id",
                 rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in the order to apply them.

    About ``rows`` documents are drawn by a hash of their id. Each rule is
    timed over them, less the time of a job without a rule, and the sets of
    rules that reject a document are counted (at most 2 to the number of
    rules). Greedily, the rule with the most rejections among the documents
    left, per second, comes next.
    """
    step = max(1, docs.count() // rows)
    sample = cut_lineage(docs.filter(F.pmod(F.xxhash64(named(id_column)), F.lit(step)) == 0).coalesce(2))

    def seconds(rejects: Column) -> float:
        start = time.perf_counter()
        sample.agg(F.count_if(rejects)).collect()
        return time.perf_counter() - start

    seconds(F.lit(False))
    idle = seconds(F.lit(False))
    cost = {r.name: max(seconds(r.rejects) - idle, 1e-3) for r in rules}
    sets = sample.groupBy(*[F.coalesce(r.rejects, F.lit(False)).alias(r.name) for r in rules]).count().collect()
    order: list[str] = []
    while len(order) < len(rules):
        left = [s for s in sets if not any(s[o] for o in order)]
        rate = {r.name: sum(s["count"] for s in left if s[r.name]) / cost[r.name] for r in rules if r.name not in order}
        order.append(max(rate, key=lambda n: (rate[n], -cost[n])))
    return order


def cascade(rules: list[Rule], order: list[str]) -> Column:
    """True if no rule rejects; a rule runs only if those before it have not rejected."""
    by_name = {r.name: r for r in rules}
    verdict = F.when(by_name[order[0]].rejects, False)
    for name in order[1:]:
        verdict = verdict.when(by_name[name].rejects, False)
    return verdict.otherwise(True)


def keep_good(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The documents that no rule rejects, with all their columns.

    A NULL, empty or blank text has no words and goes; repeated rows stay
    repeated; an empty table gives an empty table.
    """
    rules = default_rules(named(text_column))
    return docs.filter(cascade(rules, plan_cascade(docs, rules, id_column)))


def measure_quality(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Base figures and verdict of each document, one row for each input row.

    Words are runs of characters other than blank, tab, \\n, \\v, \\f and \\r; a
    NULL text has none, and fails. A document that meets the base conditions
    is kept if the cascade of rules, over the same figures, rejects it
    nowhere. Other columns of the input are left out.
    """
    text = named(text_column)
    # of_words is used several times above, so the optimizer leaves this step as it is
    step = docs.select(named(id_column).alias("doc_id"), text.alias("_text"), *[c.alias(n) for n, c in base_columns(text).items()])
    flat = step.select("doc_id", "_text", "of_words.*", "n_symbols", "of_lines.*")
    figures = {c: F.col(c) for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_lines", "n_dup_lines")}
    order = plan_cascade(docs, default_rules(text), id_column)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    kept = F.when(base_failed, False).otherwise(cascade(default_rules(F.col("_text"), figures), order))
    return flat.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       base_failed.alias("base_failed"), kept.alias("kept"))
