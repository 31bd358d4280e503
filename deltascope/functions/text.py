"""Column expressions over query and response texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words and patterns of the text rules.
AGGREGATES = ("COUNT(", "SUM(", "AVG(", "MIN(", "MAX(")
WRITE_KEYWORDS = ("INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "CREATE", "REPLACE", "TRUNCATE")
SQL_FENCE = r"(?s)```sql\s*(.*?)\s*```"
LINE_COMMENT = r"--[^\n]*"
ESCAPED_QUOTE = r"\\+(['\"])"
TOKEN = r"([\p{L}\p{N}_]+)"
AS_ALIAS = r"\bas\s+([\p{L}\p{N}_]+)"
ON_CHAIN = (r"(?i)\bon\b\s*\(*\s*(\w+\.\w+\s*=\s*\w+\.\w+"
            r"(?:\s+and\s+[\w.]+\s*(?:<=|>=|<>|=|<|>)\s*(?:'[^']*'|[\w.]+))*)")
COLUMN_EQUALITY = r"(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"
# a word is tried from its start only and never given back in parts: the same matches without looking at each word from each letter
CONDITION = r"(?i)(?<!\w)(\w++\()?(?:\w++\.)?(\w++)\)?\s*+(<=|>=|<>|!=|=|<|>|\blike\b)\s*+(?:'((?:[^']|'')*)'|(-?(?:\d+(?:\.\d+)?|\.\d+)(?:e[+-]?\d+)?\b))"
# words that may follow a table name without being its alias
NOT_ALIAS = ("on", "where", "join", "inner", "left", "right", "full", "cross", "outer", "natural",
             "group", "order", "having", "limit", "union", "intersect", "except", "set", "using", "values", "as")
# the alias is looked at before it is taken, so a JOIN that follows a bare table name is found too
TABLE_REF = (r"\b(?:from|join)\s+([\p{L}\p{N}_]+)(?:\s+as)?\s+(?!(?:" + "|".join(NOT_ALIAS) + r")\b)([\p{L}\p{N}_]+)")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row.

    An expression named inside a lambda is computed anew for each element; a
    lambda variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def extract_sql_block(text: Column) -> Column:
    """Last fenced sql block, else the whole text, on one line with single spaces."""
    block = F.try_element_at(F.regexp_extract_all(text, F.lit(SQL_FENCE), 1), F.lit(-1))
    flat = F.regexp_replace(F.coalesce(block, text), r"^\s+|\s+$", "")
    return F.regexp_replace(flat, r"\s+", " ")


def clean_query(sql: Column) -> Column:
    """Newlines to spaces, double to single quotes, no backslashes before quotes."""
    flat = F.translate(sql, "\n\"", " '")
    return F.regexp_replace(flat, ESCAPED_QUOTE, "$1")


def is_aggregate(sql: Column) -> Column:
    """An aggregate call and no GROUP BY: likely a single-row result."""
    upper = F.upper(sql)
    found = F.lit(False)
    for call in AGGREGATES:
        found = found | upper.contains(call)
    return found & ~upper.contains("GROUP BY")


def has_limit(sql: Column, whole_word: bool = False) -> Column:
    """LIMIT outside line comments; a substring test unless ``whole_word``."""
    upper = F.upper(F.regexp_replace(sql, LINE_COMMENT, ""))
    return upper.rlike(r"\bLIMIT\b") if whole_word else upper.contains("LIMIT")


def tokens(sql: Column) -> Column:
    """Lower-case word tokens, letters and digits of any script."""
    return F.regexp_extract_all(F.lower(sql), F.lit(TOKEN), 1)


def aliases(sql: Column) -> Column:
    """Names given by AS, and names that directly follow a table name."""
    lower = F.lower(sql)
    return F.array_distinct(F.concat(F.regexp_extract_all(lower, F.lit(AS_ALIAS), 1),
                                     F.regexp_extract_all(lower, F.lit(TABLE_REF), 2)))


def ngrams(sql: Column, n: int = 1) -> Column:
    """Distinct word n-grams without aliases and the word "as"."""
    dropped = F.array_append(aliases(sql), F.lit("as"))
    if n <= 1:
        return F.array_except(tokens(sql), dropped)
    words = let(F.struct(tokens(sql).alias("words"), dropped.alias("drop")),
                lambda s: F.filter(s["words"], lambda w: ~F.array_contains(s["drop"], w)))

    def grams(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))

    return let(words, grams)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 when both are empty."""
    def ratio(s: Column) -> Column:
        union = F.size(F.array_union(s["a"], s["b"]))
        return F.coalesce(F.try_divide(F.size(F.array_intersect(s["a"], s["b"])).cast("double"), union), F.lit(0.0))

    return let(F.struct(a.alias("a"), b.alias("b")), ratio)


def share_found(wanted: Column, given: Column) -> Column:
    """Share of the ``wanted`` set found in ``given``; 0 when nothing is wanted."""
    def ratio(s: Column) -> Column:
        found = F.size(F.array_intersect(s["wanted"], s["given"])).cast("double")
        return F.coalesce(F.try_divide(found, F.size(F.array_distinct(s["wanted"]))), F.lit(0.0))

    return let(F.struct(wanted.alias("wanted"), given.alias("given")), ratio)


def first_statement(sql: Column) -> Column:
    """First non-blank part between semicolons, trimmed."""
    parts = F.filter(F.split(sql, ";"), lambda p: F.trim(p) != "")
    return F.trim(F.get(parts, F.lit(0)))


def is_write(sql: Column) -> Column:
    """True if the first token is a write keyword; later statements are not looked at."""
    first = F.upper(F.regexp_extract(F.trim(sql), r"^(\S+)", 1))
    return first.isin(*WRITE_KEYWORDS)


def table_refs(sql: Column) -> Column:
    """Array of (alias, table) of the tables named after FROM or JOIN with an alias."""
    lower = F.lower(sql)
    return F.arrays_zip(F.regexp_extract_all(lower, F.lit(TABLE_REF), 2).alias("alias"),
                        F.regexp_extract_all(lower, F.lit(TABLE_REF), 1).alias("table"))


def join_pairs(sql: Column) -> Column:
    """Array of (left, right) column pairs equated in ON clauses, aliases resolved."""
    chain = F.array_join(F.regexp_extract_all(F.lower(sql), F.lit(ON_CHAIN), 1), " ; ")
    parts = F.arrays_zip(*[F.regexp_extract_all(chain, F.lit(COLUMN_EQUALITY), i).alias(name)
                           for i, name in enumerate(("lt", "lc", "rt", "rc"), start=1)])

    def resolved(s: Column) -> Column:
        def table(name: Column) -> Column:
            hit = F.get(F.filter(s["refs"], lambda r: r["alias"] == name), F.lit(0))["table"]
            return F.coalesce(hit, name)

        return F.transform(s["parts"], lambda p: F.struct(
            F.concat_ws(".", table(p["lt"]), p["lc"]).alias("left"),
            F.concat_ws(".", table(p["rt"]), p["rc"]).alias("right")))

    return let(F.struct(parts.alias("parts"), table_refs(sql).alias("refs")), resolved)


def conditions(sql: Column) -> Column:
    """Array of (func, column, op, literal) for column-to-literal comparisons.

    The text is searched once; the parts are then taken out of the short pieces found.
    """
    def whole(m: Column) -> Column:
        def part(i: int) -> Column:
            return F.regexp_extract(m, CONDITION, i)

        return F.struct((part(1) != "").alias("in_call"), F.lower(part(2)).alias("column"), F.lower(part(3)).alias("op"),
                        F.when(part(5) != "", part(5)).otherwise(F.replace(part(4), F.lit("''"), F.lit("'"))).alias("literal"))

    return F.transform(F.regexp_extract_all(sql, F.lit(CONDITION), 0), whole)


def parse_response(raw: Column, schema: T.StructType) -> Column:
    """Struct from a JSON reply: fence lines dropped, a one-element array unwrapped, NULL if unreadable."""
    body = F.trim(F.regexp_replace(raw, r"(?m)^\s*```.*$", ""))
    # an array schema accepts a single object as well
    items = F.from_json(body, T.ArrayType(schema))
    return F.get(items, F.lit(0))
