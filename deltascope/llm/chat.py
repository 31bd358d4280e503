"""Chat formatting proved by a grammar round trip.

A conversation is a row of turns, each

    <|im_start|> role <|im_sep|> text <|im_end|> \\n

without the blanks. ``+`` signs in the opening mark tell how often the role
and the text were escaped. Escaping puts one backslash into each ``<``,
backslashes, ``|``, so no mark is left in the content; taking one out undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deltascope.llm.common import let, named

OPEN, SEP, END = "<|im_start", "<|im_sep|>", "<|im_end|>"
MARK = r"<\|im_(start\+*|sep|end)\|>"
#: Escaping once leaves no mark; the second level would show a wrong parser.
MAX_DEPTH = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _piece(turn: Column, depth: int) -> tuple[Column, Column]:
    """(all before the text, the text) of a turn as written at a depth."""
    role, text = turn["role"], turn["text"]
    for _ in range(depth):
        role, text = escape(role), escape(text)
    return F.concat(F.lit(OPEN + "+" * depth + "|>"), role, F.lit(SEP)), text


def render(turns: Column, depth: int) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(*_piece(t, depth), F.lit(END + "\n"))), "")


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as (role, text, depth); NULL where it breaks the grammar.

    The parser looks at the string alone. A mark inside a role or a text
    breaks the grammar.
    """
    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "|>", 1)
        depth = F.length(head) - len(OPEN)
        body = F.substring(piece, F.length(head) + 3, F.length(piece))
        role = F.substring_index(body, SEP, 1)
        text = F.substring(body, F.length(role) + len(SEP) + 1, F.length(body))
        sound = (head.rlike(r"^<\|im_start\+*$") & F.contains(body, F.lit(SEP))
                 & ~role.rlike(MARK) & ~text.rlike(MARK))

        def plain(x: Column) -> Column:
            value = x
            for d in range(MAX_DEPTH, 0, -1):
                deeper = x
                for _ in range(d):
                    deeper = unescape(deeper)
                value = F.when(depth == d, deeper).otherwise(value)
            return value

        return F.when(sound, F.struct(plain(role).alias("role"), plain(text).alias("text"), depth.alias("depth")))

    pieces = F.split(formatted, r"<\|im_end\|>\n")
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)
    whole = (F.element_at(pieces, -1) == "") & ~F.exists(turns, lambda t: t.isNull())
    return F.when(whole, turns)


def _same(turns: Column, formatted: Column) -> Column:
    bare = F.transform(parse(formatted), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return F.coalesce(bare == turns, F.lit(False))


def loss_spans(turns: Column, depth: int) -> Column:
    """(start, length) in code points of each assistant text in the formatted conversation."""
    def step(acc: Column, t: Column) -> Column:
        before, text = _piece(t, depth)
        start = acc["at"] + F.length(before)
        span = F.array(F.struct(start.alias("start"), F.length(text).alias("length")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((start + F.length(text) + len(END) + 1).alias("at"), spans.alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_chats(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_spans.

    Rows are taken in the order of turn, role, text (NULLs first), repeated
    rows as often as they come; a NULL role or text counts as empty, and the
    rows with a NULL id are one conversation. Each conversation is rendered
    plainly and parsed again; where that doesn't give the source, its content
    is escaped, and the job fails if that doesn't help. Other columns are left
    out. A conversation is one row of the result, so its turns meet in a task.
    """
    one = F.struct(named(turn).alias("turn"), F.coalesce(named(role), F.lit("")).alias("role"),
                   F.coalesce(named(text), F.lit("")).alias("text"))
    chats = (conversations.groupBy(named(conv).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("rows"))
             .select("conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")))

    def attempt(turns: Column, depth: int) -> Column:
        worse = attempt(turns, depth + 1) if depth < MAX_DEPTH else F.raise_error(F.lit("a conversation can't be read back"))
        out = F.struct(render(turns, depth).alias("formatted"), loss_spans(turns, depth).alias("loss_spans"))
        return let(out, lambda o: F.when(_same(turns, o["formatted"]), o).otherwise(worse))

    return chats.select("conv_id", attempt(F.col("turns"), 0).alias("out")).select("conv_id", "out.formatted", "out.loss_spans")


def read_back(chats: DataFrame) -> DataFrame:
    """Digests of formatted conversations, from the formatted strings and the loss spans alone."""
    def masked(text: Column, spans: Column, turns: Column) -> Column:
        depth = F.coalesce(F.get(turns, F.lit(0))["depth"], F.lit(0))
        parts = F.transform(spans, lambda s: F.substring(text, s["start"] + 1, s["length"]))
        plain = parts
        for d in range(1, MAX_DEPTH + 1):
            parts = F.transform(parts, unescape)
            plain = F.when(depth == d, parts).otherwise(plain)
        return F.array_join(plain, "")

    out = let(parse(F.col("formatted")), lambda t: F.struct(
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        masked(F.col("formatted"), F.col("loss_spans"), t).alias("loss_text")))
    return chats.select("conv_id", "formatted", out.alias("o")).select(
        "conv_id", "o.n_turns", "o.turns_sha256", F.length("o.loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("o.loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
