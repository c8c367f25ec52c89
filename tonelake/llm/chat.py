"""Chat formatting with a grammar round trip, in DataFrame operations only.

Each turn is rendered between control strings. The rendered text is parsed again by a deterministic
grammar and compared with its source; turns that don't come back identical have their conflicting
content escaped, and the rendering is parsed and compared once more. Escaping adds a backslash inside
every ``<|``, ``<\\|``, ``<\\\\|``..., and reading takes one off, so it is reversible for any text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, MASKED = "<|im_start|>", "<|im_end|>\n", "assistant"
#: A line break within a role, which would end the role in the grammar.
BREAK = "<|nl|>"
#: Each render-and-parse round escapes what the one before got wrong; the second is always identical.
ROUNDS = 2


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(BREAK))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))


def render(role: Column, text: Column) -> Column:
    """One turn between its control strings."""
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text as array<struct<role, text>>. The grammar: a turn begins at ``OPEN``,
    its role ends at the first line break, and its text at the next ``<|``, with which every control
    string begins."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, "\n", 1)
        raw = F.substring_index(F.substring(piece, F.length(role) + 2, F.length(piece)), "<|", 1)
        return F.struct(unescape_role(role).alias("role"), unescape(raw).alias("text"))

    pieces = F.split(rendered, r"\Q<|im_start|>\E")
    return F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def formatted(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per conversation: ``conv``, ``rendered`` and ``spans``, the array of (start, length) of the
    assistants' texts in it, counted in characters from 0: the loss mask.

    Turns stand by ``turn`` (nulls first), ties by role and text; repeated rows are repeated turns. A
    null role or text is empty. Rows of the null conversation form one. An empty table gives none.
    """
    turns = rows.select(
        rows[conv].alias("c"), rows[turn].alias("t"), F.coalesce(rows[role], F.lit("")).alias("role"), F.coalesce(rows[text], F.lit("")).alias("text")
    )
    plain = F.lit(False)
    for _ in range(ROUNDS):
        # a turn is escaped from the round on in which it did not come back
        r = F.when(plain, escape_role(F.col("role"))).otherwise(F.col("role"))
        x = F.when(plain, escape(F.col("text"))).otherwise(F.col("text"))
        back = parse(render(r, x))
        same = (F.size(back) == 1) & F.coalesce((back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")), F.lit(False))
        turns = turns.withColumn("r", r).withColumn("x", x).withColumn("wrong", ~same)
        plain = F.col("wrong")
    turns = turns.withColumn("x", F.when(F.col("wrong"), F.raise_error(F.lit("a turn does not survive the round trip"))).otherwise(F.col("x")))
    # where each turn starts: all that stands before it, added up once
    before = Window.partitionBy("c").orderBy("t", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("s", F.coalesce(F.sum(F.length(render(F.col("r"), F.col("x")))).over(before), F.lit(0)).cast("int"))
    whole = turns.groupBy("c").agg(F.sort_array(F.collect_list(F.struct("t", "role", "text", "s", "r", "x"))).alias("turns"))
    rendered = F.array_join(F.transform("turns", lambda t: render(t["r"], t["x"])), "")
    spans = F.transform(
        F.filter("turns", lambda t: t["role"] == MASKED),
        lambda t: F.struct((t["s"] + len(OPEN) + F.length(t["r"]) + 1).alias("start"), F.length(t["x"]).alias("length")),
    )
    return whole.select(F.col("c").alias(conv), rendered.alias("rendered"), spans.alias("spans"))


def read_back(chats: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """Digests of what a reader gets from ``rendered`` and ``spans`` alone."""
    turns = parse(F.col("rendered"))
    loss = F.array_join(F.transform("spans", lambda s: unescape(F.substring(F.col("rendered"), s["start"] + 1, s["length"]))), "")
    seen = chats.select(conv, turns.alias("turns"), loss.alias("loss"), F.length("rendered").cast("long").alias("formatted_chars"))
    content = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return seen.select(
        conv,
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(content, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
