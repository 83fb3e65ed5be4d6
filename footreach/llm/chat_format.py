"""Chat formatting with a grammar round trip.

A conversation becomes one string. Each turn is

    <s>[role] text</s>

with `&` as the start of an escape. The parser cuts the string at every `</s>`, and a piece into role and text at
its first `] `; a piece with a second `<s>` is no turn, so that no text can open a turn of its own. Then it undoes the escapes `&s;` (for `<s>`), `&e;` (for `</s>`), `&b;` (for `]`) and `&a;` (for
`&`). Each turn is first rendered as it stands, then parsed; a turn that does not come back identical has its
control strings and `&` escaped, which is minimal, and one that still does not has every `<`, `>`, `]` and `&`
escaped (`&l;` and `&g;` beside those above). The result tells the level of each turn, and is checked again as a whole.

All of it is string functions of the DataFrame API: one grouping by conversation, no Python.

Defined cases: null text and null role count as empty; turns stand in the order of turn (null first), then of
role and text for equal turns; repeated rows are turns of their own. A conversation is one string by contract,
so its turns meet in one row. The loss mask covers the texts of `assistant` turns, as spans of code points of
the string, start and end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BEGIN, END, ROLE_END = "<s>", "<s>[", "</s>", "] "
LOSS_ROLE = "assistant"


def _replace(text: F.Column, pairs: list[tuple[str, str]]) -> F.Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def escaped(text: F.Column, level: F.Column) -> F.Column:
    """0: as it stands. 1: `&` and the control strings. 2: every character that control strings are made of."""
    one = _replace(text, [("&", "&a;"), ("</s>", "&e;"), ("<s>", "&s;"), ("]", "&b;")])
    two = _replace(text, [("&", "&a;"), ("<", "&l;"), ("]", "&b;"), (">", "&g;")])
    return F.when(level == 0, text).when(level == 1, one).otherwise(two)


def unescaped(text: F.Column) -> F.Column:
    return _replace(text, [("&e;", "</s>"), ("&s;", "<s>"), ("&b;", "]"), ("&l;", "<"), ("&g;", ">"), ("&a;", "&")])


def rendered(role: F.Column, text: F.Column, level: F.Column) -> F.Column:
    return F.concat(F.lit(BEGIN), escaped(role, level), F.lit(ROLE_END), escaped(text, level), F.lit(END))


def parsed(formatted: F.Column) -> F.Column:
    """Array of (role, text) read back from a string, by the grammar alone."""
    pieces = F.filter(F.split(formatted, END, -1), lambda x: x != "")

    def turn(piece: F.Column) -> F.Column:
        body = F.substr(piece, F.lit(len(BEGIN) + 1))
        at = F.instr(body, ROLE_END)
        role, text = F.substr(body, F.lit(1), at - 1), F.substr(body, at + len(ROLE_END))
        ok = F.startswith(piece, F.lit(BEGIN)) & (at > 0) & ~F.contains(body, F.lit(OPEN))
        return F.struct(F.when(ok, unescaped(role)).alias("role"), F.when(ok, unescaped(text)).alias("text"))

    return F.transform(pieces, turn)


def _comes_back(role: F.Column, text: F.Column, level: int) -> F.Column:
    """Whether a turn rendered at this level is one turn again, and the same."""
    back = parsed(rendered(role, text, F.lit(level)))
    return F.coalesce((F.size(back) == 1) & (back[0]["role"] == role) & (back[0]["text"] == text), F.lit(False))


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, level): what is rendered, and how far it must be escaped."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    # only a turn that holds a character of the grammar can fail to come back
    risky = F.col("text").contains("&") | F.col("text").contains("<") | F.col("role").rlike("[\\]&<]")
    level = F.when(~risky | _comes_back(F.col("role"), F.col("text"), 0), 0).when(_comes_back(F.col("role"), F.col("text"), 1), 1).otherwise(2)
    return rows.withColumn("level", level)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, turns, levels, identical) for each conversation.

    turns is read back from formatted; identical says that it equals the source.
    """
    own = F.struct("turn", "role", "text", "level", rendered(F.col("role"), F.col("text"), F.col("level")).alias("piece"))
    whole = turns(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(own)).alias("own"))
    whole = whole.withColumn("formatted", F.array_join(F.transform("own", lambda x: x["piece"]), ""))
    whole = whole.withColumn("turns", parsed(F.col("formatted")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(state: F.Column, x: F.Column) -> F.Column:
        stop = state["at"] + F.char_length(x["piece"])
        end = stop - len(END)
        begin = end - F.char_length(escaped(x["text"], x["level"]))
        more = F.concat(state["spans"], F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end"))))
        return F.struct(stop.cast("long").alias("at"), F.when(x["role"] == LOSS_ROLE, more).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate("own", start, step, lambda s: s["spans"])
    source = F.transform("own", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return whole.select("conv_id", "formatted", spans.alias("loss_spans"), "turns", F.transform("own", lambda x: x["level"]).alias("levels"), (F.col("turns") == source).alias("identical"))


def masked_text(formatted: str, spans: str) -> F.Column:
    """All text under the loss mask, cut from the string and unescaped."""
    parts = F.transform(spans, lambda x: unescaped(F.substr(F.col(formatted), (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int"))))
    return F.array_join(parts, "")
