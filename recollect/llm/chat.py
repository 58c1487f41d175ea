"""Chat formatting as a grammar round trip: render, reparse, compare, and escape what conflicts until nothing differs.

Grammar of a formatted conversation: ``turn*`` with ``turn = "<s>" role "\\n" text "</s>"``. The parser cuts at ``</s>``, takes
the role up to the first line break, and removes escapes: a backslash stands for the character behind it. Every
conversation is first rendered as it is and reparsed; where the recovered turns differ from the source, or a role or text holds a control
string, even one that the parser does not cut at, its contents are escaped and it is rendered again. Escaping doubles backslashes and puts one behind the first character of every
control string (and before a line break in a role), so that no control string is left in a content: the
second rendering always parses back, and ``round_trip`` states the comparison for every row.

The turns of a conversation are sorted by turn, role and text; repeated rows are repeated turns. Null roles and texts are empty,
a null turn comes first, and rows with a null conv_id form one conversation. A conversation is one value of the result, so
its turns meet in one task. Other columns are not read. Everything is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<s>", "</s>"
#: Strings that a content may not hold: those of the grammar, and instruction marks of common templates.
CONTROL = (OPEN, CLOSE, "[INST]", "[/INST]")
LEARNT_ROLE = "assistant"


def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in control:
        out = F.replace(out, F.lit(mark), F.lit(mark[0] + "\\" + mark[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column, control: Sequence[str] = CONTROL) -> Column:
    """As a text; a line break, which ends the role, becomes a backslash and an ``n`` with a mark of its own."""
    return F.replace(F.replace(escape(role, control), F.lit("~"), F.lit("~~")), F.lit("\n"), F.lit("~n"))


def unescape_role(role: Column) -> Column:
    halves = F.transform(F.split(role, "~~", -1), lambda x: F.replace(x, F.lit("~n"), F.lit("\n")))
    return unescape(F.array_join(halves, "~"))


def holds_control(turns: Column, control: Sequence[str] = CONTROL) -> Column:
    """Whether a role or text holds a control string."""
    return F.exists(turns, lambda t: reduce(or_, [F.contains(t[part], F.lit(mark)) for part in ("role", "text") for mark in control], F.lit(False)))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def parse(formatted: Column) -> Column:
    """The turns as the parser finds them: role, text, and the text as it stands in the format (raw)."""
    pieces = F.split(formatted, CLOSE, -1)
    closed = F.slice(pieces, F.lit(1), F.size(pieces) - 1)  # nothing stands behind the last end mark

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, "\n")
        role = F.substring(piece, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1)
        raw = F.substring(piece, cut + 1, F.length(piece))
        return F.struct(unescape_role(role).alias("role"), unescape(raw).alias("text"), raw.alias("raw"))

    return F.transform(closed, turn)


def same_turns(parsed: Column, turns: Column) -> Column:
    plain = lambda rows: F.transform(rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return plain(parsed) == plain(turns)


def format_chats(rows: DataFrame, control: Sequence[str] = CONTROL) -> DataFrame:
    """conv_id, turns (source), formatted, escaped, parsed (turns read back), round_trip, one row per conversation."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    plain = chats.withColumn("_plain", render(F.col("turns")))
    tested = plain.withColumn("escaped", holds_control(F.col("turns"), control) | ~same_turns(parse(F.col("_plain")), F.col("turns")))
    safe = F.transform("turns", lambda t: F.struct(escape_role(t["role"], control).alias("role"), escape(t["text"], control).alias("text")))
    done = tested.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("_plain"))).drop("_plain")
    parsed = done.withColumn("parsed", parse(F.col("formatted")))
    return parsed.withColumn("round_trip", same_turns(F.col("parsed"), F.col("turns")))


def loss_spans(parsed: Column, learnt: str = LEARNT_ROLE) -> Column:
    """Where the learnt texts stand in the formatted string: code points [begin, end), in order, from the parsed turns."""

    def step(acc: Column, t: Column) -> Column:
        # A role's length in the format is that of its escaped form only if it was escaped; begin is found from the end instead.
        return F.struct((acc["at"] + t["n"]).alias("at"), F.when(t["role"] == learnt, F.concat(acc["spans"], F.array(
            F.struct((acc["at"] + t["n"] - len(CLOSE) - F.length(t["raw"])).alias("begin"), (acc["at"] + t["n"] - len(CLOSE)).alias("end"))
        ))).otherwise(acc["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<begin:int,end:int>>)").alias("spans"))
    return F.aggregate(parsed, begin, step)["spans"]


def with_loss_mask(chats: DataFrame, learnt: str = LEARNT_ROLE) -> DataFrame:
    """Adds loss_spans: the stretches of ``formatted`` that a model learns from."""
    pieces = F.split("formatted", CLOSE, -1)
    sized = F.zip_with("parsed", F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda t, piece: F.struct(
        t["role"].alias("role"), t["raw"].alias("raw"), (F.length(piece) + len(CLOSE)).alias("n")
    ))
    return chats.withColumn("_sized", sized).withColumn("loss_spans", loss_spans(F.col("_sized"), learnt)).drop("_sized")


def chat_digest(chats: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from ``formatted``."""
    spoken = F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["begin"] + 1, s["end"] - s["begin"])))
    learnt = chats.withColumn("_learnt", F.array_join(masked, ""))
    return learnt.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length("_learnt").cast("long").alias("loss_chars"),
        F.sha2("_learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )
