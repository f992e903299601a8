"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; neighbouring turns of one role are
merged under one header (the boundary stays readable) by array functions over the sorted turns, and
the pieces are joined. One shuffle, one row per conversation:

    <|im_start|>ROLE\\nTEXT[<|im_part|>TEXT ...]<|im_end|>\\n ...

``<`` followed by any number k of backslashes and ``|`` in a text or role gets one more backslash, so no
control string can stand in a text, and removing one restores it. A line feed or backslash in a
role is written as backslash n or two backslashes, so a header is one line.

``loss_spans`` are the (start, length) in code points of each assistant text in ``formatted``.

Edge cases: a null text or role is empty; a null conversation id is a conversation of its own;
turns with the same number are ordered by role, then text; repeated rows are turns of their own; a
very long text is kept whole (a conversation must fit one row); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END = "<|im_start|>", "<|im_part|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role_out(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role_in(role: Column) -> Column:
    kept = F.replace(role, F.lit("\\\\"), F.lit("\\\x00"))
    return unescape(F.replace(F.replace(kept, F.lit("\\n"), F.lit("\n")), F.lit("\\\x00"), F.lit("\\")))


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, formatted, loss_spans), a row per conversation."""
    blank = F.lit("")
    turn_struct = F.struct(F.col(turn).alias("t"), F.coalesce(F.col(role), blank).alias("r"), F.coalesce(F.col(text), blank).alias("x"))
    sorted_turns = turns.select(F.col(conv).alias("c"), turn_struct.alias("turn")).groupBy("c").agg(F.sort_array(F.collect_list("turn")).alias("p"))

    def piece(x: Column, i: Column) -> Column:
        """A turn with what stands before and after it: neighbours of one role share a header and an end."""
        first = F.coalesce(F.get("p", i - 1)["r"] != x["r"], F.lit(True))
        last = F.coalesce(F.get("p", i + 1)["r"] != x["r"], F.lit(True))
        head = F.when(first, F.concat(F.lit(START), _role_out(x["r"]), F.lit("\n"))).otherwise(F.lit(PART))
        return F.struct(x["r"].alias("r"), head.alias("head"), escape(x["x"]).alias("body"), F.when(last, F.lit(END)).otherwise(blank).alias("tail"))

    def span(acc: Column, x: Column) -> Column:
        begin, length = acc["at"] + F.char_length(x["head"]), F.char_length(x["body"])
        mine = F.array(F.struct(begin.cast("long").alias("start"), length.cast("long").alias("length")))
        return F.struct(
            (begin + length + F.char_length(x["tail"])).cast("long").alias("at"),
            F.when(x["r"] == "assistant", F.concat(acc["spans"], mine)).otherwise(acc["spans"]).alias("spans"),
        )

    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    pieces = sorted_turns.select("c", F.transform("p", piece).alias("pieces"))
    return pieces.select(
        F.col("c").alias(conv),
        F.array_join(F.transform("pieces", lambda x: F.concat(x["head"], x["body"], x["tail"])), "").alias("formatted"),
        F.aggregate("pieces", nothing, span, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""

    def merged(block: Column) -> Column:
        inner = F.substring(block, len(START) + 1, 2147483647)
        line = F.locate("\n", inner)
        role = _role_in(F.substring(inner, F.lit(1), line - 1))
        texts = F.split(F.substring(inner, line + 1, F.char_length(inner)), r"<\|im_part\|>", -1)
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    blocks = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.flatten(F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), merged))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
