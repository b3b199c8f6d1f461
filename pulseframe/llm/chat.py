"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and only that reply is trainable.
A conversation that does not end with an assistant turn gets one more example, without a trainable part, so that the
examples always hold every turn.

Template: ``<|role|>`` role ``<|text|>`` text ``<|end|>`` for each turn, in order. Inside roles and texts a backslash
follows every ``<``, ``[`` and ``\\``, which breaks each control string that starts with one of them (``<|…|>``,
``</s>``, ``[INST]``, ``<<SYS>>``) and is undone exactly by ``unescape``.

Defined cases: NULL role or text counts as empty; turns are ordered by (turn, role, text) with NULL turns first, so
repeated rows stay, next to each other; a NULL conv_id is a conversation; an empty table gives an empty result; other
columns are ignored. The text of one conversation must fit in a task, as must any of its examples; examples are made one
after the other, never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.shared import hex_digest

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
TRAINABLE_ROLE = "assistant"


def escape(value: Column) -> Column:
    return F.regexp_replace(value, r"([<\[\\])", r"$1\\")


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"([<\[\\])\\", "$1")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """One row per conversation: ``formatted`` and ``spans``, the (start, end) of each example's trainable part.

    Offsets count code points from 0. The example of a span is ``formatted`` up to the end mark after it.
    """
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    parts = grouped.select("conv_id", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(ROLE), escape(t["role"]), F.lit(TEXT)).alias("head"),
        escape(t["text"]).alias("body"),
        (t["role"] == TRAINABLE_ROLE).alias("trainable"))).alias("parts"))
    ends = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + F.length(p["head"]) + F.length(p["body"]) + len(END)).alias("at"),
            F.when(p["trainable"], F.concat(s["spans"], F.array(F.struct(
                (s["at"] + F.length(p["head"])).alias("start"),
                (s["at"] + F.length(p["head"]) + F.length(p["body"])).alias("end")))))
            .otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return parts.select("conv_id", text.alias("formatted"), ends.alias("spans"))


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row per example: conv_id, example (from 0), text, loss_start, loss_end (equal if nothing is trainable), last.

    ``last`` marks the example that holds the whole conversation.
    """
    whole = F.length("formatted")
    tail = F.struct(whole.alias("start"), whole.alias("end"), whole.alias("upto"))
    spans = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                    (s["end"] + len(END)).alias("upto")))
    open_end = F.coalesce(F.try_element_at("spans", F.lit(-1))["end"] + len(END), F.lit(0)) < whole
    listed = formatted.select(
        "conv_id", "formatted",
        F.posexplode(F.when(open_end, F.concat(spans, F.array(tail))).otherwise(spans))
        .alias("example", "span"))
    return listed.select(
        "conv_id", "example", F.substring("formatted", F.lit(1), F.col("span.upto")).alias("text"),
        F.col("span.start").alias("loss_start"), F.col("span.end").alias("loss_end"),
        (F.col("span.upto") == whole).alias("last"))


def read_turns(text: Column) -> Column:
    """The (role, text) pairs of a formatted text, unescaped."""
    marked = F.slice(F.split(text, r"<\|role\|>"), F.lit(2), F.size(F.split(text, r"<\|role\|>")))
    return F.transform(marked, lambda t: F.struct(
        unescape(F.element_at(F.split(t, r"<\|text\|>"), 1)).alias("role"),
        unescape(F.regexp_replace(F.element_at(F.split(t, r"<\|text\|>"), 2), r"<\|end\|>$", "")).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """Per conversation, read back from its examples: turns, trainable text, and the characters of all examples."""
    loss = unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    turns = F.when(F.col("last"), read_turns(F.col("text")))
    lines = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = examples.select("conv_id", "example", loss.alias("loss"), F.size(turns).cast("long").alias("n_turns"),
                           hex_digest(lines).alias("turns_sha256"), F.length("text").cast("long").alias("n_chars"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda e: e["loss"]), "")
    grouped = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), whole.alias("loss"),
        F.sum("n_chars").alias("formatted_chars"))
    return grouped.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
                          hex_digest(F.col("loss")).alias("loss_sha256"), "formatted_chars")
