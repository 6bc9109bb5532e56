"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, merged where neighbours have one role, and concatenated:

    <|im_start|>role<|im_sep|>text<|im_turn|>text<|im_end|>

with ``<|im_turn|>`` between the texts of merged turns, so that the turns can be read back. Control strings inside
roles and texts (of this template and of other common ones) get a backslash after their first character; one that
has backslashes there already gets one more, so the escape is reversible. As no control string contains the first
character of another past its own start, text and markers can never join into one.

Turns sort by turn, then role, then text, nulls first; a null role or text is an empty one. A null conversation id
is a conversation of its own. Loss spans are code points of the formatted string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import running_spans

# The template's markers, and control strings of common templates.
START, SEP, TURN, END = "<|im_start|>", "<|im_sep|>", "<|im_turn|>", "<|im_end|>"
CONTROLS = [START, SEP, TURN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]"]
_BODIES = "|".join(re.escape(c[1:]) for c in CONTROLS)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({_BODIES})", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({_BODIES})", "$1$2$3")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn_from: str = "assistant") -> DataFrame:
    """(conv_col, formatted, loss_spans): loss_spans are [start, stop) of each text of the role to learn from."""
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    sorted_ = turns.groupBy(conv_col).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", i - 1).role))
    runs = sorted_.withColumn("first", first)

    def block(start: Column, k: Column) -> Column:
        stop = F.coalesce(F.get("first", k + 1), F.size("turns"))
        role = F.get("turns", start).role
        texts = F.transform(F.slice("turns", start + 1, stop - start), lambda t: escape(t.text))
        return F.struct(F.concat(F.lit(START), escape(role), F.lit(SEP)).alias("head"), texts.alias("texts"), (role == learn_from).alias("learn"))

    blocks = runs.withColumn("blocks", F.transform("first", block)).select(conv_col, "blocks")
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(b.head, F.array_join(b.texts, TURN), F.lit(END + "\n"))), "")

    def piece(size: Column, learn: Column) -> Column:
        return F.struct(size.cast("int").alias("size"), learn.alias("learn"))

    def piecewise(b: Column) -> Column:
        no = F.lit(False)
        texts = F.transform(b.texts, lambda t, i: F.array(piece(F.when(i == 0, 0).otherwise(len(TURN)), no), piece(F.length(t), b.learn)))
        return F.concat(F.array(piece(F.length(b.head), no)), F.flatten(texts), F.array(piece(F.lit(len(END) + 1), no)))

    make = lambda start, stop, *_: F.struct(start.cast("bigint").alias("start"), stop.cast("bigint").alias("stop"))
    pieces = F.flatten(F.transform("blocks", piecewise))
    spans = running_spans(pieces, lambda _, at: at, lambda p, start: start + p["size"], lambda p, _: p.learn, make, "struct<start:bigint,stop:bigint>")
    return blocks.select(conv_col, formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) that a formatted string holds."""

    def turns(b: Column) -> Column:
        role = F.substring_index(b, SEP, 1)
        body = F.substring(b, F.length(role) + len(SEP) + 1, F.length(b))
        body = F.substring(body, F.lit(1), F.length(body) - len(END) - 1)
        return F.transform(F.split(body, re.escape(TURN)), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, re.escape(START))
    return F.flatten(F.transform(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0))), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s.start.cast("int") + 1, (s.stop - s.start).cast("int")))), "")
