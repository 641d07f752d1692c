"""Chat formatting: one training example for each assistant turn, with all turns before it.

A turn is written <|im_start|>role<|im_sep|>text<|im_end|>. A control string inside a role or a text
gets a backslash after its first character, and one that has backslashes there gets one more, so
that no text can open or close a turn and every text comes back as it was. Only control strings
change: other text is as it was.

Each assistant turn is an example: the turns before it as context, then the turn itself, and the
loss mask covers the characters of its text alone. Turns after a conversation's last reply make one
more example without a mask, so that nothing of a conversation is lost. All of it is SQL functions.
A conversation meets in one row, as its longest example must be one text.

Defined cases: null text and null role count as empty; a null turn stands first; turns of equal
number stand by role, then text; repeated rows are turns of their own; rows of null conv_id are one
conversation; an empty text as a reply has an empty mask; columns other than conv_id, turn, role and
text are left out; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: What may not stand in a text as it is: this template's marks and those of other templates.
CONTROLS = (START, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")


def _pattern(controls: Sequence[str], backslashes: str) -> str:
    """A control string with so many backslashes after its first character, in three groups. As that
    character stands nowhere else in a control string, no two matches overlap."""
    first = {c[0] for c in controls}
    if not {START, SEP, END} <= set(controls) or any(len(c) < 2 or c[1] == "\\" or first & set(c[1:]) for c in controls):
        raise ValueError("control strings: the template's marks, each of two characters or more, whose first ones stand nowhere else in them")
    heads = "".join(re.escape(c) for c in sorted(first))
    rest = "|".join(re.escape(c[1:]) for c in sorted(set(controls), key=lambda c: (-len(c), c)))
    return f"([{heads}]){backslashes}({rest})"


def escape(text: Column | str, controls: Sequence[str] = CONTROLS) -> Column:
    return F.regexp_replace(text, _pattern(controls, r"(\\*)"), r"$1\\$2$3")


def unescape(text: Column | str, controls: Sequence[str] = CONTROLS) -> Column:
    return F.regexp_replace(text, _pattern(controls, r"\\(\\*)"), "$1$2$3")


def expand(conversations: DataFrame, target: str = "assistant", controls: Sequence[str] = CONTROLS) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, last): examples by the place of their
    last turn in the conversation; the mask in code points, end exclusive, null where nothing is
    to be learnt; last on the one that holds the whole conversation."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", empty("role").alias("role"), empty("text").alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    wrote = turns.select("conv_id", F.transform("t", lambda t: F.struct(
        (t["role"] == target).alias("target"), F.concat(F.lit(START), escape(t["role"], controls), F.lit(SEP)).alias("head"), escape(t["text"], controls).alias("body"),
    )).alias("t")).select("conv_id", "t", F.transform("t", lambda t: F.concat(t["head"], t["body"], F.lit(END))).alias("written"))
    one = wrote.select("conv_id", "written", F.size("t").alias("n"), F.posexplode("t").alias("example", "turn")).where(F.col("turn.target") | (F.col("example") == F.col("n") - 1))
    context = one.select("conv_id", "example", "turn", (F.col("example") == F.col("n") - 1).alias("last"), F.array_join(F.slice("written", 1, F.col("example")), "").alias("context"))
    begins = (F.length("context") + F.length("turn.head")).cast("long")
    return context.select(
        "conv_id", F.col("example").cast("long").alias("example"), F.concat("context", "turn.head", "turn.body", F.lit(END)).alias("formatted"),
        F.when(F.col("turn.target"), begins).alias("loss_start"), F.when(F.col("turn.target"), begins + F.length("turn.body")).alias("loss_end"), "last",
    )


def masked(examples: DataFrame, controls: Sequence[str] = CONTROLS) -> Column:
    """The text under an example's mask as it was given; null without a mask."""
    return unescape(F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")), controls)


def parse(formatted: Column | str, controls: Sequence[str] = CONTROLS) -> Column:
    """The turns of a formatted text, [(role, text)], as they were given."""
    pieces = F.filter(F.split(formatted, re.escape(END)), lambda p: p != "")
    cut = F.transform(pieces, lambda p: F.split(F.substring(p, len(START) + 1, F.length(p)), re.escape(SEP), 2))
    return F.transform(cut, lambda c: F.struct(unescape(c[0], controls).alias("role"), unescape(c[1], controls).alias("text")))


def read_back(examples: DataFrame, controls: Sequence[str] = CONTROLS) -> DataFrame:
    """(conv_id, turns, replies, formatted_chars): what the examples of a conversation say. Replies in
    order, each from its own example's mask; turns from the example that holds them all."""
    read = examples.select("conv_id", F.struct(
        "example", masked(examples, controls).alias("reply"), F.length("formatted").cast("long").alias("chars"), F.when(F.col("last"), F.col("formatted")).alias("whole"),
    ).alias("e"))
    each = read.groupBy("conv_id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    return each.select(
        "conv_id", parse(F.element_at("e", -1)["whole"], controls).alias("turns"), F.filter(F.transform("e", lambda e: e["reply"]), lambda r: r.isNotNull()).alias("replies"),
        F.aggregate("e", F.lit(0).cast("long"), lambda s, e: s + e["chars"]).alias("formatted_chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what was read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), F.array_join("replies", "").alias("loss"), "formatted_chars").select(
        "conv_id", "n_turns", F.sha2("said", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
