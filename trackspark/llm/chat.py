"""Chat formatting by multi-party perspective rotation, in DataFrame operations only.

For every conversation and every participant (each distinct role other than the system role) the whole dialogue is rendered
once with that participant as `assistant`, the others as named users, and a mask that marks what a model would be trained on:
the participant's own words and the end marker that follows them.

What is said can't forge turns: in a text, the "<|" that markers start with gets a backslash in between, and one more if backslashes stand there already; in the
names of roles, backslashes are doubled, and line breaks and "<|" are escaped by a backslash. plain_text() and plain_name() undo both. Markers
in the input so are ordinary text, and count as such in all lengths.

Defined cases: a null role is the participant `unknown`; a null text is empty; each row without a conversation id is a conversation of one
turn; turns are ordered by (turn, role, text) with null turns first, so that ties have one order; repeated rows are repeated
turns; a conversation of system turns only has no participants and no rows; texts of any length count whole; an empty table gives no rows. Extra columns are
ignored, whatever their names.

One shuffle, on the conversation id. A conversation must fit into one row, because the rendered dialogue is one value; its
rows are gathered by conversation only, and no conversation is joined with anything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, SYSTEM = "<|im_start|>", "<|im_end|>", "system"


def shown_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def plain_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


_NAMES = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("<|", "<\\|"))


def shown_name(role: Column) -> Column:
    for a, b in _NAMES:
        role = F.replace(role, F.lit(a), F.lit(b))
    return role


def plain_name(name: Column) -> Column:
    """Each backslash stands for the character after it, n and r for line breaks. Names must not hold U+0000."""
    marked = F.regexp_replace(name, r"\\(.)", "\u0000$1")
    for a, b in (("\u0000n", "\n"), ("\u0000r", "\r"), ("\u0000", "")):
        marked = F.replace(marked, F.lit(a), F.lit(b))
    return marked


def rotate_perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation and participant: conversation, speaker, rendered, mask_spans, n_turns, n_own, trained_chars.

    mask_spans is an array of struct(start, end), character offsets into rendered, in order.
    """
    said = turns.select(
        F.col(conv).alias("conversation"),
        F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("alone"),
        F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("m"),
    )
    whole = said.groupBy("conversation", "alone").agg(F.sort_array(F.collect_list("m")).alias("m"))
    rotated = whole.withColumn("speaker", F.explode(F.array_distinct(F.filter(F.transform("m", lambda x: x["role"]), lambda r: r != SYSTEM))))

    def head(x: Column) -> Column:
        name = F.when(x["role"] == F.col("speaker"), F.lit("assistant")).when(x["role"] == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), shown_name(x["role"])))
        return F.concat(F.lit(START), name, F.lit("\n"))

    parts = F.transform("m", lambda x: F.struct((x["role"] == F.col("speaker")).alias("own"), head(x).alias("head"), F.concat(shown_text(x["text"]), F.lit(END)).alias("body")))
    rotated = rotated.select("conversation", "speaker", parts.alias("p"))
    # Positions: a running sum carried as (position, spans) through the turns; each turn adds its header, its body and one newline.
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["head"])
        end = start + F.char_length(x["body"])
        span = F.array(F.struct(start.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(x["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return rotated.select(
        "conversation",
        "speaker",
        F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("p", empty, step, lambda acc: acc["spans"]).alias("mask_spans"),
        F.size("p").cast("long").alias("n_turns"),
        F.size(F.filter("p", lambda x: x["own"])).cast("long").alias("n_own"),
    ).withColumn("trained_chars", F.aggregate("mask_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))
