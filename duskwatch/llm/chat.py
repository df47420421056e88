"""Multi-party perspective rotation, in DataFrame operations only.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users. The rendering is kept as segments: one row per
perspective and turn with the text, its place in the whole rendering and the mask, which is
1 for what the assistant says. A conversation with very many turns so stays spread over
tasks.

A participant is a distinct role, null being one of its own named ``unknown``. A segment is

    <|im_start|>assistant\\nTEXT<|im_end|>\\n           for the perspective's own turns
    <|im_start|>user name=NAME\\nTEXT<|im_end|>\\n      for all others

and, of the assistant's segments, the text with its end mark is trained on.

Results for odd input: a null text is empty; rows without conversation id take no part;
turns of equal number (null first) follow each other by role and text, and rows that repeat another wholly get
neighbouring places; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
UNKNOWN = "unknown"
#: Turn numbers that are placed together.
SPAN = 1024
#: Stands before all others, for turns without number.
FIRST_SPAN = -(1 << 62)



def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation, perspective and turn, see the module's text.

    Columns: ``conv_id``, ``perspective``, ``position`` (from 0), ``turn``, ``speaker``, ``role``,
    ``segment``, ``start`` (characters of the rendering before it), ``mask`` (1 if trained on), and
    ``mask_start`` and ``mask_end``: the trained characters of the rendering, equal if there are none.

    Turns are cut into spans by turn number. A narrow pass finds what each span holds and so what
    stands before it, by perspective; texts cross one shuffle by (conversation, span) and are
    numbered within spans.
    """
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit(UNKNOWN)).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        F.coalesce(F.floor(F.col(turn_col) / SPAN), F.lit(FIRST_SPAN)).cast("long").alias("_span"),
    )
    user = len("user name=")
    fixed = len(START) + 1 + len(END)
    # what each speaker has in each span, all taken as users
    held = rows.groupBy("conv_id", "_span", "speaker").agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.length("_text").cast("long")).alias("_chars")
    )
    spans = held.groupBy("conv_id", "_span").agg(
        F.sum("_n").alias("_turns"), F.sum(F.col("_chars") + F.col("_n") * (fixed + user + F.length("speaker"))).alias("_chars")
    )
    people = held.select("conv_id", F.col("speaker").alias("perspective")).distinct()
    own = held.select("conv_id", "_span", F.col("speaker").alias("perspective"), F.col("_n").alias("_own"))
    shorter = F.length("perspective") + user - len("assistant")
    before = Window.partitionBy("conv_id", "perspective").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    side = (
        spans.join(people, "conv_id")
        .join(own, ["conv_id", "_span", "perspective"], "left")
        .withColumn("_chars", F.col("_chars") - F.coalesce("_own", F.lit(0)) * shorter)
        .select(
            "conv_id", "_span", "perspective",
            F.coalesce(F.sum("_chars").over(before), F.lit(0)).alias("_chars_before"),
            F.coalesce(F.sum("_turns").over(before), F.lit(0)).alias("_turns_before"),
        )
        .groupBy("conv_id", "_span")
        .agg(F.collect_list(F.struct("perspective", "_chars_before", "_turns_before")).alias("_sides"))
    )
    shown = rows.join(side, ["conv_id", "_span"]).select("*", F.inline("_sides")).drop("_sides")
    mine = F.col("perspective") == F.col("speaker")
    head = F.when(mine, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    shown = shown.withColumn("segment", F.concat(F.lit(START), head, F.lit("\n"), F.col("_text"), F.lit(END)))
    within = Window.partitionBy("conv_id", "_span", "perspective").orderBy(F.col("turn").asc_nulls_first(), "speaker", "_text")
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    length = F.length("segment").cast("long")
    start = F.col("_chars_before") + F.sum(length).over(upto) - length
    trained = F.length("_text") + len(END)
    placed = shown.select(
        "conv_id", "perspective", (F.col("_turns_before") + F.row_number().over(within) - 1).alias("position"), "turn", "speaker",
        F.when(mine, F.lit("assistant")).otherwise(F.lit("user")).alias("role"), "segment", start.alias("start"),
        mine.cast("int").alias("mask"), F.when(mine, trained).otherwise(F.lit(0)).alias("_trained"),
    )
    end = F.col("start") + F.length("segment")
    return placed.select(
        "conv_id", "perspective", "position", "turn", "speaker", "role", "segment", "start", "mask",
        (end - F.col("_trained")).alias("mask_start"), end.alias("mask_end"),
    )
