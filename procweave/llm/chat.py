"""Chat formatting by perspective rotation (DataFrame functions only).

Every participant of a conversation gets a rendering in which that speaker is
the assistant and all others are users with their names; system turns stay
system turns and are nobody's perspective. A rendering is a row per turn: the
rendered segment, its place in the whole rendering, and the loss mask (the
assistant's text and end marker). Segments of a rendering joined in ``seq``
order are the rendering, so no conversation is ever collected into one value.

Places come from sums in two levels, over stretches of ``STRETCH`` turn numbers
and then over the stretches, so a conversation with very many turns is spread
over tasks; exact repeats of a turn are counted before anything is sorted.

Defined results: turns are ordered by (turn, speaker, text), nulls first; exact
repeats of a row appear as often as they occur; a null text is empty; a null
speaker is a user named ``unknown`` and no perspective; a null conversation id
is a conversation of its own; a conversation without participants gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SYSTEM = ("system",)
UNKNOWN = "unknown"
STRETCH = 256


def _header(speaker: Column, assistant: Column, system: tuple[str, ...]) -> Column:
    name = F.coalesce(speaker, F.lit(UNKNOWN))
    kind = (F.when(name.isin(*system), F.lit("system")).when(speaker.eqNullSafe(assistant), F.lit("assistant"))
            .otherwise(F.concat(F.lit("user name="), name)))
    return F.concat(F.lit(OPEN), kind, F.lit("\n"))


def perspectives(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
                 system: tuple[str, ...] = SYSTEM) -> DataFrame:
    """Rows (conv, assistant, seq, turn, speaker, segment, start, end, mask_start, mask_end); character positions.

    ``mask_start`` / ``mask_end`` are null for turns without loss.
    """
    rows = (turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.col(speaker).cast("string").alias("speaker"),
                         F.col(text).cast("string").alias("text"))
            .groupBy("conv", "turn", "speaker", "text").agg(F.count(F.lit(1)).alias("copies")))
    people = (rows.where(F.col("speaker").isNotNull() & ~F.col("speaker").isin(*system))
              .select(F.col("conv").alias("pconv"), F.col("speaker").alias("assistant")).distinct())
    seen = rows.join(people, rows["conv"].eqNullSafe(people["pconv"])).drop("pconv")
    segment = F.concat(_header(F.col("speaker"), F.col("assistant"), system), F.coalesce("text", F.lit("")), F.lit(CLOSE))
    seen = (seen.withColumn("segment", segment).withColumn("size", F.length("segment").cast("long"))
            .withColumn("stretch", F.coalesce(F.floor(F.col("turn") / STRETCH), F.lit(-(1 << 62)))))
    within = (Window.partitionBy("conv", "assistant", "stretch").orderBy(
        F.col("turn").asc_nulls_first(), F.col("speaker").asc_nulls_first(), F.col("text").asc_nulls_first())
        .rowsBetween(Window.unboundedPreceding, -1))
    sums = seen.groupBy("conv", "assistant", "stretch").agg(
        F.sum(F.col("size") * F.col("copies")).alias("chars"), F.sum("copies").alias("n"))
    before = Window.partitionBy("conv", "assistant").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("sconv"), F.col("assistant").alias("sassistant"), F.col("stretch").alias("sstretch"),
                       F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
                       F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    placed = (seen.withColumn("chars_in", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
              .withColumn("n_in", F.coalesce(F.sum("copies").over(within), F.lit(0))))
    placed = placed.join(sums, placed["conv"].eqNullSafe(sums["sconv"]) & (placed["assistant"] == sums["sassistant"])
                         & (placed["stretch"] == sums["sstretch"]))
    copy = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("chars_before") + F.col("chars_in") + F.col("copy") * F.col("size")
    target = F.col("speaker").eqNullSafe(F.col("assistant"))
    head = F.length(_header(F.col("speaker"), F.col("assistant"), system))
    return copy.select(
        F.col("conv").alias(conv), "assistant", (F.col("n_before") + F.col("n_in") + F.col("copy")).alias("seq"),
        F.col("turn").alias(turn), F.col("speaker").alias("speaker"), "segment",
        start.alias("start"), (start + F.col("size")).alias("end"),
        F.when(target, start + head).alias("mask_start"), F.when(target, start + F.col("size") - 1).alias("mask_end"))
