"""Dialogues seen by each of their speakers, as chat-formatted training text.

For every participant the dialogue is rendered with that speaker as the assistant and all others as named users; the
mask covers what that speaker says.  A dialogue is cut into parts of PART_TURNS turn numbers, so no row and no task
grows with the length of a conversation; a part whose turn numbers repeat is cut again into slices of as many turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 256
#: Roles that are kept as they are and take no perspective.
FIXED_ROLES = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
UNNAMED = "unknown"


def _tag(fixed: tuple[str, ...]) -> Column:
    role = F.coalesce("role", F.lit(UNNAMED))
    return F.when(F.col("role").isin(*fixed), role).when(F.col("role") == F.col("speaker"), "assistant") \
        .otherwise(F.concat(F.lit("user name="), role))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS, fixed: tuple[str, ...] = FIXED_ROLES) -> DataFrame:
    """conv_id, speaker, part, slice, n_turns, text, mask, n_mask_chars: one row per speaker and part of a dialogue.

    turns: conv_id, turn, role, text.  `mask` lists the code-point spans "start-end" of the speaker's own turns in
    `text`, with their closing mark.  Turns are in the order of turn, role and text, nulls first; repeated rows are
    repeated turns.  A null role is rendered as a user named "unknown" and takes no perspective, so a dialogue of null
    and fixed roles only gives no row.  Null text: an empty turn.  Null turns form part -1.  Null conv_id: a dialogue of
    its own.  Extra columns are ignored."""
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"),
                        F.coalesce(F.floor(F.col("turn") / part_turns), F.lit(-1)).cast("long").alias("part"))
    place = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    rows = rows.withColumn("place", F.row_number().over(place) - 1) \
        .withColumn("slice", F.floor(F.col("place") / part_turns).cast("long"))
    speakers = turns.filter(F.col("role").isNotNull() & ~F.col("role").isin(*fixed)) \
        .select(F.col("conv_id").alias("c"), F.col("role").alias("speaker")).distinct()
    seen = rows.join(speakers, F.col("conv_id").eqNullSafe(F.col("c"))) \
        .withColumn("own", F.col("role").eqNullSafe(F.col("speaker"))) \
        .withColumn("front", F.concat(F.lit(OPEN), _tag(fixed), F.lit("\n"))) \
        .select("conv_id", "speaker", "part", "slice", "place", "own", "front", F.concat("front", "text", F.lit(CLOSE)).alias("said"))
    key = ["conv_id", "speaker", "part", "slice"]
    end = F.sum(F.length("said")).over(Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    # the line end after the closing mark is not the speaker's
    seen = seen.withColumn("end", end - 1).withColumn("start", F.col("end") + 1 - F.length("said") + F.length("front"))
    got = seen.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.sort_array(F.collect_list(F.struct("place", "said"))).alias("said"),
        F.sort_array(F.collect_list(F.when(F.col("own"), F.struct("place", "start", "end")))).alias("own"),
        F.sum(F.when(F.col("own"), F.col("end") - F.col("start")).otherwise(0)).alias("n_mask_chars"))
    spans = F.transform("own", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return got.select(*key, "n_turns", F.concat_ws("", F.col("said.said")).alias("text"), F.concat_ws(",", spans).alias("mask"), "n_mask_chars")
