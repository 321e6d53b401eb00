"""Chat formatting: multi-party perspective rotation (DataFrame functions only).

Every participant of a dialogue is rendered once as the assistant; the other
speakers become named users, system turns stay system turns. A mask tells
which characters of the rendering are training targets.

Defined results
* A turn stored twice (same conversation, turn, role and text) is one turn.
* Different rows under one turn number are ordered by role, then text.
* A row without conversation or turn number has no place in a dialogue and is
  rendered as a dialogue of its own (``part`` is -1, ``part_key``, a hash that is
  not 0 for them, tells such rows apart).
* A null role speaks as ``unknown`` and is nobody's perspective; a system role
  is context, not a participant. Dialogues without participants give no row.
* Null text is empty text. Turn markers inside a text are broken up by a
  space, so that a text can't forge a turn.
* A dialogue is one row for each participant, whole, whatever its turn numbers
  are (``part`` is 0). One of more than ``part_turns`` turns, which no row and no task
  should hold, comes in parts of so many turns, counted in order (not by turn
  number); parts in order, joined, are the dialogue. With None nothing is cut.
* Ties can't change a result: equal rows are one turn, others are ordered as above.
* Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innsight.llm.columns import written
from innsight.llm.rows_by_id import split_by_ids

START, END = "<|im_start|>", "<|im_end|>"
PART_TURNS = 65_536
BROKEN_START, BROKEN_END = "< |im_start|>", "< |im_end|>"


def _safe(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(START), F.lit(BROKEN_START)),
                     F.lit(END), F.lit(BROKEN_END))


def rotate_perspectives(turns: DataFrame, part_turns: int | None = PART_TURNS, system_role: str = "system",
                        conv: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text") -> DataFrame:
    """One row per dialogue part and participant.

    Columns: conv_id, part, part_key, participant, n_turns, n_target_turns,
    rendered, mask. ``mask`` is an array of structs (chars, target) in text
    order: runs of characters and whether they are training targets.

    Participants are found with a distinct over (conversation, role), which
    pre-aggregates before its shuffle. The join of parts with participants is
    the result itself (parts x participants); adaptive execution splits it
    where one conversation is hot. Rendering runs inside each joined row.
    """
    t = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                     F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    t = (t.distinct()
         .withColumn("part_key", F.when(placed, F.lit(0))
                     .otherwise(F.xxhash64("turn", "role", "text")).cast("long")))
    t = t.withColumn("part", F.when(F.col("part_key") == 0, F.lit(0)).otherwise(F.lit(-1)).cast("long"))
    if part_turns is not None:
        t = written(t, "turns")
        longer = t.filter("part = 0").groupBy("conv_id").count().filter(F.col("count") > part_turns).select("conv_id")
        if not longer.isEmpty():
            # only these are numbered; the window sorts, on disk where a dialogue is large, and keeps no group
            many, rest = split_by_ids(t, longer, ["conv_id"])
            order = Window.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
            place = F.floor((F.row_number().over(order) - 1) / part_turns)
            t = rest.unionByName(many.withColumn("part", F.when(F.col("part") == 0, place).otherwise(F.col("part"))))
    keys = ["conv_id", "part", "part_key"]
    parts = t.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "turn", "role", "text"))).alias("turns"))
    spoken = t.filter(F.col("role").isNotNull() & (F.col("role") != system_role))
    # a row without a place is its own dialogue: its speaker is its only participant
    who = spoken.select(
        "conv_id", F.when(F.col("part_key") == 0, F.lit(0)).otherwise(F.col("part_key"))
        .alias("own_key"), F.col("role").alias("participant")).distinct()
    joined = parts.join(who, parts["conv_id"].eqNullSafe(who["conv_id"])
                        & (F.col("part_key") == F.col("own_key"))).drop(who["conv_id"])

    me = F.col("participant")

    def header(x: Column) -> Column:
        name = F.regexp_replace(F.coalesce(x["role"], F.lit("unknown")), r"[\r\n]", " ")
        return F.when(x["role"] == me, F.lit(f"{START}assistant\n")).when(
            x["role"] == system_role, F.lit(f"{START}system\n")).otherwise(
            F.concat(F.lit(f"{START}user name="), _safe(name), F.lit("\n")))

    def target(x: Column) -> Column:
        return F.coalesce(x["role"] == me, F.lit(False))

    body = lambda x: F.concat(_safe(x["text"]), F.lit(f"{END}\n"))
    return joined.select(
        "conv_id", "part", "part_key", "participant",
        F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", target)).cast("long").alias("n_target_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(header(x), body(x))), "")
        .alias("rendered"),
        F.flatten(F.transform("turns", lambda x: F.array(
            F.struct(F.length(header(x)).alias("chars"), F.lit(False).alias("target")),
            F.struct(F.length(body(x)).alias("chars"), target(x).alias("target")))))
        .alias("mask"))


def mask_text(mask: str = "mask") -> Column:
    """The mask as text, for example ``24-,120+``: runs of context (-) and target (+) characters."""
    return F.array_join(F.transform(mask, lambda m: F.concat(
        m["chars"].cast("string"), F.when(m["target"], "+").otherwise("-"))), ",")
