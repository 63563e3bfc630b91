"""Preference pairs out of conversations, in DataFrame operations only.

A pair is two conversations, chosen and rejected. Their longest common prefix of turns (role
and text) is rendered once, as the prompt; what follows is rendered as the two completions,
with the places in each that count for training: the texts of the assistant's turns.

Repeated rows are dropped with map-side combination before turns meet in their conversation,
which is the only group that is collected: it becomes one cell of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rendering.
START, MIDDLE, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
TRAINED_ROLE = "assistant"


def _rendered(turn: Column) -> Column:
    return F.concat(
        F.lit(START), F.coalesce(turn["role"], F.lit("")), F.lit(MIDDLE),
        F.coalesce(turn["text"], F.lit("")), F.lit(STOP),
    )


def _text(turns: Column) -> Column:
    return F.concat_ws("", F.transform(turns, _rendered))


def _spans(turns: Column) -> Column:
    """start and length, in characters, of each text that counts in the rendered turns."""
    empty = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("out")
    )

    def add(done: Column, turn: Column) -> Column:
        role, text = F.coalesce(turn["role"], F.lit("")), F.coalesce(turn["text"], F.lit(""))
        start = done["at"] + F.length(role) + len(START) + len(MIDDLE)
        span = F.struct(start.alias("start"), F.length(text).alias("length"))
        return F.struct(
            (start + F.length(text) + len(STOP)).alias("at"),
            F.when(turn["role"] == TRAINED_ROLE, F.array_append(done["out"], span))
            .otherwise(done["out"])
            .alias("out"),
        )

    return F.aggregate(turns, empty, add, lambda done: done["out"])


def format_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, side, turn, role, text) with side chosen or rejected -> a row for each pair.

    pair_id, n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans. Turns are in
    the order of their number, then role, then text; a turn without a number comes first.
    Equal rows count once. A null role or text is empty in the rendering, but equals only a
    null in the other conversation. A pair of which one side is missing has no common prefix:
    its prompt is empty and the missing completion null. Rows without a pair or of another
    side are left out. If one side is the start of the other, its completion is empty.
    """
    sides = (
        turns.where("pair_id IS NOT NULL AND side IN ('chosen', 'rejected')")
        .select(
            "pair_id",
            "side",
            F.col("turn").cast("long").alias("turn"),
            F.col("role").cast("string").alias("role"),
            F.col("text").cast("string").alias("text"),
        )
        .distinct()
    )
    turn = F.struct("turn", "role", "text")
    pairs = sides.groupBy("pair_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == "chosen", turn))).alias("c"),
        F.sort_array(F.collect_list(F.when(F.col("side") == "rejected", turn))).alias("r"),
    )
    same = F.zip_with(
        "c", "r", lambda a, b: a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"])
    )
    shorter = F.least(F.size("c"), F.size("r"))
    first_other = F.array_position(same, False)
    n_prefix = F.when(first_other > 0, F.least(first_other - 1, shorter)).otherwise(shorter)
    cut = pairs.withColumn("n_prefix", n_prefix.cast("int")).select(
        "pair_id",
        "n_prefix",
        F.slice("c", F.lit(1), F.col("n_prefix")).alias("p"),
        F.when(F.size("c") > 0, F.slice("c", F.col("n_prefix") + 1, F.size("c"))).alias("c"),
        F.when(F.size("r") > 0, F.slice("r", F.col("n_prefix") + 1, F.size("r"))).alias("r"),
    )
    return cut.select(
        "pair_id",
        F.col("n_prefix").cast("long").alias("n_prefix"),
        _text(F.col("p")).alias("prompt"),
        F.when(F.col("c").isNotNull(), _text(F.col("c"))).alias("chosen"),
        F.when(F.col("r").isNotNull(), _text(F.col("r"))).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"),
        _spans(F.col("r")).alias("rejected_spans"),
    )


def pairs_of_answers(conversations: DataFrame) -> DataFrame:
    """Pairs for a table of single conversations (conv_id, turn, role, text).

    Chosen is the conversation itself. Rejected is the same up to its last answer, in whose
    place the last answer of the next conversation stands, that of conv_id + 1. Without an
    answer, or a next conversation with one, a pair has its chosen side only. Rows without a
    conv_id are left out; null roles and texts and repeated rows go on as they are, for
    `format_pairs` to settle; an empty table gives no pair.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("pair_id"), "turn", "role", "text"
    )
    answers = (
        rows.where(F.col("role") == TRAINED_ROLE)
        .groupBy("pair_id")
        .agg(F.max(F.struct("turn", "text")).alias("last"))
    )
    swaps = answers.select("pair_id", F.col("last.turn").alias("last_turn")).join(
        answers.select((F.col("pair_id") - 1).alias("pair_id"), F.col("last.text").alias("other")),
        "pair_id",
    )
    chosen = rows.withColumn("side", F.lit("chosen"))
    kept = (
        rows.join(swaps.select("pair_id", "last_turn"), "pair_id")
        .where("turn < last_turn")
        .select("pair_id", "turn", "role", "text")
    )
    swapped = swaps.select(
        "pair_id",
        F.col("last_turn").alias("turn"),
        F.lit(TRAINED_ROLE).alias("role"),
        F.col("other").alias("text"),
    )
    rejected = kept.unionByName(swapped).withColumn("side", F.lit("rejected"))
    return chosen.unionByName(rejected)
