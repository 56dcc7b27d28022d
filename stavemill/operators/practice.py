"""Playback schedules, practice steps and scores (P1-P5), top-k and set operators (K1-K6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions.tokens import TICKS_PER_QUARTER
from .sequence import by_staff, flag, staff_up_to

SOUNDING = 0.9  # fixed value: share of a note's length that sounds
MAX_BOTH, MAX_RIGHT, HINT_PENALTY = 150, 100, 10  # fixed values


def seconds(ticks: Column, tempo: Column | int) -> Column:
    return ticks * 60.0 / (TICKS_PER_QUARTER * (F.lit(tempo) if isinstance(tempo, int) else tempo))


def merged_schedule(notes: DataFrame, tempo: int = 100) -> DataFrame:
    """Every sounding pitch with its onset and length, both staves on one clock.

    Onsets are running sums of whole ticks, so parts cannot drift; rests only advance time.
    """
    onset = F.sum("ticks").over(staff_up_to()) - F.col("ticks")
    df = notes.withColumn("onset_ticks", onset).filter(F.col("pitch") != "")
    return df.select(
        "score_id", "staff", "note_idx", "onset_ticks",
        seconds(F.col("onset_ticks"), tempo).alias("onset_sec"),
        (seconds(F.col("ticks"), tempo) * SOUNDING).alias("sounding_sec"),
        F.posexplode(F.concat(F.array("pitch"), "chord")).alias("tone", "pitch"))


def part_schedule(notes: DataFrame, staff: str = "treble", from_idx: int = 0, tempo: int = 100
                  ) -> DataFrame:
    """One staff from a given note on, with the clock starting there."""
    part = notes.filter((F.col("staff") == staff) & (F.col("note_idx") >= from_idx))
    return merged_schedule(part, tempo)


def wait_timeline(notes: DataFrame, tempo: int = 100) -> DataFrame:
    """Keys to press in order; rests are skipped with their length, and each row knows the
    key expected after it."""
    after = by_staff().rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(~F.col("is_rest"), F.col("note_idx")), True).over(after)
    df = notes.select(
        "score_id", "staff", "note_idx", "pitch", "ticks", "is_rest", nxt.alias("next_idx"),
        (F.sum("ticks").over(staff_up_to()) - F.col("ticks")).alias("at_ticks"))
    return df.select("score_id", "staff", "note_idx", "at_ticks", "next_idx",
                     F.when(~F.col("is_rest"), F.col("pitch")).alias("expected"),
                     F.when(F.col("is_rest"), seconds(F.col("ticks"), tempo)).alias("skip_sec"))


def performance_steps(notes: DataFrame, hand: str = "both", midi_confirmed: bool = True,
                      compat: bool = False) -> DataFrame:
    """The notes to play, without rests, cut at beat 1, as (measure, step, pitches).

    Two hands need a lower staff and a confirmed keyboard, otherwise only the upper staff counts.
    Measures are cut before rests are dropped; ``compat`` drops rests first.
    """
    both = hand == "both" and midi_confirmed
    staves = notes.filter(F.col("staff").isin("treble", "bass") if both
                          else F.col("staff") == "treble")
    if compat:
        staves = staves.filter(~F.col("is_rest"))
    first = F.lag("beat").over(by_staff()).isNull()
    df = staves.withColumn("_o", flag((F.col("beat") == 1) & ~first))
    df = df.withColumn("measure", F.sum("_o").over(staff_up_to()).cast("int"))
    if not compat:
        df = df.filter(~F.col("is_rest"))
        # A measure of rests in every hand vanishes; otherwise both hands keep one numbering.
        df = df.withColumn("measure", F.dense_rank().over(
            Window.partitionBy("score_id").orderBy("measure")) - 1)
    w = Window.partitionBy("score_id", "staff", "measure").orderBy("note_idx")
    grand = F.max(flag(F.col("staff") == "bass")).over(Window.partitionBy("score_id"))
    return df.select("score_id", "staff", "measure", (F.row_number().over(w) - 1).alias("step"),
                     "beat", F.concat(F.array("pitch"), "chord").alias("pitches"),
                     F.when(grand == 1, MAX_BOTH).otherwise(MAX_RIGHT).alias("max_score"))


def final_score(correct: Column, wrong: Column, max_score: Column, hint_used: Column,
                ranked: Column) -> Column:
    """P5: share of correct presses scaled to the maximum, one decimal, halves up."""
    total = correct + wrong
    one_decimal = lambda x: F.floor(x * 10 + 0.5) / 10.0
    base = F.when(total > 0, F.floor(correct / total * max_score * 10 + 0.5) / 10.0).otherwise(0.0)
    hinted = F.greatest(F.lit(0.0), one_decimal(base - HINT_PENALTY))
    return F.when(ranked, F.when(hint_used, hinted).otherwise(base))


def leaderboard_topk(entries: DataFrame, k: int = 3) -> DataFrame:
    """K1: best ``k`` entries per song; a missing score counts 0, ties go to the earlier entry.

    The rank filter is pushed below the exchange as a per-task limit, so a huge song sends only
    ``k`` rows per task.
    """
    w = Window.partitionBy("song").orderBy(F.coalesce("score", F.lit(0.0)).desc(), "created_at",
                                           "entry_id")
    return entries.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def first_pairs(pairs: DataFrame, n: int, order: str = "stem") -> DataFrame:
    """K3: the first ``n`` pairs of the sorted listing."""
    return pairs.orderBy(order).limit(n)


def chord_top(notes: DataFrame) -> DataFrame:
    """K4: highest tone of each event."""
    tones = F.transform(F.concat(F.array("pitch"), "chord"),
                        lambda p: F.struct(P.pitch_to_midi(p).alias("m"), p.alias("p")))
    return notes.filter(~F.col("is_rest")).select("score_id", "staff", "note_idx",
                                                  F.array_max(tones)["p"].alias("top"))


def stem_sets(images: DataFrame, labels: DataFrame) -> DataFrame:
    """K5: membership of every stem: in both sets, only images, or only labels. One grouping over both."""
    both = images.select("stem", F.lit(1).alias("i"), F.lit(0).alias("l")).unionByName(
        labels.select("stem", F.lit(0).alias("i"), F.lit(1).alias("l")))
    side = (F.when((F.max("i") == 1) & (F.max("l") == 1), "both").when(F.max("i") == 1, "image_only")
            .otherwise("label_only"))
    return both.groupBy("stem").agg(side.alias("side"))


def shared_result(documents: DataFrame, key) -> DataFrame:
    """K6: lookup of a shared result by id (a pushed-down filter)."""
    return documents.filter(F.col("id") == key)
