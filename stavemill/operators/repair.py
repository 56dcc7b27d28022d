"""Repairs of recognised token sequences (Q8-Q13) and the generic vote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import duration_ticks, is_barline, is_chord, key_accidental, suffix
from ..functions.vocab import OCTAVES, SPELLINGS
from .sequence import (assign_voice, before, flag, renumber, scaled_ticks, tuplet_open,
                       whole_score)

# Measure lengths (ticks) the vote knows; 72 is split by note counts.
VOTED_TIMES = {96: "time-4/4", 48: "time-2/4"}
COMPOUND_TICKS = 72
# Span pairs that must nest.
SPAN_TYPES = ("slur", "hairpin-cresc", "hairpin-dim", "ottava-8va", "ottava-8vb", "tuplet-3")


def majority_vote(values: DataFrame, keys: list[str], value: str, order: str,
                  prefer: Column | None = None, tie: str = "first") -> DataFrame:
    """Most frequent value per key.

    ``prefer`` restricts the vote to matching values when there are any; equal counts go to the
    earliest ``order`` (``tie="first"``) or to the larger value (``tie="larger"``). Counts are
    combined map-side, so a key of any size is reduced before the exchange.
    """
    pref = flag(prefer) if prefer is not None else F.lit(1)
    counts = values.groupBy(*keys, value).agg(F.count("*").alias("votes"),
                                              F.min(order).alias("first_at"),
                                              F.max(pref).alias("_pref"))
    rank = (F.struct("_pref", "votes", -F.col("first_at")) if tie == "first"
            else F.struct("_pref", "votes", value))
    best = F.max_by(F.struct(value, "votes", "first_at"), rank)
    return counts.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def _time_for(ticks: Column, n8: Column, n4: Column) -> Column:
    expr = F.when(ticks == COMPOUND_TICKS,
                  F.when(n8 > n4, "time-6/8").otherwise("time-3/4"))
    for t, sig in VOTED_TIMES.items():
        expr = expr.when(ticks == t, sig)
    return expr


def fix_time_signature(tokens: DataFrame) -> DataFrame:
    """Q8: rewrites the first ``time-`` token to the majority measure length.

    Closed measures vote with the length of the voice that carries the barlines (bass when grand).
    Counts and the winner are windows below ``score_id``, so the tokens are read once and nothing
    is joined back.
    """
    t = F.col("token")
    df = tuplet_open(assign_voice(tokens), "beats")
    part = Window.partitionBy("score_id", "voice", "measure_idx")
    ticks = scaled_ticks(duration_ticks(t), F.col("in_tuplet"))
    df = df.select(
        "score_id", "pos", "token", "voice", "measure_idx",
        F.coalesce(F.sum(F.when(t != "staff-bass", ticks)).over(part), F.lit(0)).alias("ticks"),
        F.sum(flag(t == "dur-1/8")).over(part).alias("n8"),
        F.sum(flag(t == "dur-1/4")).over(part).alias("n4"),
        (F.max(flag(t == "staff-bass")).over(whole_score()) == 1).alias("grand"),
        F.min(F.when(t.startswith("time-"), F.col("pos"))).over(whole_score()).alias("first_time"))
    # A measure votes once, through its barline row.
    votes = is_barline(t) & (~F.col("grand") | (F.col("voice") == "bass"))
    df = df.withColumn("len", F.when(votes, F.col("ticks")))
    same = Window.partitionBy("score_id", "len")
    tally = F.when(F.col("len").isNotNull(), F.struct(
        F.count("len").over(same).alias("n"), (-F.min("measure_idx").over(same)).alias("f"), "len",
        F.sum("n8").over(same).alias("n8"), F.sum("n4").over(same).alias("n4")))
    df = df.withColumn("tally", tally).withColumn("best", F.max("tally").over(whole_score()))
    voted = _time_for(F.col("best.len"), F.col("best.n8"), F.col("best.n4"))
    new = F.when(F.col("pos") == F.col("first_time"), F.coalesce(voted, t)).otherwise(t)
    return df.select("score_id", "pos", new.alias("token"))


def running_time_signature(tokens: DataFrame) -> DataFrame:
    """Q9: the same vote after each barline, on the measures closed so far.

    The running leader is a running maximum: the count of a length at measure j is its rank
    among equal lengths, so no prefix self-join is needed.
    """
    df = assign_voice(tokens)
    seen = F.min(F.when(F.col("token").startswith("time-"), F.col("pos"))).over(whole_score())
    grand = F.max(flag(F.col("token") == "staff-bass")).over(whole_score())
    df = df.select("score_id", "pos", "token", "measure_idx", "voice",
                   seen.alias("time_pos"), grand.alias("grand"))
    df = tuplet_open(df, "beats")
    voiced = (F.col("grand") == 0) | (F.col("voice") == "bass")
    ticks = F.when(voiced, scaled_ticks(duration_ticks("token"), F.col("in_tuplet")))
    per = df.groupBy("score_id", "measure_idx").agg(
        F.coalesce(F.sum(ticks), F.lit(0)).cast("bigint").alias("ticks"),
        F.sum(flag(voiced & (F.col("token") == "dur-1/8"))).alias("n8"),
        F.sum(flag(voiced & (F.col("token") == "dur-1/4"))).alias("n4"),
        F.max(F.when(is_barline("token"), F.col("pos"))).alias("bar_pos"),
        F.max("time_pos").alias("time_pos"))
    per = per.filter(F.col("bar_pos") > F.col("time_pos"))
    same = Window.partitionBy("score_id", "ticks").orderBy("measure_idx")
    per = per.select("*", F.row_number().over(same).alias("cnt"),
                     F.first("measure_idx").over(same).alias("first_m"))
    run = (Window.partitionBy("score_id").orderBy("measure_idx")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lead = F.max(F.struct("cnt", -F.col("first_m"), "ticks")).over(run)
    per = per.withColumn("majority_ticks", lead["ticks"])
    return per.select("score_id", "measure_idx", "majority_ticks",
                      _time_for(F.col("majority_ticks"), F.col("n8"), F.col("n4"))
                      .alias("corrected"))


def fix_accidentals(tokens: DataFrame) -> DataFrame:
    """Q10: naturals altered by the (first) key signature get its accidental, if spellable."""
    first = F.min(F.when(F.col("token").startswith("key-"), F.struct("pos", "token"))).over(whole_score())
    df = tokens.withColumn("_key", suffix(first["token"], "key-"))
    pat = r"^(note|chord)-([A-G])([0-9])$"
    letter, octave = F.regexp_extract("token", pat, 2), F.regexp_extract("token", pat, 3)
    name = F.concat(letter, key_accidental("_key", letter))
    spellable = name.isin(*SPELLINGS) & octave.isin(*[str(o) for o in OCTAVES])
    new = F.concat(F.regexp_extract("token", pat, 1), F.lit("-"), name, octave)
    return df.select("score_id", "pos",
                     F.when((letter != "") & F.col("_key").isNotNull() & spellable, new)
                     .otherwise(F.col("token")).alias("token"))


def drop_orphan_chords(tokens: DataFrame) -> DataFrame:
    """Q11: a chord tone stays only after a note, a duration or a kept chord tone."""
    last = F.last(F.when(~is_chord("token"), F.col("token")), True).over(before())
    df = tokens.withColumn("_last", last)
    keep = ~is_chord("token") | F.coalesce(F.col("_last").startswith("note-")
                                           | F.col("_last").startswith("dur-"), F.lit(False))
    return renumber(df.filter(keep).drop("_last"), ["score_id"], ["pos"])


def drop_unmatched_spans(tokens: DataFrame) -> DataFrame:
    """Q12: removes span starts and ends without a partner (LIFO within each type).

    With d the running depth of a type, an end is unmatched when d falls below every earlier
    value, and a start when no later depth returns to the depth before it.
    """
    names = list(SPAN_TYPES)
    kind = F.when(F.col("token").isin(*[f"{s}-start" for s in names]), 1).when(
        F.col("token").isin(*[f"{s}-end" for s in names]), -1)
    span = F.when(kind.isNotNull(), F.regexp_extract("token", r"^(.*)-(start|end)$", 1))
    w = Window.partitionBy("score_id", "_span").orderBy("pos")
    back = Window.partitionBy("score_id", "_span").orderBy(F.desc("pos"))
    df = tokens.select("*", kind.alias("_k"), span.alias("_span"))
    df = df.withColumn("_d", F.sum("_k").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    df = df.withColumn("_min", F.least(F.lit(0), F.min("_d").over(
        w.rowsBetween(Window.unboundedPreceding, -1))))
    df = df.withColumn("_later", F.min("_d").over(
        back.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    unmatched = (((F.col("_k") == -1) & (F.col("_d") < F.col("_min")))
                 | ((F.col("_k") == 1) & (F.col("_d") - 1 < F.col("_later"))))
    kept = df.filter(~F.coalesce(unmatched, F.lit(False))).select("score_id", "pos", "token")
    return renumber(kept, ["score_id"], ["pos"])


def repair(tokens: DataFrame) -> DataFrame:
    """The full chain: orphan chords, spans, time signature, accidentals."""
    return fix_accidentals(fix_time_signature(drop_unmatched_spans(drop_orphan_chords(tokens))))


def flag_beat_mismatch(tokens: DataFrame) -> DataFrame:
    """Q13: grand-staff measures whose treble length differs from the majority bass length.

    Segments are cut only at barlines that close a lower staff; only known lengths are used.
    """
    df = assign_voice(tokens)
    closes = flag(is_barline("token") & (F.col("voice") == "bass"))
    seg = F.coalesce(F.sum(closes).over(before()), F.lit(0)).cast("int")
    df = df.withColumn("closes", closes).withColumn("measure_idx", seg)
    ticks = scaled_ticks(duration_ticks("token"), F.col("in_tuplet"))
    # One row per segment: a pivot by conditional sums.
    per = tuplet_open(df, "beats").groupBy("score_id", "measure_idx").agg(
        F.coalesce(F.sum(F.when(F.col("voice") == "treble", ticks)), F.lit(0)).alias("treble"),
        F.coalesce(F.sum(F.when(F.col("voice") == "bass", ticks)), F.lit(0)).alias("bass"),
        F.max("closes").alias("closed")).filter("closed = 1")
    same = Window.partitionBy("score_id", "bass")
    per = per.withColumn("vote", F.struct(F.count("*").over(same).alias("n"),
                                          (-F.min("measure_idx").over(same)).alias("f"), "bass"))
    per = per.withColumn("expected", F.max("vote").over(whole_score())["bass"])
    return (per.filter(F.col("expected").isin(96, 72, 48) & (F.col("treble") != F.col("expected")))
            .select("score_id", "measure_idx", F.col("treble").alias("treble_ticks"),
                    F.col("expected").alias("expected_ticks")))
