"""Note-event tables to tokens.

Input tables, all keyed by ``score_id``:

* elements ``(score_id, part, measure_idx, offset, el_idx, is_rest, quarters, triplet,
  pitches array<struct<midi,name,acc>>, artics, exprs, tie)``
* dynamics ``(score_id, part, measure_idx, offset, value)``
* measures ``(score_id, part, measure_idx, right_bar, starts_repeat)``
* headers ``(score_id, part, clef, fifths, time_sig)``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions.tokens import KEY_FIFTHS
from ..functions.vocab import TIMES, lookup
from .sequence import flag

# Source names to token suffixes; unmapped names are dropped.
ARTICULATIONS = {"Staccato": "staccato", "Accent": "accent", "Tenuto": "tenuto",
                 "StrongAccent": "marcato", "Staccatissimo": "staccatissimo"}
ORNAMENTS = {"Trill": "trill", "Mordent": "mordent", "InvertedMordent": "mordent", "Turn": "turn"}
DYNAMIC_ALIAS = {"fz": "f"}
EMPTY = "array<string>"


def _pitch_text(p: Column) -> Column:
    return P.respell_pitch(p["midi"], p["name"], p["acc"])["pitch"]


def _strings(*items: Column) -> Column:
    return F.array(*items) if items else F.array().cast(EMPTY)


def sorted_chord(pitches: Column) -> Column:
    """Lowest MIDI first; equal numbers keep their given order."""
    indexed = F.transform(pitches, lambda p, i: F.struct(p["midi"].alias("m"), i.alias("i"),
                                                         p.alias("p")))
    return F.transform(F.array_sort(indexed), lambda s: s["p"])


def suffix_tokens(artics: Column, exprs: Column, tie: Column) -> Column:
    """Articulations, then fermata / ornaments, then the tie to the next note."""
    a = F.filter(F.transform(artics, lambda x: F.concat(F.lit("artic-"), lookup(x, ARTICULATIONS))),
                 lambda x: x.isNotNull())
    e = F.filter(F.transform(exprs, lambda x: F.when(x == "Fermata", "fermata").otherwise(
        F.concat(F.lit("ornament-"), lookup(x, ORNAMENTS)))), lambda x: x.isNotNull())
    t = F.when(tie.isin("start", "continue"), _strings(F.lit("tie"))).otherwise(_strings())
    return F.concat(a, e, t)


def triplet_groups(elements: DataFrame) -> DataFrame:
    """Adds ``group_pos`` (0..2 inside a complete group of three, else NULL) and ``broken``
    for triplet elements left over at the end of a run, which print as plain durations."""
    m = Window.partitionBy("score_id", "part", "measure_idx").orderBy("offset", "el_idx")
    upto = m.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    change = flag(F.coalesce(F.lag("triplet").over(m), F.lit(False)) != F.col("triplet"))
    df = elements.withColumn("_c", change).withColumn("_run", F.sum("_c").over(upto))
    r = Window.partitionBy("score_id", "part", "measure_idx", "_run")
    rn = F.row_number().over(r.orderBy("offset", "el_idx")) - 1
    length = F.count("*").over(r)
    whole = F.col("triplet") & (rn < length - length % 3)
    return df.select(*elements.columns, F.when(whole, rn % 3).alias("group_pos"),
                     (F.col("triplet") & ~whole).alias("broken"))


def element_tokens(elements: DataFrame) -> DataFrame:
    """Adds ``toks`` (the element's tokens) and ``warned`` (snapped, respelled or broken)."""
    df = triplet_groups(elements)
    snap = P.snap_duration("quarters")
    df = df.withColumn("_s", snap).withColumn("_chord", sorted_chord(F.col("pitches")))
    d = F.when(F.col("group_pos").isNotNull(), F.lit("1/8")).otherwise(F.col("_s.token"))
    names = F.transform("_chord", _pitch_text)
    note = F.concat(
        _strings(F.concat(F.lit("note-"), F.get(names, F.lit(0))), F.concat(F.lit("dur-"), d)),
        F.transform(F.slice(names, F.lit(2), F.greatest(F.size(names) - 1, F.lit(0))),
                    lambda p: F.concat(F.lit("chord-"), p)),
        suffix_tokens(F.col("artics"), F.col("exprs"), F.col("tie")))
    body = F.when(F.col("is_rest"), _strings(F.concat(F.lit("rest-"), d))).otherwise(note)
    before = F.when(F.col("group_pos") == 0, _strings(F.lit("tuplet-3-start"))).otherwise(_strings())
    after = F.when(F.col("group_pos") == 2, _strings(F.lit("tuplet-3-end"))).otherwise(_strings())
    respelled = F.exists("_chord", lambda p: F.coalesce(
        P.respell_pitch(p["midi"], p["name"], p["acc"])["respelled"], F.lit(False)))
    warned = (F.col("broken") | (F.col("group_pos").isNull() & F.col("_s.off"))
              | (~F.col("is_rest") & respelled))
    return df.select("score_id", "part", "measure_idx", "offset", "el_idx",
                     F.concat(before, body, after).alias("toks"), warned.alias("warned"))


def measure_dynamics(dynamics: DataFrame) -> DataFrame:
    """Dynamics at the start of a measure, latest first (each is put in front)."""
    v = F.col("value")
    front = dynamics.filter(F.col("offset") <= 1e-6).select(
        "score_id", "part", "measure_idx",
        F.struct(F.col("offset"), F.col("dyn_idx"),
                 F.concat(F.lit("dynamic-"), lookup(v, DYNAMIC_ALIAS, v)).alias("t")).alias("d"))
    return front.groupBy("score_id", "part", "measure_idx").agg(
        F.transform(F.reverse(F.array_sort(F.collect_list("d"))), lambda x: x["t"]).alias("dyn"))


def measure_tokens(elements: DataFrame, dynamics: DataFrame) -> DataFrame:
    """``(score_id, part, measure_idx, toks, warnings)``: one measure of one part."""
    rows = element_tokens(elements).groupBy("score_id", "part", "measure_idx").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "el_idx", "toks"))),
                              lambda x: x["toks"])).alias("body"),
        F.sum(flag(F.col("warned"))).alias("warnings"))
    keys = ["score_id", "part", "measure_idx"]
    return rows.join(measure_dynamics(dynamics), keys, "left").select(
        *keys, F.concat(F.coalesce("dyn", F.array().cast(EMPTY)), "body").alias("toks"),
        "warnings")


def barline_token(right_bar: Column, is_last: Column) -> Column:
    """N16."""
    return (F.when(is_last, "barline-final").when(right_bar.isNull(), "barline")
            .when(right_bar == "repeat", "barline-end-repeat")
            .when(right_bar.isin("light-light", "double"), "barline-double")
            .when(right_bar.isin("light-heavy", "final"), "barline-final").otherwise("barline"))


def key_name(fifths: Column) -> Column:
    return lookup(fifths, {v: k for k, v in KEY_FIFTHS.items()}, F.lit("C"))


def _header(clef: Column, fifths: Column, time_sig: Column) -> Column:
    return _strings(F.lit("<SOS>"), F.when(clef == "F", "clef-F").otherwise("clef-G"),
                    F.concat(F.lit("key-"), key_name(F.coalesce(fifths, F.lit(0)))),
                    F.concat(F.lit("time-"), F.coalesce(time_sig, F.lit("4/4"))))


def assemble(measures: DataFrame, toks: DataFrame, headers: DataFrame) -> DataFrame:
    """Measures of one or two parts to one token array per score.

    The parts of a measure meet in a conditional aggregation, not in a self-join, and every step
    is clustered by ``score_id``.
    """
    upper, lower = F.col("part") == "treble", F.col("part") == "bass"
    none = F.array().cast(EMPTY)
    full = measures.join(toks, ["score_id", "part", "measure_idx"], "left").withColumn(
        "toks", F.coalesce("toks", none))
    pick = lambda who, c: F.max(F.when(who, F.col(c)))
    per = full.groupBy("score_id", "measure_idx").agg(
        pick(upper, "toks").alias("up"), pick(lower, "toks").alias("low"),
        pick(upper, "right_bar").alias("right_bar"),
        pick(upper, "starts_repeat").alias("starts_repeat"))
    w = Window.partitionBy("score_id")
    per = per.withColumn("n_up", F.count("up").over(w)).withColumn("n_low", F.count("low").over(w))
    grand = F.col("n_low") > 0
    n = F.when(grand, F.least("n_up", "n_low")).otherwise(F.col("n_up"))
    per = per.withColumn("n", n).filter(F.col("measure_idx") < F.col("n"))
    heads = headers.groupBy("score_id").agg(
        pick(lower, "clef").alias("low_clef"), pick(upper, "clef").alias("clef"),
        pick(upper, "fifths").alias("fifths"), pick(upper, "time_sig").alias("time_sig"))
    df = per.join(heads, "score_id")
    clef = F.when(F.col("measure_idx") == 0, _strings(
        F.when(F.col("low_clef") == "F", "clef-F").otherwise("clef-G"))).otherwise(none)
    row = F.concat(
        F.when(F.col("starts_repeat"), _strings(F.lit("barline-start-repeat"))).otherwise(none),
        "up",
        F.when(grand, F.concat(_strings(F.lit("staff-bass")), clef, "low")).otherwise(none),
        _strings(barline_token(F.col("right_bar"), F.col("measure_idx") == F.col("n") - 1)))
    df = df.withColumn("toks", row).groupBy("score_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("measure_idx", "toks"))),
                              lambda x: x["toks"])).alias("body"),
        F.bool_or(grand & (F.col("n_up") != F.col("n_low"))).alias("unequal_parts"),
        F.first("clef").alias("clef"), F.first("fifths").alias("fifths"),
        F.first("time_sig").alias("time_sig"))
    return df.select(
        "score_id", F.concat(_header(F.col("clef"), F.col("fifths"), F.col("time_sig")), "body",
                             F.array(F.lit("<EOS>"))).alias("tokens"),
        (~F.coalesce("time_sig", F.lit("4/4")).isin(*TIMES)).alias("odd_time"), "unequal_parts")


def interleave_parts(measures: DataFrame, toks: DataFrame, headers: DataFrame) -> DataFrame:
    """Two parts as ``upper staff-bass lower barline``; the lower clef appears once; unequal
    measure counts are cut to the shorter part and reported. Scores without a lower part drop out."""
    two = measures.withColumn("_two", F.max(flag(F.col("part") == "bass")).over(
        Window.partitionBy("score_id"))).filter("_two = 1").drop("_two")
    return assemble(two, toks, headers)


def single_part(measures: DataFrame, toks: DataFrame, headers: DataFrame) -> DataFrame:
    """One staff (the ``treble`` part)."""
    return assemble(measures.filter(F.col("part") == "treble"), toks, headers)


def notes_to_tokens(elements: DataFrame, dynamics: DataFrame, measures: DataFrame,
                    headers: DataFrame) -> DataFrame:
    """Scores with a lower part are interleaved, the others written as one staff.

    The inputs are hashed by ``score_id`` once, which serves every later window, join and
    aggregation."""
    toks = measure_tokens(elements.repartition("score_id"), dynamics.repartition("score_id"))
    return assemble(measures.repartition("score_id"), toks, headers)
