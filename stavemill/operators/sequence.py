"""Measure, voice, header and system structure of token sequences (Q1-Q7, Q14-Q25).

Every window is partitioned by ``score_id`` (plus derived columns), so a hash partitioning on
``score_id`` serves the whole pipeline with a single exchange. A score is one label array, hence
bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions.tokens import (duration_ticks, is_barline, is_chord, is_header, is_note, is_rest)
from .ranges import interval_join


SCORE_KEY = ("score_id",)


def by_score(keys: tuple[str, ...] = SCORE_KEY) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("pos")


def up_to(keys: tuple[str, ...] = SCORE_KEY) -> WindowSpec:
    return by_score(keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(keys: tuple[str, ...] = SCORE_KEY) -> WindowSpec:
    return by_score(keys).rowsBetween(Window.unboundedPreceding, -1)


def whole_score() -> WindowSpec:
    return Window.partitionBy("score_id")


def flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def renumber(df: DataFrame, keys: list[str], order: list[str], name: str = "pos") -> DataFrame:
    """Dense 0-based position per group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1)


def measure_index(tokens: DataFrame, barlines: str = "eval",
                  keys: tuple[str, ...] = SCORE_KEY) -> DataFrame:
    """Q1: a barline belongs to the measure it ends; a trailing open run is a measure.

    ``keys`` names one sequence; it starts with ``score_id``."""
    n = F.sum(flag(is_barline("token", barlines))).over(before(keys))
    return tokens.withColumn("measure_idx", F.coalesce(n, F.lit(0)).cast("int"))


def assign_voice(tokens: DataFrame, barlines: str = "eval",
                 keys: tuple[str, ...] = SCORE_KEY) -> DataFrame:
    """Q2: lower staff from ``staff-bass`` to the end of the measure (barline included)."""
    df = measure_index(tokens, barlines, keys)
    # The measure of the latest staff-bass equals this row's measure exactly on the lower staff.
    last = F.last(F.when(F.col("token") == "staff-bass", F.col("measure_idx")), True).over(
        up_to(keys))
    return df.withColumn("voice", F.when(last == F.col("measure_idx"), "bass")
                         .otherwise("treble"))


def extract_voices(tokens: DataFrame) -> DataFrame:
    """Q3: the two sequences ``(score_id, voice, vpos, token)``; ``staff-bass`` is dropped."""
    df = assign_voice(tokens).filter(F.col("token") != "staff-bass")
    return (renumber(df, ["score_id", "voice"], ["pos"], "vpos")
            .select("score_id", "voice", "vpos", "token"))


def split_header(tokens: DataFrame) -> DataFrame:
    """Q4: adds ``in_header``, true on the leading run of header/special tokens."""
    body = F.max(flag(~is_header("token", specials=True))).over(up_to())
    return tokens.withColumn("in_header", body == 0)


def strip_leading_header(tokens: DataFrame, keys: tuple[str, ...] = ("score_id",)) -> DataFrame:
    """Q5: drops clef (G/F), then key, then time, each only right after the previous one."""
    w = Window.partitionBy(*keys).orderBy("pos")
    t = F.col("token")
    clef = lambda c: c.isin("clef-G", "clef-F")
    key = lambda c: c.startswith("key-")
    rn, lag1, lag2 = F.row_number().over(w), F.lag("token", 1).over(w), F.lag("token", 2).over(w)
    df = tokens.select("*", rn.alias("_rn"), lag1.alias("_l1"), lag2.alias("_l2"))
    dropped = (((F.col("_rn") == 1) & clef(t))
               | ((F.col("_rn") == 2) & key(t) & clef(F.col("_l1")))
               | ((F.col("_rn") == 3) & t.startswith("time-") & key(F.col("_l1"))
                  & clef(F.col("_l2"))))
    kept = df.filter(~F.coalesce(dropped, F.lit(False))).drop("_rn", "_l1", "_l2")
    return renumber(kept, list(keys), ["pos"])


def tuplet_open(tokens: DataFrame, scope: str = "notes") -> DataFrame:
    """Q6: adds ``in_tuplet``. ``notes`` carries across barlines; ``beats`` restarts in every
    measure of a voice (needs ``voice`` and ``measure_idx``)."""
    if scope == "beats":
        w = Window.partitionBy("score_id", "voice", "measure_idx").orderBy("pos")
    else:
        w = by_score()
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mark = F.when(F.col("token").isin("tuplet-3-start", "tuplet-3-end"),
                  F.col("token") == "tuplet-3-start")
    return tokens.withColumn("in_tuplet", F.coalesce(F.last(mark, True).over(w), F.lit(False)))


def scaled_ticks(ticks: Column, in_tuplet: Column) -> Column:
    """Two thirds inside a triplet; whole for every printed duration."""
    return F.floor(ticks * F.when(in_tuplet, 2).otherwise(3) / 3).cast("int")


def measure_beats(tokens: DataFrame, barlines: str = "eval") -> DataFrame:
    """Q7: length of each measure per voice, in ticks. ``closed`` marks a barline."""
    df = tuplet_open(assign_voice(tokens, barlines).filter(F.col("token") != "staff-bass"), "beats")
    ticks = scaled_ticks(duration_ticks("token"), F.col("in_tuplet"))
    return df.groupBy("score_id", "voice", "measure_idx").agg(
        F.coalesce(F.sum(ticks), F.lit(0)).cast("bigint").alias("ticks"),
        F.bool_or(is_barline("token", barlines)).alias("closed"),
        F.sum(flag(F.col("token") == "dur-1/8")).alias("n_eighth"),
        F.sum(flag(F.col("token") == "dur-1/4")).alias("n_quarter"))


def is_grand(tokens: DataFrame) -> DataFrame:
    """``(score_id, is_grand)``."""
    return tokens.groupBy("score_id").agg(
        F.bool_or(F.col("token") == "staff-bass").alias("is_grand"))


# -- splitting a score into systems ------------------------------------------------------------

def _body_measures(tokens: DataFrame) -> DataFrame:
    """Adds ``in_header``, body ``measure_idx`` (dataset barlines), ``total`` and ``hdr_len``."""
    df = measure_index(split_header(tokens), "dataset")
    return df.select("*",
                     (F.max(F.when(~F.col("in_header"), F.col("measure_idx"))).over(whole_score()) + 1)
                     .alias("total"),
                     F.sum(flag(F.col("in_header"))).over(whole_score()).alias("hdr_len"))


def _bounds(n: Column, total: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.floor(i * total / n).cast("int"))


#: Measures of a bin of the range join below; a line holds about as many.
LINE = 4


def system_bounds(n: Column, total: Column, breaks: Column | None) -> Column:
    """The first measure of each of ``n`` systems, then ``total``. Explicit ``breaks`` count only if there are
    exactly ``n - 1`` and all lie inside the score; otherwise systems are even."""
    if breaks is None:
        return _bounds(n, total)
    usable = F.coalesce((F.size(breaks) == n - 1) & F.forall(breaks, lambda x: (x > 0) & (x < total)), F.lit(False))
    return F.when(usable, F.concat(F.array(F.lit(0)), breaks, F.array(total))).otherwise(_bounds(n, total))


def measure_systems(measures: DataFrame, scores: DataFrame) -> DataFrame:
    """``(score_id, measure_idx, system_idx)`` of ``measures(score_id, measure_idx)``; ``scores`` hold
    ``(score_id, total, n_systems, breaks)``. Breaks out of order make ranges that overlap or are empty."""
    n = F.greatest(F.col("n_systems"), F.lit(1))
    ranges = scores.select("score_id", system_bounds(n, F.col("total"), F.col("breaks")).alias("b")).select(
        "score_id", F.posexplode(F.transform(F.slice("b", 1, F.size("b") - 1), lambda x, i: F.struct(
            x.alias("lo"), (F.get(F.col("b"), i + 1) - 1).alias("hi")))).alias("system_idx", "r"))
    met = interval_join(ranges, measures, ["score_id"], F.col("r.lo"), F.col("r.hi"), "measure_idx", LINE)
    return met.select("score_id", "measure_idx", "system_idx")


def split_systems(tokens: DataFrame, n: str = "n_systems", breaks: str | None = "breaks"
                  ) -> DataFrame:
    """Q14 / Q15: distributes measures over ``n`` parts, each repeating the header.

    ``tokens`` carries the part count (and the optional break array) on every row. Break arrays
    are used only when there are exactly ``n - 1`` and all lie inside the score; otherwise the
    parts are even. Parts that would be empty get the whole sequence, as does ``n <= 1``.
    """
    df = _body_measures(tokens)
    nn, total, m = F.greatest(F.col(n), F.lit(1)), F.col("total"), F.col("measure_idx")
    bounds = system_bounds(nn, total, None if breaks is None else F.col(breaks))
    df = df.withColumn("_b", F.when(total.isNotNull(), bounds))
    parts = F.sequence(F.lit(0), nn - 1)
    lo = lambda s: F.get(F.col("_b"), s)
    hi = lambda s: F.get(F.col("_b"), s + 1)
    whole = (nn == 1) | total.isNull()
    own = F.filter(parts, lambda s: whole | F.col("in_header")
                   | ((lo(s) <= m) & (m < hi(s)))
                   | ((F.col("hdr_len") == 0) & (lo(s) >= hi(s))))
    out = df.select("score_id", F.col("pos").alias("_p"), "token",
                    F.explode(own).alias("system_idx"))
    return (renumber(out, ["score_id", "system_idx"], ["_p"])
            .select("score_id", "system_idx", "pos", "token"))


def split_rows(tokens: DataFrame, n: str = "n_rows") -> DataFrame:
    """Q15: single-staff variant, even distribution only."""
    return split_systems(tokens, n, breaks=None)


def split_voice_pairs(tokens: DataFrame, n: str = "n_systems") -> DataFrame:
    """Q16: per system one treble and one bass sequence, each with its own header."""
    df = _body_measures(tokens).filter(F.col("total").isNotNull())
    last_bass = F.last(F.when(F.col("token") == "staff-bass", F.col("measure_idx")), True
                       ).over(up_to())
    bar = is_barline("token", "dataset") & ~F.col("in_header")
    df = df.select("*", bar.alias("is_bar"),
                   F.when(last_bass == F.col("measure_idx"), "bass").otherwise("treble")
                   .alias("voice"))
    df = df.filter(F.col("token") != "staff-bass")
    # A trailing staff-bass with nothing after it is not a measure, so totals are recounted.
    meas = Window.partitionBy("score_id", "measure_idx", "in_header")
    content_bass = ~F.col("is_bar") & ~F.col("in_header") & (F.col("voice") == "bass")
    df = df.select("*",
                   F.max(flag(content_bass)).over(meas).alias("has_bass"),
                   F.max(flag(F.col("is_bar"))).over(meas).alias("has_bar"),
                   (F.row_number().over(meas.orderBy("pos"))
                    == F.count("*").over(meas)).alias("is_last"),
                   (F.max(F.when(~F.col("in_header"), F.col("measure_idx"))).over(whole_score()) + 1)
                   .alias("n_meas")).filter(F.col("n_meas").isNotNull())
    nn, total = F.col(n), F.col("n_meas")
    sys_of = F.floor(((F.col("measure_idx") + 1) * nn - 1) / total).cast("int")
    entry = lambda voice, tok, k: F.struct(F.lit(voice).alias("voice"), tok.alias("token"),
                                           F.lit(k).alias("k"))
    t = F.col("token")
    nothing = F.array().cast("array<struct<voice:string,token:string,k:int>>")
    header = F.array(entry("treble", t, 0),
                     entry("bass", F.when(t == "clef-G", "clef-F").otherwise(t), 0))
    closing = F.when(F.col("has_bass") == 1,
                     F.array(entry("treble", F.lit("barline-final"), 1),
                             entry("bass", F.lit("barline-final"), 1))).otherwise(
        F.array(entry("treble", F.lit("barline-final"), 1)))
    own = F.array(F.struct(F.col("voice"), t.alias("token"), F.lit(0).alias("k")))
    both_bars = F.when(F.col("has_bass") == 1, F.array(entry("treble", t, 0), entry("bass", t, 0))
                       ).otherwise(F.array(entry("treble", t, 0)))
    items = (F.when(F.col("in_header"), header).when(F.col("is_bar"), both_bars)
             .otherwise(F.concat(own, F.when((F.col("has_bar") == 0) & F.col("is_last"), closing)
                                 .otherwise(nothing))))
    systems = F.when(F.col("in_header"), F.sequence(F.lit(0), nn - 1)).otherwise(F.array(sys_of))
    rows = (df.select("score_id", "pos", "measure_idx", "in_header", "is_bar", systems.alias("ss"),
                      items.alias("items"))
            .select("score_id", "pos", "measure_idx", "in_header", "is_bar",
                    F.explode("ss").alias("system_idx"), "items")
            .select("score_id", "pos", "measure_idx", "in_header", "is_bar", "system_idx",
                    F.inline("items")))
    # The system's first bass token repeats the clef of the bass header: drop it.
    bw = Window.partitionBy("score_id", "system_idx", "voice").orderBy("pos", "k")
    seen = F.sum(flag(~F.col("in_header") & ~F.col("is_bar"))).over(
        bw.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_nth", seen)
    duplicate = ((F.col("voice") == "bass") & ~F.col("in_header") & ~F.col("is_bar")
                 & (F.col("_nth") == 1) & (F.col("token") == "clef-F") & (F.col("k") == 0))
    rows = rows.filter(~duplicate)
    rn = F.row_number().over(bw)
    with_sos = F.when((F.col("voice") == "bass") & (rn == 1),
                      F.array(F.lit("<SOS>"), F.col("token"))).otherwise(F.array("token"))
    rows = (rows.withColumn("_t", with_sos)
            .select("score_id", "system_idx", "voice", "pos", "k",
                    F.posexplode("_t").alias("_j", "token")))
    w = Window.partitionBy("score_id", "system_idx", "voice").orderBy("pos", "k", "_j")
    return rows.select("score_id", "system_idx", "voice",
                       (F.row_number().over(w) - 1).alias("pos"), "token")


# -- density and line breaks -------------------------------------------------------------------

def measure_density(tokens: DataFrame) -> DataFrame:
    """Q17: visual weight per measure, the heavier staff counting."""
    weight = F.when(is_note("token") | is_rest("token"), 1.0).when(is_chord("token"), 0.5)
    per_voice = (assign_voice(tokens, "dataset").groupBy("score_id", "measure_idx")
                 .agg(F.coalesce(F.sum(F.when(F.col("voice") == "treble", weight)), F.lit(0.0))
                      .alias("t"),
                      F.coalesce(F.sum(F.when(F.col("voice") == "bass", weight)), F.lit(0.0))
                      .alias("b")))
    return per_voice.select("score_id", "measure_idx", F.greatest("t", "b").alias("weight"))


def density_breaks(density: DataFrame, cap: float = 6.0) -> DataFrame:
    """Q18: greedy line breaks: a measure starts a new line when it would exceed the cap.

    The rule is a true fold (each break resets the sum), so the ordered weights of one score
    are folded in place; a score has few measures.
    """
    weights = F.transform(F.array_sort(F.collect_list(F.struct("measure_idx", "weight"))),
                          lambda x: x["weight"])
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).alias("i"),
                     F.array().cast("array<int>").alias("brk"))

    def step(acc, w):
        new_line = (acc["i"] > 0) & (acc["cum"] + w > cap)
        return F.struct(F.when(new_line, w).otherwise(acc["cum"] + w).alias("cum"),
                        (acc["i"] + 1).alias("i"),
                        F.when(new_line, F.array_append(acc["brk"], acc["i"]))
                        .otherwise(acc["brk"]).alias("brk"))

    return (density.groupBy("score_id").agg(weights.alias("w"))
            .select("score_id", F.aggregate("w", start, step)["brk"].alias("breaks")))


def fixed_breaks(measures: DataFrame, every: int | None = None, n: str = "n_measures") -> DataFrame:
    """Q19: a break before every ``every``-th measure. ``None`` = automatic: up to three
    measures stay on one line, longer scores take two per line."""
    nn = F.col(n)
    k = F.lit(every) if every else F.when(nn <= 3, nn).otherwise(2)
    inner = F.when(nn > 1, F.sequence(F.lit(1), nn - 1)).otherwise(F.array().cast("array<int>"))
    return measures.withColumn("breaks", F.filter(inner, lambda i: i % k == 0))


def join_systems(parts: DataFrame) -> DataFrame:
    """Q20: systems back to one sequence; only the first keeps its header, specials vanish."""
    keys = ("score_id", "system_idx")
    first = parts.filter(F.col("system_idx") == 0)
    rest = strip_leading_header(parts.filter(F.col("system_idx") > 0), keys)
    df = first.select("score_id", "system_idx", "pos", "token").unionByName(
        rest.select("score_id", "system_idx", "pos", "token"))
    df = df.filter(~F.col("token").isin("<SOS>", "<EOS>", "<PAD>"))
    w = Window.partitionBy("score_id").orderBy("system_idx", "pos")
    return df.select("score_id", (F.row_number().over(w) - 1).alias("pos"), "token")


# -- note tables: measures and layout ----------------------------------------------------------


def by_staff() -> WindowSpec:
    return Window.partitionBy("score_id", "staff").orderBy("note_idx")


def staff_up_to() -> WindowSpec:
    return by_staff().rowsBetween(Window.unboundedPreceding, Window.currentRow)


# Layout constants in pixels.
UNIT_W, MARGIN_LEFT, CELL_GAP, MIN_SLOT, ROW_LEFT = 80, 72, 4, 44, 20
MEASURE_PAD, PX_PER_NOTE, FIRST_EXTRA = 46, 42, 60


def split_measures_by_beat(notes: DataFrame) -> DataFrame:
    """Q21: a note on beat 1 opens a measure unless it is the very first of its staff."""
    opens = flag((F.col("beat") == 1) & (F.lag("beat").over(by_staff()).isNotNull()))
    return (notes.withColumn("_o", opens)
            .withColumn("beat_measure", F.sum("_o").over(staff_up_to()).cast("int")).drop("_o"))


def first_measure(notes: DataFrame) -> DataFrame:
    """Q22: notes before the second beat 1."""
    return (notes.withColumn("_n", F.sum(flag(F.col("beat") == 1)).over(staff_up_to()))
            .filter(F.col("_n") < 2).drop("_n"))


def clef_runs(layout: DataFrame) -> DataFrame:
    """Q23: stretches of equal clef inside a measure, with x and width (layout notes)."""
    width = F.greatest(F.col("ticks") * UNIT_W / 24, F.lit(float(MIN_SLOT)))
    part = Window.partitionBy("score_id", "staff", "layout_measure").orderBy("note_idx")
    upto = part.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = layout.withColumn("_m", F.sum(flag(F.col("measure_start"))).over(staff_up_to())) \
        .withColumn("layout_measure", (F.greatest(F.col("_m"), F.lit(1)) - 1).cast("int"))
    prev = F.lag("clef").over(part)
    df = df.select("score_id", "staff", "layout_measure", "note_idx", "clef", width.alias("w"),
                   flag(prev.isNotNull() & (prev != F.col("clef"))).alias("new"))
    df = df.select("*", F.sum("new").over(upto).alias("run_idx"),
                   (F.lit(float(ROW_LEFT)) + F.sum("w").over(upto) - F.col("w")).alias("x"))
    return df.groupBy("score_id", "staff", "layout_measure", "run_idx").agg(
        F.first("clef").alias("clef"), F.min("x").alias("x"), F.sum("w").alias("width"))


def cell_layout(notes: DataFrame, min_width: bool = False) -> DataFrame:
    """Q24: x, width, zone and the chord label (high to low) of every note cell.

    ``min_width`` uses the variant whose slots never get narrower than 44 px.
    """
    slot = F.col("ticks") * UNIT_W / 24
    if min_width:
        slot = F.greatest(slot, F.lit(float(MIN_SLOT)))
    left = ROW_LEFT if min_width else MARGIN_LEFT
    prior = F.sum(slot).over(staff_up_to()) - slot
    clef = F.coalesce("clef", F.col("staff_clef"))
    all_notes = F.array_sort(
        F.transform(F.concat(F.array("pitch"), "chord"),
                    lambda p: F.struct((-P.pitch_to_midi(p)).alias("m"), p.alias("p"))))
    ref = P.pitch_octave("pitch")
    label = F.array_join(F.transform(all_notes, lambda s: F.concat(
        P.note_label(s["p"]),
        F.when(P.pitch_octave(s["p"]) != ref, P.pitch_octave(s["p"]).cast("string"))
        .otherwise(""))), "/")
    return notes.select("score_id", "staff", "note_idx",
                        (prior + left).alias("x"), (slot - CELL_GAP).alias("w"),
                        F.when(F.col("is_rest"), 1).otherwise(P.pitch_zone("pitch", clef))
                        .alias("zone"),
                        F.when(~F.col("is_rest"), label).alias("label"))


def measure_widths(notes: DataFrame) -> DataFrame:
    """Q25: engraved width per measure from its busiest staff (``beat_measure`` required)."""
    per_staff = notes.groupBy("score_id", "beat_measure", "staff").agg(F.count("*").alias("c"))
    return per_staff.groupBy("score_id", "beat_measure").agg(
        (F.max("c") * PX_PER_NOTE + MEASURE_PAD
         + F.when(F.col("beat_measure") == 0, FIRST_EXTRA).otherwise(0)).cast("bigint")
        .alias("width"))
