"""Corpus statistics and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions.tokens import is_note, is_rest, key_accidental, suffix
from ..functions.vocab import literal_dim, vocab_dim
from .notes import note_events
from .sequence import assign_voice, flag, whole_score

MAX_INTERVAL = 14
# Audit limits in semitones and chord sizes.
MELODIC_CAP, DENSE_CAP, CHORD_SPAN, CHORD_SIZES = 12, 11, 12, (2, 3)
EIGHTH, SIXTEENTH, RUN_LENGTH = 12, 6, 4
# Target weights of keys, times and durations.
KEY_WEIGHTS = {"C": 0.20, "G": 0.14, "F": 0.14, "D": 0.10, "Bb": 0.10, "A": 0.07, "Eb": 0.07,
               "E": 0.05, "Ab": 0.05, "B": 0.03, "Db": 0.03, "F#": 0.01, "Gb": 0.01}
TIME_WEIGHTS = {"4/4": 0.35, "3/4": 0.30, "2/4": 0.20, "6/8": 0.15}
DURATION_WEIGHTS = {"1/1": 0.04, "3/4": 0.02, "1/2": 0.16, "3/8": 0.015, "1/4": 0.55, "1/8": 0.15,
                    "1/16": 0.08, "3/16": 0.005}
TARGETS = {"key": KEY_WEIGHTS, "time": TIME_WEIGHTS, "dur": DURATION_WEIGHTS}
# Chord-degree transition weights; each row sums to 1.
DEGREE_TRANSITIONS = {
    1: {1: 0.10, 4: 0.25, 5: 0.25, 6: 0.25, 2: 0.15},
    2: {5: 0.50, 4: 0.20, 1: 0.10, 7: 0.20},
    3: {6: 0.40, 4: 0.30, 1: 0.30},
    4: {5: 0.35, 1: 0.30, 2: 0.15, 6: 0.20},
    5: {1: 0.45, 6: 0.25, 4: 0.15, 5: 0.15},
    6: {4: 0.30, 2: 0.25, 5: 0.25, 1: 0.20},
    7: {1: 0.60, 5: 0.20, 3: 0.20},
}
# The span tokens that get a loss weight.
WEIGHTED_SPANS = ("ottava-8va-start", "ottava-8va-end", "ottava-8vb-start", "ottava-8vb-end",
                  "hairpin-cresc-start", "hairpin-cresc-end", "hairpin-dim-start",
                  "hairpin-dim-end")


def melodic_intervals(tokens: DataFrame, max_interval: int = MAX_INTERVAL) -> DataFrame:
    """Diatonic step from the previous note of the same voice; a rest breaks the line, a barline
    does not. ``interval`` is NULL without a predecessor."""
    df = assign_voice(tokens).filter(is_note("token") | is_rest("token"))
    w = Window.partitionBy("score_id", "voice").orderBy("pos")
    step = F.when(is_note("token"), P.diatonic_step(suffix("token", "note-")))
    df = df.withColumn("step", step).withColumn("prev", F.lag("step").over(w))
    clamped = F.greatest(F.lit(-max_interval), F.least(F.lit(max_interval),
                                                       F.col("step") - F.col("prev")))
    return df.filter(is_note("token")).select("score_id", "pos", "voice",
                                              clamped.alias("interval"))


def markov_transitions(tokens: DataFrame, max_interval: int = MAX_INTERVAL) -> DataFrame:
    """``(interval, n, prob)``; at most ``2 * max_interval + 1`` rows."""
    n = (melodic_intervals(tokens, max_interval).filter("interval IS NOT NULL")
         .groupBy("interval").agg(F.count("*").alias("n")))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # over the few interval rows only
    return n.withColumn("prob", F.col("n") / total)


def markov_log_prob(tokens: DataFrame, table: DataFrame, max_interval: int = MAX_INTERVAL
                    ) -> DataFrame:
    """Adds ``log_prob`` per note; intervals absent from the table use its minimum. The table
    has a fixed maximum size, so it is broadcast."""
    floor = F.min("prob").over(Window.partitionBy(F.lit(0)))
    domain = tokens.sparkSession.range(-max_interval, max_interval + 1).select(
        F.col("id").cast("int").alias("interval"))
    table = table.filter(F.abs("interval") <= max_interval)
    full = domain.join(F.broadcast(table.select("interval", "prob")), "interval", "left")
    lp = full.withColumn("log_prob", F.ln(F.coalesce("prob", floor))).select("interval", "log_prob")
    return melodic_intervals(tokens, max_interval).join(F.broadcast(lp), "interval", "left")


def score_plausibility(log_probs: DataFrame) -> DataFrame:
    """Per-score sum and mean of the note log probabilities."""
    return log_probs.groupBy("score_id").agg(
        F.coalesce(F.sum("log_prob"), F.lit(0.0)).alias("log_prob"),
        F.count("log_prob").alias("n_scored"))


def distribution_audit(tokens: DataFrame, kind: str) -> DataFrame:
    """Observed share of each value against its target weight (full join on a fixed dim)."""
    seen = tokens.filter(F.col("token").startswith(f"{kind}-")).groupBy(
        suffix("token", f"{kind}-").alias("value")).agg(F.count("*").alias("n"))
    dim = literal_dim(tokens.sparkSession, ["value", "target"], list(TARGETS[kind].items()))
    df = seen.join(dim, "value", "full").withColumn("n", F.coalesce("n", F.lit(0))).withColumn(
        "target", F.coalesce("target", F.lit(0.0)))
    share = F.col("n") / seen.agg(F.sum("n")).scalar()
    return df.select(F.lit(kind).alias("kind"), "value", "n", share.alias("share"), "target",
                     F.abs(share - F.col("target")).alias("gap"))


def interval_cap_audit(tokens: DataFrame) -> DataFrame:
    """Melodic leaps above an octave, or above 11 semitones between two short notes. A rest
    ends the short run but keeps the previous pitch."""
    ev = note_events(tokens)
    w = Window.partitionBy("score_id", "voice").orderBy("event_idx")
    midi = F.when(~F.col("is_rest"), P.pitch_to_midi("pitch"))
    df = ev.select("score_id", "voice", "event_idx", "pos", "is_rest", "ticks", midi.alias("midi"))
    df = df.select("*",
                   F.last("midi", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
                   .alias("prev_midi"),
                   F.when(~F.lag("is_rest").over(w), F.lag("ticks").over(w)).alias("prev_ticks"))
    dense = F.coalesce((F.col("prev_ticks") <= EIGHTH) & (F.col("ticks") <= EIGHTH), F.lit(False))
    cap = F.when(dense, DENSE_CAP).otherwise(MELODIC_CAP)
    leap = F.abs(F.col("midi") - F.col("prev_midi"))
    return df.filter(leap > cap).select("score_id", "pos", "voice", leap.alias("leap"),
                                        cap.alias("cap"))


def chord_audit(tokens: DataFrame) -> DataFrame:
    """Per chord its size, distinct pitches, span, and whether each rule holds."""
    ev = note_events(tokens).filter(F.size("chord") > 0)
    root = suffix("head", "note-")
    tones = F.concat(F.array(root), F.col("chord"))
    midis = F.filter(F.transform(tones, P.midi_of), lambda m: m.isNotNull())
    df = ev.select("score_id", "pos", F.size(tones).alias("size"), midis.alias("m"),
                   F.size("chord").alias("_c"))
    span = F.array_max("m") - F.array_min("m")
    return df.select("score_id", "pos", "size", span.alias("span"),
                     (F.size(F.array_distinct("m")) == F.size("m")).alias("distinct_ok"),
                     (span <= CHORD_SPAN).alias("span_ok"),
                     F.col("size").between(*CHORD_SIZES).alias("size_ok"))


def chord_degrees(tokens: DataFrame) -> DataFrame:
    """How often each degree above the root occurs."""
    ev = note_events(tokens).filter(F.size("chord") > 0)
    return ev.select(suffix("head", "note-").alias("root"), F.explode("chord").alias("tone")).groupBy(
        P.interval_degree("root", "tone").cast("int").alias("degree")).agg(F.count("*").alias("n"))


def score_key(tokens: DataFrame) -> DataFrame:
    """Adds the name of the score's first key signature."""
    first = F.min(F.when(F.col("token").startswith("key-"), F.struct("pos", "token"))).over(
        whole_score())
    return tokens.withColumn("key", suffix(first["token"], "key-"))


def diatonic_share(tokens: DataFrame) -> DataFrame:
    """Share of notes spelled inside the key's major scale, per key."""
    name = P.pitch_name(suffix("token", "note-"))
    letter = F.left(name, F.lit(1))
    inside = name == F.concat(letter, F.coalesce(key_accidental("key", letter), F.lit("")))
    return (score_key(tokens).filter(is_note("token") & F.col("key").isNotNull())
            .groupBy("key").agg(F.count("*").alias("n_notes"), F.avg(flag(inside)).alias("share")))


def run_audit(tokens: DataFrame) -> DataFrame:
    """Longest stretches of at least four eighths or sixteenths inside one measure."""
    ev = note_events(tokens)
    w = Window.partitionBy("score_id", "voice", "measure_idx").orderBy("event_idx")
    kind = F.when(~F.col("is_rest") & F.col("ticks").isin(EIGHTH, SIXTEENTH), F.col("ticks"))
    df = ev.select("score_id", "voice", "measure_idx", "event_idx", "pos", kind.alias("kind"))
    new = flag(~F.lag("kind").over(w).eqNullSafe(F.col("kind")))
    df = df.withColumn("_n", new).withColumn("run", F.sum("_n").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = df.filter("kind IS NOT NULL").groupBy("score_id", "voice", "measure_idx", "run").agg(
        F.min("pos").alias("start_pos"), F.first("kind").alias("ticks"),
        F.count("*").alias("length"))
    return runs.filter(F.col("length") >= RUN_LENGTH).drop("run")


def degree_transition_dim(spark: SparkSession) -> DataFrame:
    """``(degree, next_degree, weight, row_sum)``."""
    rows = [(a, b, w) for a, r in DEGREE_TRANSITIONS.items() for b, w in r.items()]
    dim = literal_dim(spark, ["degree", "next_degree", "weight"], rows)
    return dim.withColumn("row_sum", F.sum("weight").over(Window.partitionBy("degree")))


def degree_transitions(tokens: DataFrame) -> DataFrame:
    """Observed degree moves between the first upper notes of consecutive measures, beside
    the expected weight (0 where the table has none)."""
    df = assign_voice(score_key(tokens)).filter(
        is_note("token") & (F.col("voice") == "treble") & F.col("key").isNotNull())
    first = df.groupBy("score_id", "measure_idx").agg(
        F.min_by("token", "pos").alias("token"), F.first("key").alias("key"))
    deg = P.interval_degree("key", suffix("token", "note-")).cast("int")
    w = Window.partitionBy("score_id").orderBy("measure_idx")
    moves = first.withColumn("degree", deg).withColumn("next_degree", F.lead("degree").over(w))
    n = moves.filter("next_degree IS NOT NULL").groupBy("degree", "next_degree").agg(
        F.count("*").alias("n"))
    return n.join(F.broadcast(degree_transition_dim(tokens.sparkSession)),
                  ["degree", "next_degree"], "left").select(
        "degree", "next_degree", "n", F.coalesce("weight", F.lit(0.0)).alias("weight"))


BUCKET = 4096  # values whose counts are summed up in one task


def token_frequency(tokens: DataFrame, span_weight: float = 1.0) -> DataFrame:
    """Count and loss weight per token."""
    weight = F.when(F.col("token").isin(*WEIGHTED_SPANS), span_weight).otherwise(1.0)
    return tokens.groupBy("token").agg(F.count("*").alias("n")).withColumn("weight", weight)


def value_counts(values: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """``(keys, v, c, n, cum)``: count of each distinct integer, the total, and the cumulative
    count. Values are counted map-side; sums run over buckets of ``BUCKET`` values, then within each
    bucket, so no task holds all distinct values."""
    counts = values.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(
        F.count("*").alias("c")).withColumn("_b", F.floor(F.col("v") / BUCKET))
    one = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = one.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy(*keys, "_b").agg(F.sum("c").alias("_c")).select(
        *keys, "_b", F.sum("_c").over(one).alias("n"),
        F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("v").rowsBetween(Window.unboundedPreceding,
                                                                      Window.currentRow)
    return counts.join(buckets, [*keys, "_b"]).select(
        *keys, "v", "c", "n", (F.col("_before") + F.sum("c").over(inside)).alias("cum"))


def quantile(p: float, when: Column | None = None) -> Column:
    """Smallest value whose cumulative count reaches the share ``p`` (over ``value_counts``)."""
    reached = F.col("cum") >= F.ceil(F.col("n") * p)
    return F.min(F.when(reached if when is None else reached & when, F.col("v")))


def exact_quantiles(values: DataFrame, value: str, probs: dict[str, float]) -> DataFrame:
    """Exact order statistics without a global sort."""
    return value_counts(values, value).agg(*[quantile(p).alias(name) for name, p in probs.items()])


def length_profile(labels: DataFrame, long_decode: int = 150, max_seq: int = 608) -> DataFrame:
    """Sequence-length distribution of label arrays and the shares above the limits, all from
    one table of length counts."""
    lens = value_counts(labels.select(F.size("tokens").alias("len")), "len")
    above = lambda limit: F.sum(F.when(F.col("v") > limit, F.col("c")).otherwise(0)) / F.sum("c")
    return lens.agg(
        F.sum("c").alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean_len"),
        above(long_decode).alias("long_share"), above(300).alias("over_300"),
        above(max_seq).alias("over_max"), quantile(0.5).alias("p50"), quantile(0.9).alias("p90"),
        quantile(0.99).alias("p99"), quantile(1.0).alias("longest"))


def vocab_coverage(tokens: DataFrame) -> DataFrame:
    """Share of unknown tokens per score and their list."""
    dim = vocab_dim(tokens.sparkSession).select("token", F.lit(True).alias("known"))
    df = tokens.join(F.broadcast(dim), "token", "left")
    unknown = F.col("known").isNull()
    return df.groupBy("score_id").agg(
        F.count("*").alias("n_tokens"), F.sum(flag(unknown)).alias("n_unknown"),
        F.array_sort(F.collect_set(F.when(unknown, F.col("token")))).alias("unknown")).withColumn(
        "unknown_share", F.col("n_unknown") / F.col("n_tokens"))


def job_last_status(events: DataFrame, status: Column) -> DataFrame:
    """Each job's latest event (an aggregate, so a busy job is reduced map-side)."""
    return events.withColumn("status", status).groupBy("job_id").agg(
        F.max(F.struct("ts", "event_id", "status", "delay_ms", "exec_ms")).alias("e")).select(
        "job_id", "e.status", "e.delay_ms", "e.exec_ms")


def job_stats(last: DataFrame) -> DataFrame:
    """Failure share and exact delay / execution percentiles over jobs. The three measures are
    counted in one pass, as (metric, value) rows."""
    metric = lambda name, v: F.struct(F.lit(name).alias("metric"), v.cast("bigint").alias("value"))
    rows = last.select(F.inline(F.array(
        metric("failed", (F.col("status") == "FAILED").cast("int")),
        metric("delay", F.col("delay_ms")), metric("exec", F.col("exec_ms")))))
    counts = value_counts(rows, "value", ("metric",))
    of = lambda name: F.col("metric") == name
    n_jobs = F.sum(F.when(of("failed"), F.col("c")))
    return counts.agg(
        n_jobs.alias("n_jobs"),
        (F.sum(F.when(of("failed"), F.col("v") * F.col("c"))) / n_jobs).alias("failure_share"),
        quantile(0.5, of("delay")).alias("delay_p50"), quantile(0.95, of("delay")).alias("delay_p95"),
        quantile(0.5, of("exec")).alias("exec_p50"), quantile(0.95, of("exec")).alias("exec_p95"))


#: KLL size: ranks are within about ``1 / 150`` of the exact ones, however many values and merges.
KLL_K, KLL_ERROR = 400, 1 / 150


def quantile_sketches(values: DataFrame, value: str, *parts: str) -> DataFrame:
    """E20 / E22 in a form that can be stored and merged: ``(parts, n, sketch)``, a KLL sketch of a few kilobytes
    for every part; parts that come later are merged without reading the earlier rows."""
    return values.where(F.col(value).isNotNull()).groupBy(*parts).agg(
        F.count("*").alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(KLL_K)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probs: dict[str, float], *keys: str) -> DataFrame:
    """``(keys, n, one column for each quantile)`` of all parts of a key together; nothing for no rows."""
    merged = sketches.groupBy(*(keys or [F.lit("all").alias("_all")])).agg(
        F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", F.lit(KLL_K)).alias("sketch"))
    return merged.select(*keys, "n", *[F.kll_sketch_get_quantile_bigint("sketch", F.lit(p)).alias(name)
                                       for name, p in probs.items()])


def rank_errors(values: DataFrame, value: str, quantiles: DataFrame, probs: dict[str, float]) -> DataFrame:
    """``(name, p, error)``: how far the rank of each sketched quantile (one row of them) lies from ``p``."""
    counts = value_counts(values, value).crossJoin(F.broadcast(quantiles.limit(1).drop("n")))
    least = lambda name: F.coalesce(F.sum(F.when(F.col("v") < F.col(name), F.col("c"))), F.lit(0)) / F.max("n")
    most = lambda name: F.coalesce(F.sum(F.when(F.col("v") <= F.col(name), F.col("c"))), F.lit(0)) / F.max("n")
    rows = [F.struct(F.lit(name).alias("name"), F.lit(p).alias("p"), F.greatest(
        F.lit(0.0), least(name) - p, F.lit(p) - most(name)).alias("error")) for name, p in probs.items()]
    return counts.agg(F.array(*rows).alias("r")).select(F.inline("r"))
