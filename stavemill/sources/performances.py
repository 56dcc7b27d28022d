"""Performance sessions derived from scores: a plan row, then key presses with mistakes.

A session plays one score, so its size is bounded by the score's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.notes import tokens_to_notes
from ..operators.practice import performance_steps
from .fixtures import tokens

MESSAGE_SCHEMA = ("session_id bigint, seq bigint, kind string, pitch string, plan string, "
                  "started_at timestamp")


def started(rows: DataFrame) -> DataFrame:
    """Sessions start a second apart; every message carries its session's start."""
    return rows.withColumn("started_at", F.timestamp_millis((F.col("session_id") + 1) * 1000))


def steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps with the hands in use: sessions without a confirmed keyboard play one hand."""
    st = performance_steps(tokens_to_notes(tokens(spark, sf_dir)))
    st = st.withColumn("midi", F.col("score_id") % 4 != 3)
    return st.filter(F.col("midi") | (F.col("staff") == "treble"))


def performance_plans(steps: DataFrame) -> DataFrame:
    """``(session_id, plan, t, b)``: steps per measure and hand, also as JSON; gaps are empty
    measures."""
    per_measure = steps.groupBy("score_id", "midi", "staff", "measure").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("step", "beat", "pitches"))),
                    lambda s: F.struct(s["beat"].alias("beat"), s["pitches"].alias("pitches")))
        .alias("steps"))
    hand = lambda v: F.map_from_entries(F.collect_list(
        F.when(F.col("staff") == v, F.struct("measure", "steps"))))
    per = per_measure.groupBy("score_id", "midi").agg(
        hand("treble").alias("t"), hand("bass").alias("b"), F.max("measure").alias("last"))
    none = F.array().cast("array<struct<beat:int,pitches:array<string>>>")
    filled = lambda m: F.transform(F.sequence(F.lit(0), F.col("last").cast("int")),
                                   lambda i: F.coalesce(F.element_at(m, i), none))
    both = F.size("b") > 0
    plan = F.to_json(F.struct(both.alias("both"), F.col("midi"), filled("t").alias("t"),
                              F.when(both, filled("b")).otherwise(
                                  F.array().cast("array<array<struct<beat:int,pitches:array<string>>>>"))
                              .alias("b")))
    return per.select(F.col("score_id").alias("session_id"), plan.alias("plan"),
                      filled("t").alias("t"), F.when(both, filled("b")).alias("b"))


def _order(rows: DataFrame, *order: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(*order)
    return rows.withColumn("seq", F.row_number().over(w).cast("bigint"))


def performance_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(session_id, seq, kind, pitch, plan)``: all tones of a step go down, then up. Some steps
    get a wrong key first, some tones of some sessions are missed."""
    plans = performance_plans(steps_of(spark, sf_dir))
    item = lambda m, i, staff, p: F.struct(m.alias("measure"), i.alias("step"), F.lit(staff).alias("staff"),
                                           p.alias("pitches"))
    hand = lambda c, staff: F.flatten(F.transform(F.col(c), lambda steps, m: F.transform(
        steps, lambda s, i: item(m, i, staff, s["pitches"]))))
    kind = "array<struct<measure:int,step:int,staff:string,pitches:array<string>>>"
    start = F.array(item(F.lit(-1), F.lit(0), "start", F.array().cast("array<string>"))).cast(kind)
    steps = F.concat(start, hand("t", "treble").cast(kind),
                     F.coalesce(hand("b", "bass").cast(kind), F.array().cast(kind)))
    rows = plans.select("session_id", "plan", F.inline(steps))
    # One pass: the plan row explodes into its own start message and its tones.
    tones = rows.select("session_id", F.when(F.col("measure") < 0, F.col("plan")).alias("plan"),
                        "measure", "step", "staff", F.posexplode_outer("pitches").alias("tone", "pitch"))
    code = (F.col("measure") * 31 + F.col("step") * 7 + F.col("tone") * 3 + F.col("session_id")) % 37
    tones = tones.withColumn("code", F.coalesce(code, F.lit(-1))).filter(
        ~((F.col("session_id") % 5 == 4) & (F.col("code") == 3)))
    act = lambda phase, kind, pitch: F.struct(F.lit(phase).alias("phase"), F.lit(kind).alias("kind"),
                                              pitch.alias("pitch"))
    none = F.array().cast("array<struct<phase:int,kind:string,pitch:string>>")
    wrong = F.when(F.col("code") == 5, F.array(act(0, "on", F.lit("C1")), act(1, "off", F.lit("C1"))))
    played = F.concat(wrong.otherwise(none), F.array(act(2, "on", F.col("pitch")),
                                                     act(3, "off", F.col("pitch"))))
    acts = F.when(F.col("measure") < 0, F.array(act(0, "start", F.lit(None).cast("string")))).otherwise(
        played)
    rows = tones.select("session_id", "plan", "measure", "step", "staff", "tone", F.inline(acts))
    rows = _order(rows, "measure", "step", "phase", F.desc("staff"), "tone")
    return started(rows.select("session_id", "seq", "kind", "pitch", "plan"))


def _upper_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tokens_to_notes(tokens(spark, sf_dir))
    return n.filter((F.col("staff") == "treble") & ~F.col("is_rest")).select(
        F.col("score_id").alias("session_id"), "note_idx", "pitch")


def _with_wrong_keys(notes: DataFrame) -> DataFrame:
    wrong = (F.col("note_idx") * 7 + F.col("session_id")) % 11 == 4
    keys = F.when(wrong, F.array(F.lit("C1"), F.col("pitch"))).otherwise(F.array("pitch"))
    rows = notes.select("session_id", "note_idx", F.posexplode(keys).alias("j", "pitch"))
    return _order(rows, "note_idx", "j").select("session_id", "seq", F.lit("on").alias("kind"), "pitch",
                                                F.lit(None).cast("string").alias("plan"))


def _with_plans(rows: DataFrame, plans: DataFrame) -> DataFrame:
    start = plans.select("session_id", F.lit(0).cast("bigint").alias("seq"),
                         F.lit("start").alias("kind"), F.lit(None).cast("string").alias("pitch"), "plan")
    return started(rows.unionByName(start))


def wait_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wait mode: the upper staff's notes in order, with wrong keys in between."""
    n = _upper_notes(spark, sf_dir)
    pitches = F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "pitch"))),
                          lambda x: x["pitch"])
    plans = n.groupBy("session_id").agg(pitches.alias("notes")).select(
        "session_id", F.to_json(F.struct("notes")).alias("plan"))
    return _with_plans(_with_wrong_keys(n), plans)


def quiz_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quizzes of three notes each through the whole upper staff, as one note, a chord or a sequence;
    presses follow the score."""
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("note_idx")) - 1
    n = _upper_notes(spark, sf_dir).withColumn("quiz", F.floor(place / 3)).select(
        (F.col("session_id") * 10000 + F.col("quiz")).alias("session_id"), "note_idx", "pitch")
    pitches = F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "pitch"))),
                          lambda x: x["pitch"])
    mode = F.when(F.col("session_id") % 3 == 0, "note").when(
        F.col("session_id") % 3 == 1, "chord").otherwise("sequence")
    plans = n.groupBy("session_id").agg(pitches.alias("notes")).select(
        "session_id", F.to_json(F.struct(mode.alias("mode"), "notes")).alias("plan"))
    return _with_plans(_with_wrong_keys(n), plans)
