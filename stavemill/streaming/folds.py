"""Sessions graded by one fold over their ordered messages.

A session's messages are gathered in one array, ordered by ``seq`` whatever order they arrived in, and
``F.aggregate`` carries a small state along it; no Python runs. A stream keeps only that small state from batch
to batch (``stateful.Grader``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pitch import pitch_to_midi
from . import stateful

WAITED, RIGHT, WRONG, IGNORED = "wait", "hit", "wrong", ""

_STEPS = "array<array<struct<beat:int,pitches:array<string>>>>"
PLANS = {"performance": f"struct<both:boolean,midi:boolean,t:{_STEPS},b:{_STEPS}>",
         "wait": "struct<notes:array<string>>", "quiz": "struct<mode:string,notes:array<string>>"}


def messages_of(rows: DataFrame, mode: str) -> DataFrame:
    """``rows(session_id, seq, kind, pitch, plan, started_at)`` to one row per session: the plan, the
    number of messages and the presses after the start in order."""
    per = rows.groupBy("session_id", "started_at").agg(
        F.collect_list(F.struct("seq", "kind", "pitch")).alias("all"), F.max("plan").alias("plan"),
        F.count("*").alias("seen"), F.min(F.when(F.col("kind") == "start", F.col("seq"))).alias("first"))
    presses = F.array_sort(F.filter("all", lambda m: m["seq"] > F.col("first")))
    return per.select("session_id", "seen", F.from_json("plan", PLANS[mode]).alias("plan"),
                      F.coalesce(presses, F.array().cast("array<struct<seq:bigint,kind:string,"
                                                         "pitch:string>>")).alias("presses"))


def _state(**cols: Column) -> Column:
    return F.struct(*[c.alias(k) for k, c in cols.items()])


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: the folds are interpreted, so an expression that is used
    twice would be evaluated twice, and what it uses four times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _marks(s: Column, mark: Column, marked: bool) -> Column:
    """The marks so far as one text, each followed by a comma: an array would be copied for every message."""
    return F.concat(s["marks"], mark, F.lit(",")) if marked else s["marks"]


def _zero() -> Column:
    return F.lit(0).cast("bigint")


def _none() -> Column:
    return F.array().cast("array<string>")


def _steps(measures: Column) -> Column:
    """One hand's steps in a row, each with its measure and highest tone; equal tones count once."""
    def one(step, m):
        tones = F.array_distinct(step["pitches"])
        high = F.array_max(F.transform(tones, lambda p: F.struct(pitch_to_midi(p), p.alias("p"))))["p"]
        return _state(measure=m, beat=step["beat"], tones=tones, high=high)

    return F.flatten(F.transform(F.coalesce(measures, F.array().cast(_STEPS)),
                                 lambda steps, m: F.transform(steps, lambda s: one(s, m))))


def performance(plan: Column, presses: Column, marked: bool = True) -> Column:
    """R3. The state is the next step of each hand, the held keys and the totals. What a press may
    complete is one array: both hands' tones if their next steps start together, else those of the hand
    that needs the key, the right one first."""
    start = _state(r=F.lit(0), l=F.lit(0), held=_none(), right=_zero(), wrong=_zero(), marks=F.lit(""))
    right, left = F.col("rights"), F.col("lefts")

    def press(s, x):
        return _let(_state(a=F.get(right, s["r"]), b=F.get(left, s["l"])), lambda due: _let(
            offered(due["a"], due["b"]), lambda o: _let(wanted(s, x, due, o), lambda w: _let(
                verdict(x, due, o, w), lambda v: after(s, o, w, v)))))

    def offered(a, b):
        now = F.least(a["measure"], b["measure"])  # an empty or finished hand does not hold the other
        return _state(mine=F.when(a["measure"] == now, a["tones"]).otherwise(_none()),
                      other=F.when(b["measure"] == now, b["tones"]).otherwise(_none()),
                      together=F.coalesce((a["measure"] == b["measure"]) & (a["beat"] == b["beat"]), F.lit(False)))

    def wanted(s, x, due, o):
        first = ~o["together"] & F.array_contains(o["mine"], x["pitch"])
        second = ~o["together"] & ~F.array_contains(o["mine"], x["pitch"]) & F.array_contains(o["other"], x["pitch"])
        return _state(first=first, second=second, held=F.array_union(s["held"], F.array(x["pitch"])),
                      want=F.when(o["together"], F.concat(o["mine"], o["other"])).when(first, o["mine"]).when(
                          second, o["other"]).otherwise(_none()))

    def verdict(x, due, o, w):
        touch = ~plan["midi"] & ~o["together"] & (F.size(w["want"]) > 1)
        high = F.when(w["first"], due["a"]["high"]).otherwise(due["b"]["high"])
        ready = F.when(touch, x["pitch"] == high).otherwise(F.size(F.array_except(w["want"], w["held"])) == 0)
        return _let(~F.array_contains(w["want"], x["pitch"]), lambda wrong: _state(wrong=wrong, hit=~wrong & ready))

    def after(s, o, w, v):
        mark = F.when(v["wrong"], WRONG).when(v["hit"], RIGHT).otherwise(WAITED)
        return _state(r=s["r"] + (v["hit"] & (o["together"] | w["first"])).cast("int"),
                      l=s["l"] + (v["hit"] & (o["together"] | w["second"])).cast("int"), held=w["held"],
                      right=s["right"] + F.when(v["hit"], F.size(w["want"])).otherwise(0),
                      wrong=s["wrong"] + v["wrong"].cast("int"), marks=_marks(s, mark, marked))

    def step(s, x):
        over = (s["r"] >= F.size(right)) & (s["l"] >= F.size(left))
        off = F.array_remove(s["held"], x["pitch"])
        skip = _state(r=s["r"], l=s["l"], held=F.when(x["kind"] == "off", off).otherwise(s["held"]),
                      right=s["right"], wrong=s["wrong"], marks=_marks(s, F.lit(IGNORED), marked))
        return F.when((x["kind"] == "off") | over, skip).otherwise(press(s, x))

    return F.aggregate(presses, start, step, lambda s: _state(
        right=s["right"], wrong=s["wrong"], marks=s["marks"],
        done=(s["r"] >= F.size(right)) & (s["l"] >= F.size(left)) & (F.size(right) + F.size(left) > 0)))


def wait(plan: Column, presses: Column, marked: bool = True) -> Column:
    """Only the expected pitch advances; anything else is a wrong mark."""
    start = _state(i=F.lit(0), wrong=_zero(), marks=F.lit(""))

    def step(s, x):
        live = (x["kind"] == "on") & (s["i"] < F.size(plan["notes"]))
        hit = live & (x["pitch"] == F.get(plan["notes"], s["i"]))
        mark = F.when(hit, RIGHT).when(live, WRONG).otherwise(IGNORED)
        return _state(i=s["i"] + hit.cast("int"), wrong=s["wrong"] + (live & ~hit).cast("int"),
                      marks=_marks(s, mark, marked))

    return F.aggregate(presses, start, step, lambda s: _state(
        right=s["i"].cast("bigint"), wrong=s["wrong"], marks=s["marks"],
        done=s["i"] >= F.size(plan["notes"])))


def quiz(plan: Column, presses: Column, marked: bool = True) -> Column:
    """One note, a chord in any order (a wrong key empties it), or a sequence (a wrong key does
    not set it back)."""
    start = _state(got=_none(), right=_zero(), wrong=_zero(), done=F.lit(False), marks=F.lit(""))
    chord = plan["mode"] == "chord"
    length = F.when(plan["mode"] == "note", 1).otherwise(F.size(plan["notes"]))

    def step(s, x):
        live = (x["kind"] == "on") & ~s["done"]
        due = F.get(plan["notes"], F.when(plan["mode"] == "sequence", F.size(s["got"])).otherwise(0))
        hit = live & F.when(chord, F.array_contains(plan["notes"], x["pitch"])).otherwise(
            x["pitch"] == due)
        got = F.when(hit, F.concat(s["got"], F.array(x["pitch"]))).when(live & chord, _none()).otherwise(
            s["got"])
        full = F.when(chord, F.size(F.array_except(plan["notes"], got)) == 0).otherwise(
            F.size(got) >= length)
        mark = F.when(hit, RIGHT).when(live, WRONG).otherwise(IGNORED)
        return _state(got=got, right=s["right"] + hit.cast("int"),
                      wrong=s["wrong"] + (live & ~hit).cast("int"), done=s["done"] | (hit & full),
                      marks=_marks(s, mark, marked))

    return F.aggregate(presses, start, step, lambda s: _state(
        right=s["right"], wrong=s["wrong"], marks=s["marks"], done=s["done"]))


FOLDS = {"performance": performance, "wait": wait, "quiz": quiz}


def _folded(rows: DataFrame, mode: str, marked: bool) -> DataFrame:
    """Every session with its fold in ``g``; its marks are kept only if they are asked for."""
    df = messages_of(rows, mode)
    if mode == "performance":
        df = df.withColumn("rights", _steps(F.col("plan.t"))).withColumn("lefts", F.when(
            F.col("plan.both"), _steps(F.col("plan.b"))).otherwise(_steps(F.lit(None).cast(_STEPS))))
    return df.withColumn("g", FOLDS[mode](F.col("plan"), F.col("presses"), marked))


def _totals() -> list:
    return ["session_id", "seen", F.col("g.right").alias("correct"), F.col("g.wrong").alias("wrong"),
            F.col("g.done").alias("done")]


def graded(rows: DataFrame, mode: str) -> DataFrame:
    """``(session_id, seen, correct, wrong, done, presses)``; ``presses`` are (seq, pitch, mark) of the
    keys that went down, with the mark hit, wrong or wait (the rest of its step is missing)."""
    marked = F.filter(F.zip_with("presses", F.split("g.marks", ","), lambda x, m: F.struct(
        x["seq"].alias("seq"), x["pitch"].alias("pitch"), m.alias("mark"))), lambda x: x["mark"] != IGNORED)
    return _folded(rows, mode, True).select(*_totals(), marked.alias("presses"))


def grades(rows: DataFrame, mode: str) -> DataFrame:
    """Totals of each session; as a stream (update mode) the totals so far, with the messages that came late."""
    if rows.isStreaming:
        return stateful.grades_stream(rows, mode)
    return _folded(rows, mode, False).select(*_totals())


def press_marks(rows: DataFrame, mode: str = "performance") -> DataFrame:
    """Every press against the step expected at that moment."""
    # The outer form: for the other Spark would test the array's size first, and fold twice.
    return graded(rows, mode).select("session_id", F.inline_outer("presses")).where("mark is not null")


def latest_results(results: DataFrame) -> DataFrame:
    """Final totals of each session from the emitted updates."""
    return results.groupBy("session_id").agg(F.max(
        F.struct("seen", "correct", "wrong", "done")).alias("r")).select("session_id", "r.*")
