"""Operators against plain-Python restatements on random sequences."""

import random

import pytest
from pyspark.sql import functions as F

from stavemill.operators import datasets as DS
from stavemill.operators import evaluate as EV
from stavemill.operators import notes as N
from stavemill.operators import repair as R
from stavemill.operators import sequence as S
from stavemill.operators import stats as ST
from tests import models as M
from tests.conftest import sequences, token_table


@pytest.mark.parametrize("leaky", [False, True])
def test_notes_match_the_model(spark, leaky):
    scores = M.random_scores(250, 11)
    got = {}
    for r in N.tokens_to_notes(token_table(spark, scores), compat=leaky).collect():
        got[r.score_id, r.staff, r.note_idx] = (r.measure_idx, r.pitch, r.ticks, r.beat, r.chord,
                                                r.is_rest, r.dynamic, r.repeat, r.tuplet)
    want = {}
    for k, text in scores.items():
        count = {"treble": 0, "bass": 0}
        for n in M.notes(text.split(), leaky):
            want[k, n["staff"], count[n["staff"]]] = (
                n["measure"], n["pitch"], n["ticks"], n["beat"], n["chord"], n["rest"], n["dyn"],
                n["repeat"], n["tuplet"])
            count[n["staff"]] += 1
    assert got == want


def test_span_repair_matches_a_stack_and_is_idempotent(spark):
    scores = M.random_scores(200, 5)
    once = R.drop_unmatched_spans(token_table(spark, scores))
    got = sequences(once)
    for k, text in scores.items():
        toks = text.split()
        keep = M.matched_spans(toks)
        span = [t.rpartition("-")[2] in ("start", "end") and t.rpartition("-")[0] in M.SPANS for t in toks]
        want = [t for i, t in enumerate(toks) if not span[i] or i in keep]
        assert got.get(k, []) == want
    assert sequences(R.drop_unmatched_spans(once)) == got


def test_orphan_repair_is_idempotent(spark):
    once = R.drop_orphan_chords(token_table(spark, M.random_scores(60, 8)))
    assert sequences(R.drop_orphan_chords(once)) == sequences(once)


def test_running_vote_follows_the_prefix(spark):
    scores = {i: "time-4/4 " + t for i, t in M.random_scores(60, 3).items()}
    scores = {i: " ".join(x for x in t.split() if x != "staff-bass" and not x.startswith("tuplet"))
              for i, t in scores.items()}
    got = {(r.score_id, r.measure_idx): r.majority_ticks
           for r in R.running_time_signature(token_table(spark, scores)).collect()}
    bars = {"barline", "barline-final", "barline-start-repeat", "barline-end-repeat"}
    want = {}
    for k, text in scores.items():
        lengths, total = [], 0
        for t in text.split():
            head, _, rest = t.partition("-")
            if head in ("dur", "rest") and "/" in rest:
                total += M.ticks(rest)
            if t in bars:
                lengths.append(total)
                want[k, len(lengths) - 1] = M.vote(lengths)
                total = 0
    assert got == want


def test_density_breaks_match_the_greedy_rule(spark):
    r = random.Random(2)
    rows = [(s, m, r.choice([0.0, 0.5, 1.0, 2.5, 4.0])) for s in range(40) for m in range(r.randint(1, 25))]
    df = spark.createDataFrame(rows, "score_id bigint, measure_idx int, weight double")
    got = {x.score_id: x.breaks for x in S.density_breaks(df, 6.0).collect()}
    for s in range(40):
        assert got[s] == M.line_breaks([w for k, _, w in rows if k == s], 6.0)


def test_token_error_rate_matches_edit_distance(spark):
    truth, pred = M.random_scores(50, 21, 40), M.random_scores(50, 22, 40)
    pred[0] = truth[0]
    df = EV.token_distance(token_table(spark, pred), token_table(spark, truth))
    got = {r.score_id: (r.dist, r.ter) for r in df.collect()}
    assert got[0] == (0, 0.0)
    known = lambda t: t if t != "dur-x" else "<UNK>"
    for k, text in truth.items():
        g, p = [known(t) for t in text.split()], [known(t) for t in pred[k].split()]
        assert got[k][0] == M.distance(p, g)


def test_empty_sides(spark):
    truth = token_table(spark, {1: "note-C4", 2: "note-C4"})
    pred = token_table(spark, {1: "note-C4", 3: "note-D4"})
    ids = spark.createDataFrame([(1,), (2,), (3,)], "score_id bigint")
    rows = EV.stack(pred, truth, ids)
    assert {r.score_id: r.ter for r in EV.measure_ter(rows).collect()} == {1: 0.0, 2: 1.0, 3: 1.0}
    assert [r.score_id for r in EV.measure_ter(EV.stack(pred, truth)).collect()] == [1]


def test_report_counts_failures(spark):
    truth = token_table(spark, {1: "note-C4", 2: "note-C4 dur-1/4", 3: "note-C4"})
    pred = token_table(spark, {1: "note-C4", 2: "note-D4 dur-1/4"})
    pairs = truth.select("score_id").distinct()
    a = EV.analyze_scores(pred, truth)
    overall = lambda **kw: EV.evaluation_report(a, pairs, **kw).filter("level = 'all'").first()
    assert (overall().n_failed, overall().ter, overall().pass_rate) == (1, 0.25, 0.5)
    assert (overall(compat=True).ter, overall(compat=True).pass_rate) == (pytest.approx(1 / 6), pytest.approx(1 / 3))


def test_unknown_spellings_stay_distinct_in_note_errors(spark):
    truth = token_table(spark, {1: "note-E#4 dur-1/4 note-C9 dur-1/4"})
    pred = token_table(spark, {1: "note-C9 dur-1/4 note-C9 dur-1/4"})
    rows = EV.stack(pred, truth)
    assert EV.note_error_rate(rows).first().note_err == 0.25
    assert EV.measure_ter(rows).first().ter == 0.0
    a = EV.analyze_scores(pred, truth).first()
    assert (a.overall_ter, a.note_err, a.error_pos, a.gt_token) == (0.0, 0.25, 0, "note-E#4")


def test_pick_first_is_exact_under_any_partitioning(spark):
    df = spark.range(0, 5000)
    h = DS.hash_of(F.col("id"), 9)
    want = [r.id for r in df.orderBy(h, "id").limit(777).collect()]
    for parts in (1, 7):
        got = DS.pick_first(df.repartition(parts), "id", 9, 777)
        assert sorted(r.id for r in got.collect()) == sorted(want)
    assert DS.pick_first(df, "id", 9, 99999).count() == 5000
    sizes = {r.split: r["count"] for r in DS.split_dataset(df, "id").groupBy("split").count().collect()}
    assert sizes == {"train": 4500, "val": 500}
    assert DS.split_dataset(spark.range(3), "id").filter("split = 'val'").count() == 1


def test_exact_quantiles(spark):
    r = random.Random(4)
    values = [r.randint(0, 50) for _ in range(501)]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    q = ST.exact_quantiles(df, "v", {"half": 0.5, "most": 0.9, "top": 1.0}).first()
    s = sorted(values)
    assert (q.half, q.most, q.top) == (s[250], s[450], s[500])


def test_splits_conserve_measures(spark):
    scores = {i: "clef-G key-C time-4/4 " + t for i, t in M.random_scores(60, 17).items()}
    t = token_table(spark, scores).withColumn("n_systems", (F.col("score_id") % 5 + 1).cast("int"))
    body = ~F.col("token").rlike("^(clef|key|time)-")
    parts = S.split_rows(t, "n_systems")
    count = lambda df: {r.score_id: r["count"] for r in df.filter(body).groupBy("score_id").count().collect()}
    assert count(parts) == count(t)
    joined = sequences(S.join_systems(parts))
    strip = lambda toks: [x for x in toks if x.partition("-")[0] not in ("clef", "key", "time")]
    assert {k: strip(v) for k, v in joined.items()} == {k: strip(v.split()) for k, v in scores.items()}
