"""Interval joins on bins."""

import random

import pytest
from pyspark.sql import functions as F

from stavemill.operators import sequence as S
from stavemill.operators.ranges import interval_join
from stavemill.plans.registry import QUERIES
from stavemill.streaming import sessions as SS

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("how", ["inner", "left"])
def test_equals_all_pairs(spark, how):
    rng = random.Random(2)
    intervals = [(rng.randint(0, 2), i, lo := rng.randint(-50, 50), lo + rng.randint(-3, 30)) for i in range(80)]
    points = [(rng.randint(0, 2), j, rng.randint(-60, 60)) for j in range(300)] + [(None, 999, 0)]
    a = spark.createDataFrame(intervals + [(None, 998, 0, 1), (0, 997, None, 1)], "k int, i int, lo int, hi int")
    b = spark.createDataFrame(points, "k int, j int, x int")
    want = {(i, j) for k, i, lo, hi in intervals for m, j, x in points if k == m and lo <= x <= hi}
    for width in (1, 7, 1000):
        got = [(r.i, r.j) for r in interval_join(a, b, ["k"], F.col("lo"), F.col("hi"), "x", width, how).collect()]
        pairs = [p for p in got if p[1] is not None]
        assert len(pairs) == len(set(pairs)) and set(pairs) == want
        assert {i for i, _ in got} == ({i for i, _ in want} if how == "inner" else {i for _, i, _, _ in intervals}
                                       | {997, 998})


def test_explicit_breaks_come_first(spark):
    scores = [(1, 10, 3, [4, 9]), (2, 10, 3, [4]), (3, 10, 2, [10]), (4, 7, 2, None), (5, 10, 3, [9, 4]), (6, 3, 0, []),
              (7, 2, 5, None)]
    s = spark.createDataFrame(scores, "score_id bigint, total int, n_systems int, breaks array<int>")
    m = spark.createDataFrame([(k, i) for k, total, _, _ in scores for i in range(total)],
                              "score_id bigint, measure_idx int")
    got = {}
    for r in S.measure_systems(m, s).collect():
        got.setdefault((r.score_id, r.system_idx), []).append(r.measure_idx)
    want = {}
    for k, total, n, breaks in scores:
        n = max(n, 1)
        ok = breaks is not None and len(breaks) == n - 1 and all(0 < b < total for b in breaks)
        bounds = [0, *breaks, total] if ok else [i * total // n for i in range(n + 1)]
        for i in range(n):
            if bounds[i] < bounds[i + 1]:
                want[k, i] = list(range(bounds[i], bounds[i + 1]))
    assert {k: sorted(v) for k, v in got.items()} == want


def test_no_nested_loops_and_the_bin_is_a_key(spark):
    for name in ("j10_system_ranges", "r06_connection_check", "j09_target_heard"):
        text = plan(QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text, name
        keys = [line for line in text.splitlines() if "Join [" in line]
        assert keys and all("_bin#" in line for line in keys), name


def test_one_long_session_is_many_tasks(spark):
    presses = spark.range(400_000).select(F.lit(1).cast("bigint").alias("session_id"), (F.col("id") * 50).alias("t_ms"),
                                          F.lit("on").alias("kind"), F.lit("C3").alias("pitch"))
    checks = spark.createDataFrame([(1, 1000, "C3"), (1, 9_000_000, "G3"), (1, -9000, "C3")],
                                   "session_id bigint, check_ms bigint, target string")
    got = {(r.check_ms, r.ok, r.n_heard) for r in SS.connection_check(checks, presses).collect()}
    assert got == {(1000, True, 121), (9_000_000, False, 121), (-9000, False, 0)}
    bins = presses.repartition(8, "session_id", F.floor(F.col("t_ms") / SS.CHECK_MS)).groupBy(
        F.spark_partition_id().alias("p")).count().collect()
    assert len(bins) == 8 and max(r["count"] for r in bins) < 100_000


def test_shares_of_a_weights_table(spark):
    from stavemill.operators import datasets as DS
    weights = {"a": {"x": 1, "y": 3, "z": 0}, "b": {"x": 5.5, "w": 4.5}, "one": {"q": 2}, "many": {
        f"c{i:03}": 1 + i % 3 for i in range(500)}}
    table = [(g, c, float(w)) for g, ws in weights.items() for c, w in ws.items()] + [("none", "x", -1.0), ("b", "v", None)]
    groups = ["a", "a", "a", "b", "one", "many", "none", None]
    rows = [(i, groups[i % 8], "t") for i in range(16_000)]
    df = spark.createDataFrame(rows, "id bigint, g string, name string")
    w = spark.createDataFrame(table, "g string, pick string, weight double")
    got = DS.weighted_pick_by(df, "id", "g", w, "pick")
    assert got.columns == ["id", "g", "name", "pick"]
    found = got.groupBy("g", "pick").count().collect()
    assert sum(r["count"] for r in found) == 16_000
    assert {r.pick for r in found if r.g in (None, "none")} == {None}
    for g, ws in weights.items():
        n, total = sum(r["count"] for r in found if r.g == g), sum(ws.values())
        counts = {r.pick: r["count"] for r in found if r.g == g}
        assert set(counts) <= {c for c, x in ws.items() if x > 0} and n == 2000 * groups.count(g)
        for c, x in ws.items():
            p = x / total
            assert abs(counts.get(c, 0) - n * p) <= 4 * (n * p * (1 - p)) ** 0.5 + 1, (g, c)
    again = DS.weighted_pick_by(df.repartition(3), "id", "g", w, "pick")
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
