import math
import random

import numpy as np
from pyspark.sql import functions as F
from stavemill.llm import hard_negatives as H

from .conftest import clashing

SCHEMA = "vec_id long, label int, vector array<float>"


def key(i):
    return (i is None, i or 0)


def expected(rows, every=10, k=5):
    """Brute force over (vec_id, label, vector)."""
    q = []
    for i, label, v in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q.append((i, label, tuple(max(-H.LIMIT, min(H.LIMIT, math.floor(256 * float(np.float32(x))))) for x in v)))
    q = list(dict.fromkeys(q))
    out = []
    for i, label, v in q:
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), key(j), j, m) for j, m, w in q if j != i]
        scored.sort(key=lambda x: x[:2])
        for p, _, j, m in [x for x in scored if x[3] == label][:k]:
            negatives = [x for x in scored if x[3] != label and 80 * -p <= 100 * -x[0] <= 100 * -p][:k]
            out += [(i, j, r + 1, x[2], -p, -x[0]) for r, x in enumerate(negatives)]
    return sorted(out, key=repr)


def mined(df, **sizes):
    return sorted((tuple(r) for r in H.hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes).collect()), key=repr)


def vectors(rng, n, dims, labels, spread):
    centre = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    for i in range(n):
        label = rng.randrange(labels)
        yield i, label, [c * 0.2 + rng.gauss(0, spread) for c in centre[label]]


def test_equals_brute_force_over_many_blocks(spark):
    rng = random.Random(7)
    rows = list(vectors(rng, 700, 12, 4, 0.2))
    rows += [(700 + i, i % 4, rows[3][2]) for i in range(60)]  # copies: ties everywhere
    df = spark.createDataFrame(rows, SCHEMA)
    want = expected(rows)
    assert len(want) > 500
    assert mined(df, block_rows=90, part_rows=30) == want
    assert mined(df.repartition(7)) == want


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    for size in (40.0, 100_000.0, 1e9):
        rows = [(i, i % 2, [rng.uniform(-size, size) for _ in range(6)]) for i in range(80)]
        assert mined(spark.createDataFrame(rows, SCHEMA), block_rows=25) == expected(rows)


def test_reading_stops_early_and_strictly():
    rng = np.random.default_rng(1)
    matrix = np.abs(rng.normal(size=(4000, 3)) * 50).round()
    lists = H.Lists(np.arange(4000), np.zeros(4000), matrix)
    reads = []

    class Counted(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, np.ndarray):
                reads.append(len(at))
            return super().__getitem__(at)

    lists.matrix = matrix.view(Counted)
    (rows, scores), = lists.search(np.array([9.0, 1.0, 0.0]), -1, None, np.array([-1e9]), np.array([1e9]), 5)
    exact = matrix @ np.array([9.0, 1.0, 0.0])
    best = sorted(range(4000), key=lambda r: (-exact[r], r))[:5]
    assert list(rows) == best and list(scores) == [exact[r] for r in best]
    assert sum(reads) < 1000
    # All scores equal: the threshold never lies strictly below, so ids decide among all rows.
    flat = H.Lists(np.arange(500), np.zeros(500), np.ones((500, 2)))
    (rows, _), = flat.search(np.array([1.0, 1.0]), 0, None, np.array([-1e9]), np.array([1e9]), 3)
    assert list(rows) == [1, 2, 3]


def test_defined_cases(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9]), (3, 2, [0.9, 0.4]),
            (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]),
            (8, 2, [None, 1.0]), (None, 2, [0.9, 0.4]), (None, 1, [0.8, 0.3]), (10, 2, []), (20, 3, [0.0, 0.0]),
            (30, 3, [0.0, 0.0]), (0, 2, [0.7, 0.7]), (40, 2, [-0.5, -0.5]), (41, 2, [0.4, 0.4]), (9, 3, [0.1])]
    df = spark.createDataFrame(rows, SCHEMA)
    for more in (df, clashing(df).withColumn("score", F.lit("x")).withColumn("anchor", F.lit("x"))):
        assert mined(more, block_rows=4) == expected(rows)
