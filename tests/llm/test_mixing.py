import math
import random
from collections import defaultdict

import pytest
from stavemill.llm import mixing as M

from .conftest import clashing


def corpus(seed=3, n=400):
    rng = random.Random(seed)
    return [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))),
             rng.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(n)]


def solved(rows, targets):
    """Rates by bisection, one source at a time."""
    out = {}
    for s, t in targets.items():
        sizes = [len((x or "").split()) for _, x, src in rows if src == s]
        total, mean = sum(sizes), sum(sizes) / len(sizes)
        rate = lambda lam: {z: min(M.CAP, math.exp(min(lam * z / mean, 50))) for z in set(sizes)}
        if t >= M.CAP * total:
            out[s] = {z: M.CAP for z in sizes}
            continue
        lo, hi = -1e4, 1e4
        for _ in range(300):
            mid = (lo + hi) / 2
            r = rate(mid)
            lo, hi = (mid, hi) if sum(z * r[z] for z in sizes) < t else (lo, mid)
        out[s] = rate(lo)
    return out


def test_targets_stop_at_the_cap_and_reshare():
    t = M.weighted_targets({"a": 100, "b": 1000, None: 1000})
    assert t["a"] == 200
    assert t["b"] + t[None] == pytest.approx(0 + 3150 - 200)
    assert t[None] == pytest.approx(2 * (3150 - 200) / 3)
    assert M.weighted_targets({}) == {}
    assert M.weighted_targets({"a": 0, "b": 10}) == {"a": 0, "b": 15.0}


def test_rates_and_copies_against_brute_force(spark, docs):
    rows = corpus()
    got = M.mix_documents(docs(rows)).select("row.doc_id", "row.source", "size", "target", "rate",
                                             "copies").collect()
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    targets = M.weighted_targets(sizes)
    rates = solved(rows, targets)
    assert sorted(r.doc_id for r in got) == [i for i, _, _ in rows]
    taken = defaultdict(int)
    for r in got:
        assert r.target == pytest.approx(targets[r.source])
        if r["size"]:
            assert r.rate == pytest.approx(rates[r.source][r["size"]], rel=1e-5)
        assert 0 <= r.copies <= M.CAP
        taken[r.source] += r["size"] * r.copies
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 30
    again = M.mix_documents(docs(rows).repartition(7)).select("row.doc_id", "copies").collect()
    assert {r.doc_id: r.copies for r in got} == {r.doc_id: r.copies for r in again}


def test_defined_cases(spark, docs):
    assert M.mix_documents(docs([])).count() == 0
    rows = [(1, None), (2, ""), (None, "a b c"), (3, "x " * 50_000, None), (3, "x " * 50_000, None)]
    got = M.mix_documents(clashing(docs(rows))).collect()
    assert len(got) == 5
    assert sum(r.copies for r in got if r["size"] == 50_000) in (1, 2, 3)
    assert all(r["size"] == 0 for r in got if not r.row.text)


def test_stage_repeats_documents_and_keeps_columns(spark, docs):
    df = docs(corpus(n=60))
    out = M.pipeline_stage(spark, df, "")
    assert out.columns == df.columns
    copies = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    want = {r.row.doc_id: r.copies for r in M.mix_documents(df).collect() if r.copies}
    assert copies == want
