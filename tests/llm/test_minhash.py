import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from stavemill.llm import minhash as M

from .conftest import clashing


def bag(text):
    w = (text or "").encode().split()
    k = min(5, len(w))
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute_classes(rows):
    """Smallest id of the component of equal texts and weighted Jaccard >= 0.8."""
    ids = [i for i, _ in rows]
    bags = [bag(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = bags[a], bags[b]
            both = sum((x & y).values())
            equal = rows[a][1] is not None and rows[a][1] == rows[b][1]
            if equal or (both and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both)):
                ra, rb = top(a), top(b)
                up[max(ra, rb)] = min(ra, rb)
    first = {}
    for a in range(len(rows)):
        first[top(a)] = min(first.get(top(a), 1 << 60), ids[a])
    return {ids[a]: first[top(a)] for a in range(len(rows))}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return " ".join(out)


def corpus(rng):
    rows = []
    vocab = [f"w{i}" for i in range(300)]
    for _ in range(12):  # groups of near copies around the threshold
        base = [rng.choice(vocab) for _ in range(rng.randint(40, 150))]
        rows += [edited(rng, base, rng.randint(0, 5)) for _ in range(rng.randint(1, 8))]
    base = [rng.choice(vocab) for _ in range(170)]  # a large group, most pairs below the threshold
    rows += [edited(rng, base, rng.randint(2, 7)) for _ in range(90)]
    passage = " ".join(rng.choice(vocab) for _ in range(60))
    rows += [passage + " " + " ".join(rng.choice(vocab) for _ in range(40)) for _ in range(40)]
    rows += ["a b", "a b", "a  b", "", "", "z z z z z z z z z z z z", "z z z z z z z z z z z z z"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_classes_against_brute_force(spark, docs):
    for seed in (1, 2):
        rows = corpus(random.Random(seed))
        got = M.near_duplicates(docs(rows).select(F.col("doc_id").alias("id"), "text"))
        assert {r.id: r["class"] for r in got.collect()} == brute_classes(rows)


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    errors = []
    for _ in range(80):
        e = np.unique(rng.integers(0, 2**63, 150).astype(np.uint64))
        a = rng.integers(1, 20, len(e))
        b = np.maximum(0, a + rng.integers(-6, 7, len(e)))
        s = M.signatures([(e, a), (e[b > 0], b[b > 0])], 256)
        errors.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.01
    assert np.isinf(M.signatures([(np.empty(0, np.uint64), np.empty(0, np.int64))])).all()


def test_prefix_filter_proposes_every_pair(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    rows = [(i, edited(rng, base, rng.randint(0, 3))) for i in range(40)]
    texts = spark.createDataFrame(rows, "node long, text string")
    nodes = texts.select("node", F.col("node").alias("class"))
    seen = {}
    for r in M.rare_tokens(nodes, texts).collect():
        seen.setdefault(r.node, {})[r.token] = r.rank
    for a, ta in rows:
        for b, tb in rows[:a]:
            x, y = bag(ta), bag(tb)
            both = sum((x & y).values())
            if ta != tb and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                assert set(seen[a]) & set(seen[b])


def test_components(spark):
    rng = random.Random(0)
    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(7, i) for i in range(8, 60)]
    links = chain + star + [(200, 300), (300, 250), (250, 200)]
    rng.shuffle(links)
    got = {r.node: r["class"] for r in M.components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    want = ({i: 100 for i in range(101, 141)} | {i: 7 for i in range(8, 60)} | {250: 200, 300: 200})
    assert got == want


def test_defined_cases(spark, docs):
    rows = [(1, None), (2, None), (3, ""), (4, ""), (None, "q r s"), (5, "q r s"), (None, "only here"),
            (6, "t " * 30_000), (6, "t " * 30_000), (7, "t " * 30_000 + "u")]
    df = clashing(docs(rows))
    out = M.pipeline_stage(spark, df, "")
    assert out.columns == df.columns
    kept = sorted(((r.doc_id if r.doc_id is not None else -1), (r.text or "")[:9])
                  for r in out.collect())
    assert kept == [(-1, "only here"), (1, ""), (2, ""), (3, ""), (5, "q r s"), (6, "t t t t t")]
    assert M.pipeline_stage(spark, docs([]), "").count() == 0


def test_ids_do_not_decide_what_is_compared(spark, docs):
    words = [f"w{i}" for i in range(80)]
    text, near = " ".join(words), " ".join(words[:-2] + ["x", "y"])
    far, far_near = " ".join(f"v{i}" for i in range(70)), " ".join(f"v{i}" for i in range(71))
    # Near copies under null ids, and two unlike texts under one id, each with a near copy.
    rows = [(None, text), (None, near), (5, far), (5, "quite another text of a few words"), (3, far_near)]
    out = M.pipeline_stage(spark, docs(rows), "").collect()
    assert sorted(((r.doc_id or -1), r.text[:3]) for r in out) in (
        [(-1, "w0 "), (3, "v0 "), (5, "qui")],)
    got = {(r.id, r.text[:2]): r["class"] for r in M.near_duplicates(docs(rows).select(
        F.col("doc_id").alias("id"), "text")).join(docs(rows).select(F.md5("text").alias("digest"), "text"), "digest").collect()}
    assert got[5, "v0"] == 3 and got[5, "qu"] == 5 and got[None, "w0"] is None


def test_large_buckets_are_cut_and_the_prefix_proposes_once(spark, docs):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, base, rng.randint(0, 4))) for i in range(540)]
    got = M.near_duplicates(docs(rows).select(F.col("doc_id").alias("id"), "text"))
    assert {r.id: r["class"] for r in got.collect()} == brute_classes(rows)


def test_components_that_do_not_end_are_an_error(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(500)], "a long, b long")
    with pytest.raises(RuntimeError):
        M.components(links, rounds=2)
