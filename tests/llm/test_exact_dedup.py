import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F
from stavemill.llm import exact_dedup as E

from .conftest import clashing


def hashed(text):
    return hashlib.sha256(text.encode()).hexdigest()


def columns():
    return F.col("doc_id"), F.col("text")


def expected(rows):
    """Brute force over (doc_id, text): sorted (doc_id, keep_id, group_size) and kept rows per text."""
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in by.items()}
    return (sorted(((i, best[t], len(ids)) for t, ids in by.items() for i in ids), key=repr),
            sorted(((best[t], t) for t in by), key=repr))


def test_equals_brute_force_and_hot_texts_are_not_shuffled(spark, docs):
    rng = random.Random(3)
    rows = [(i, "hot" if i % 3 == 0 else f"t{rng.randint(0, 4000)}" if i % 3 == 1 else f"own {i}")
            for i in range(9000)]
    df = docs(rows).repartition(13)
    won = E.winners(E.digests(df, *columns()), 64).collect()
    assert [r.n for r in won if r.digest == hashed("hot")] == [3000]
    got = E.exact_groups(df, *columns(), 64).collect()
    groups, keepers = expected(rows)
    assert sorted(((r.key, r.keep_key, r.group_size) for r in got), key=repr) == groups
    assert sorted(r.key for r in got if r.kept) == sorted(i for i, _ in keepers)
    whole = E.deduplicated(df, *columns(), 64)
    assert sorted(((r.doc_id, r.text) for r in whole.collect()), key=repr) == keepers
    plan = E.exact_groups(df, *columns(), 64)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and plan.count("Window") == 1 and "LeftAnti" in plan


def test_every_frequent_text_is_a_candidate(spark, docs):
    rng = random.Random(5)
    rows = [(i, f"w{int(rng.paretovariate(0.6))}") for i in range(30000)]
    count = defaultdict(int)
    for _, t in rows:
        count[hashed(t)] += 1
    found = {r.digest for r in E.frequent(E.digests(docs(rows).repartition(200), *columns()), 128).collect()}
    assert len(found) <= 128
    assert {d for d, n in count.items() if n > 7 / 256 * len(rows)} <= found


def test_defined_cases(spark, docs):
    assert E.exact_groups(docs([]), *columns()).count() == 0
    assert E.deduplicated(docs([]), *columns()).count() == 0
    long = "x" * 2_000_000
    rows = [(None, None), (None, ""), (None, None), (1, ""), (5, "a"), (5, "a"), (5, "a"), (4, "a"), (None, "n"),
            (None, "n"), (7, long), (6, long), (8, "A"), (9, "é"), (10, "é")]
    df = clashing(docs(rows))
    groups, keepers = expected(rows)
    for tracked in (16, 4096):
        got = E.exact_groups(df, *columns(), tracked).collect()
        assert sorted(((r.key, r.keep_key, r.group_size) for r in got), key=repr) == groups
        assert sorted((r.key for r in got if r.kept), key=repr) == sorted((i for i, _ in keepers), key=repr)
        whole = E.deduplicated(df, *columns(), tracked)
        assert whole.columns == df.columns
        assert sorted(((r.doc_id, r.text or "") for r in whole.collect()), key=repr) == keepers
