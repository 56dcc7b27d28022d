import hashlib
import random
import zlib

import numpy as np
from pyspark.sql import functions as F
from stavemill.llm import merkle as M

from .conftest import DOCS, clashing


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, text, lang, source, n = row
    values = doc_id, source, lang, None if n is None else n + more, text
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels_of(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [h(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def siblings(levels, pos):
    return [(x[(pos >> k) ^ 1], (pos >> k) & 1) if (pos >> k) ^ 1 < len(x) else None
            for k, x in enumerate(levels[:-1])]


def expected(rows):
    """Brute force over documents rows: sorted result rows of op11."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x),
                       key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for x in langs}
    levels = {x: levels_of([leaf(r) for r in trees[x]]) for x in langs}
    top = levels_of([levels[x][-1][0] for x in langs])
    out = []
    for i, x in enumerate(langs):
        for pos, r in enumerate(trees[x]):
            path = siblings(levels[x], pos) + siblings(top, i)
            bad = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            value = leaf(r, 1 if bad else 0)
            for step in path:
                value = h(value) if step is None else h(step[0], value) if step[1] else h(value, step[0])
            root = top[-1][0]
            out.append((r[0], leaf(r), levels[x][-1][0], root, h(*[s[0] for s in path if s]), value, value == root))
    return sorted(out, key=repr)


def result(spark, df, step):
    m = M.manifest(M.document_leaves(df), "doc_id", "hash", "uid", step=step)
    rows = M.proven(m, m.trees.leaves).collect()
    return sorted(((r.doc_id, r.hash, r.subroot, m.root, r.proof_sha256, r.folded_root, r.folded_root == m.root)
                   for r in rows), key=repr)


def test_equals_brute_force_over_many_rounds(spark):
    rng = random.Random(4)
    rows = [(i * 3, f"text {i} é", rng.choice(["en"] * 5 + ["de", "fr", None, ""]), rng.choice(["a", None]), i)
            for i in range(700)] + [(5000 + i, "t", f"l{i:02}", "s", 1) for i in range(23)]
    rng.shuffle(rows)
    want = expected(rows)
    assert 50 < sum(not r[-1] for r in want) < 200
    for step in (2, 3, 12):
        assert result(spark, spark.createDataFrame(rows, DOCS).repartition(9), step) == want


def test_octopus_names_the_fewest_nodes():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randint(1, 40)
        wanted = rng.sample(range(n), rng.randint(1, n))
        got = M.missing(np.array(wanted), n)
        # A node is needed if no requested leaf lies below it, but one lies below its parent.
        need, width, level = [], n, 0
        while width > 1:
            above = {p >> level for p in wanted}
            need += [(level, p) for p in range(width) if p not in above and p ^ 1 in above]
            width, level = (width + 1) // 2, level + 1
        assert sorted(got) == need
        assert len(got) == len(set(got))


def test_proofs_of_some_leaves(spark):
    rows = [(i, f"t{i}", "en" if i % 4 else "de", "s", 1) for i in range(300)]
    m = M.manifest(M.document_leaves(spark.createDataFrame(rows, DOCS)), "doc_id", "hash", "uid", step=3)
    some = m.trees.leaves.where(F.col("doc_id").isin(0, 1, 2, 17, 150, 151, 298))
    got = M.proven(m, some, proofs=True).collect()
    want = {r[0]: r for r in expected(rows)}
    assert sorted(r.doc_id for r in got) == [0, 1, 2, 17, 150, 151, 298]
    for r in got:
        assert (r.proof_sha256, r.folded_root) == want[r.doc_id][4:6]
        assert h(*r.proof) == r.proof_sha256 and all(len(x) == 64 for x in r.proof)
    forged = M.proven(m, some.withColumn("claimed", F.sha2(F.lit("x"), 256))).collect()
    assert all(r.folded_root != m.root for r in forged)


def test_defined_cases(spark):
    assert result(spark, spark.createDataFrame([], DOCS), 12) == []
    one = [(1, "a", "en", "s", 1)]
    assert result(spark, spark.createDataFrame(one, DOCS), 12) == expected(one)
    rows = [(None, None, None, None, None), (None, None, None, None, None), (7, "x" * 500_000, "en", "s", 3),
            (7, "x" * 500_000, "en", "s", 3), (7, "y", "en", "s", None), (8, "", "", "", 0), (None, "n", "en", "s", 1),
            (9, "", None, "-", -1), (-5, "é", "é", "s", 2), (10, "z", "Z", "s", 1), (11, "=", "=", "s", 1)]
    df = clashing(spark.createDataFrame(rows, DOCS)).withColumn("tree", F.lit("x")).withColumn("pos", F.lit(1))
    for step in (1, 12):
        assert result(spark, df, step) == expected(rows)
