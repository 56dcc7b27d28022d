import random

import numpy as np
from stavemill.llm import quality as Q

from .conftest import clashing


def brute_repeats(words):
    wins = {}
    for i in range(len(words) - 7):
        wins.setdefault(tuple(words[i:i + 8]), []).append(i)
    return len({i + k for at in wins.values() if len(at) > 1 for i in at for k in range(8)})


def test_base_figures_against_brute_force():
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice(["a", "b", "é#", " ", "\n", "\t", " ", "$|", "a b a b a b a b a\n"])
                       for _ in range(rng.randint(0, 150)))
        words = Q._WORD.findall(text)
        n, chars, symbols, dup, rep, failed, _, kept = Q.judge(text, None)
        lines = [x for x in text.split("\n") if Q._WORD.search(x)]
        assert (n, chars) == (len(words), sum(map(len, words)))
        assert symbols == sum(c in "#*$%&|<>" for c in text)
        assert dup == sum(x in lines[:i] for i, x in enumerate(lines))
        assert rep == brute_repeats(words)
        assert failed == (n < 20 or 100 * rep > 30 * n)
        assert kept == (not failed)


def test_viterbi_and_sums_against_all_paths():
    rng = np.random.default_rng(0)
    for t in (1, 2, 5):
        score, jump = rng.normal(size=t), rng.normal(size=(2, 2))
        paths = {p: sum(score[i] * p[i] for i in range(t))
                 + sum(jump[p[i], p[i + 1]] for i in range(t - 1)) for p in np.ndindex(*[2] * t)}
        assert tuple(Q.viterbi(score, jump)) == max(paths, key=paths.get)
        unary = np.stack([np.zeros(t), score], -1)[None]
        alpha, beta = Q._path_sums(unary, jump, np.ones((1, t), bool))
        z = np.log(sum(np.exp(v) for v in paths.values()))
        assert np.isclose(np.logaddexp(*alpha[0, -1]), z)
        for i in range(t):
            on = np.log(sum(np.exp(v) for p, v in paths.items() if p[i]))
            assert np.isclose(alpha[0, i, 1] + beta[0, i, 1], on)


def labelled(rng, n):
    clean = "The river runs past the old mill and the road turns north there."
    junk = "BUY!! NOW!! $$$ CLICK!! *** HERE!! ### FREE!! %%% WIN!! &&&"
    rows, labels = [], []
    for i in range(n):
        good = i % 3 > 0
        body = [" ".join(rng.sample((clean if good else junk).split(), 10)) for _ in range(4)]
        rows.append((i, "\n".join(body)))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark, docs):
    rng = random.Random(1)
    rows, labels = labelled(rng, 90)
    model = Q.fit(docs(rows), spark.createDataFrame(labels, "doc_id long, quality int"))
    test, truth = labelled(rng, 60)
    got = {r.row.doc_id: r.q.kept for r in Q.judged(docs(test), model).collect()}
    assert sum(got[i] == bool(q) for i, q in truth) == 60


def test_defined_cases(spark, docs, folder):
    rows = [(1, None), (2, ""), (None, "word " * 30), (3, "a b c d e f g h i j " * 20_000),
            (4, " ".join(map(str, range(40)))), (4, " ".join(map(str, range(40))))]
    labels = spark.createDataFrame([(None, 1), (1, None), (9, 0)], "doc_id long, quality int")
    df = clashing(docs(rows))
    sf = folder(labels=labels)
    out = Q.pipeline_stage(spark, df, sf)
    assert out.columns == df.columns
    assert [r.doc_id for r in out.collect()] == [4, 4]
    assert Q.pipeline_stage(spark, docs([]), sf).count() == 0
