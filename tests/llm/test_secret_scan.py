import hashlib
import random
import re

from pyspark.sql import functions as F
from stavemill.llm import secret_scan as S

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute(text):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def texts(rng, n):
    parts = ["password", "Secret", "TOKEN", "api_key", "apiKey", "passwd", '"', "'", " ", "=", ": ", "abcde",
             "abcdef", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "89abcdef", "é", "😀", "\n", "g", "."]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def test_base_against_regular_expressions(spark, docs):
    rows = texts(random.Random(4), 400)
    got = S.scan(docs(rows).select("doc_id", "text")).select("doc_id", S.listed(S.KINDS[:3]).alias("s"),
                                                            F.sha2(S.listed(S.KINDS[:3]), 256).alias("h"))
    want = {i: brute(t) for i, t in rows}
    for r in got.collect():
        assert r.s == want[r.doc_id]
        assert r.h == hashlib.sha256(r.s.encode()).hexdigest()


def test_models_tell_random_from_ordinary(spark, docs):
    rng = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(rng.choice(["tion", "the", "read", "count", "value", "in", "er", "get"])
                           for _ in range(6))
    blob = lambda: "".join(rng.choice(letters) for _ in range(30))
    rows = [(i, f"some {word()} here password={blob()} and {word()}") for i in range(150)]
    rows += [(1000 + i, f"é {blob()} x") for i in range(30)] + [(2000 + i, f"é {word()} x") for i in range(30)]
    rows.append((3000, "card 4785380592391139478538059239 only digits"))
    got = {r.doc_id: r for r in S.scan(docs(rows).select("doc_id", "text")).collect()}
    assert all([(s.start, s.end) for s in got[1000 + i].markov] == [(2, 32)] for i in range(30))
    assert not any(got[2000 + i].markov for i in range(30))
    assert not got[3000].markov
    assert all(len(got[i].assign) == 1 and not got[i].markov for i in range(150))


def test_defined_cases(spark, docs):
    key = "AKIA" + "Z" * 20
    rows = [(1, None), (2, ""), (None, key), (3, key), (3, key), (4, "x " * 100_000 + key)]
    got = S.scan(docs(rows).select("doc_id", "text")).select(
        "doc_id", S.listed(S.KINDS).alias("s")).collect()
    assert sorted((str(r.doc_id), r.s) for r in got) == [
        ("1", ""), ("2", ""), ("3", "access:0:24"), ("3", "access:0:24"),
        ("4", "access:200000:200024"), ("None", "access:0:24")]
    assert S.scan(docs([]).select("doc_id", "text")).count() == 0
