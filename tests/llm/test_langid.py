import math
import random

import numpy as np
from pyspark.sql import functions as F
from stavemill.llm import langid as L

WORDS = {"en": "the and with from this that have was".split(), "fr": "les des une avec pour dans est que".split(),
         "de": "der die und nicht mit ein von zu".split()}


def rows(rng, n, wrong=0.1):
    out = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        said = lang if rng.random() > wrong else rng.choice(list(WORDS))
        out.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(20)), f"{lang}-host{i % 2}", said, lang))
    return out


def frame(spark, data):
    return spark.createDataFrame([r[:4] for r in data], "doc_id long, text string, source string, lang string")


def identified(df):
    return L.identify(df, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.lit(None),
                      F.lit(None))


def test_wrong_declarations_are_outvoted(spark):
    data = rows(random.Random(1), 300)
    got = {r.row.doc_id: r for r in identified(frame(spark, data)).collect()}
    assert sum(got[i].lang == lang for i, _, _, _, lang in data) >= 297
    assert any(got[i].lang != said for i, _, _, said, _ in data)


def test_host_prior_decides_without_text(spark):
    data = rows(random.Random(2), 300, 0) + [(1000, None, "fr-host0", None, "fr"), (1001, " ", "de-host1", None, "de"),
                                             (1002, None, None, "de", "de")]
    got = {r.row.doc_id: r for r in identified(frame(spark, data)).collect()}
    assert [got[i].lang for i in (1000, 1001, 1002)] == ["fr", "de", "de"]
    assert got[1000].text_lang is None and 0 < got[1000].confidence < 1


def test_evidence_of_pages(spark):
    pages = [(1, "https://m.Host.example.fr:80/a?b", '<!DOCTYPE html><html lang="FR-ca"><body><article><p>un deux'),
             (2, "nothing", "<p>x"), (None, None, None)]
    got = {r.page_id: r for r in L.page_evidence(spark.createDataFrame(
        pages, "page_id long, url string, html string")).collect()}
    assert tuple(got[1])[2:] == ("un deux", "fr", "m.host.example.fr", "example.fr", "fr")
    assert tuple(got[2])[2:] == ("x", None, None, None, None)
    assert tuple(got[None])[2:] == ("", None, None, None, None)


def test_defined_cases(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert identified(spark.createDataFrame([], schema)).count() == 0
    none = identified(spark.createDataFrame([(1, "a b", None, None)], schema)).collect()
    assert [(r.lang, r.confidence) for r in none] == [(None, None)]
    data = [(i, "the cat " * 3, "h", "en") for i in range(6)] + [(None, None, None, None), (7, "the " * 50_000, "h", "en"),
                                                                 (7, "the " * 50_000, "h", "en")]
    df = spark.createDataFrame(data, schema).withColumn("score", F.lit(1)).withColumn("row", F.lit(2))
    got = identified(df).collect()
    assert len(got) == 9 and {r.lang for r in got} == {"en"}


def test_rare_languages_are_learned_at_any_size(spark):
    rng = random.Random(3)
    data = [r[:3] + (r[3] if r[0] < 2000 else None, r[4]) for r in rows(rng, 6000, 0)]
    data += [(10_000 + i, " ".join(rng.choice("og ikke det som er til paa av".split()) for _ in range(20)), "h",
              "no", "no") for i in range(6)]
    df = frame(spark, data)
    model = L.train(df.select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("declared")), 300)
    assert model.langs == ["de", "en", "fr", "no"]
    assert model.langs[model.scores("det er ikke til og som").argmax()] == "no"


def test_a_language_of_few_rows_is_kept(spark):
    rng = random.Random(4)
    data = [(i, " ".join(rng.choice(WORDS["en"]) for _ in range(20)), "h", "en", "en") for i in range(50)]
    data += [(100 + i, " ".join(rng.choice(WORDS["fr"]) for _ in range(20)), "h", "fr", "fr") for i in range(4)]
    got = {r.row.doc_id: r for r in identified(frame(spark, data)).collect()}
    assert {i: got[i].lang for i, *_ in data} == {i: lang for i, _, _, _, lang in data}


def test_posterior_against_brute_force(spark):
    rng = random.Random(6)
    schema = "doc_id long, text string, lang string, host string, domain string, suffix string"
    data = [(i, text if i % 7 else None, said if i % 5 else "", f"h{i % 4}.{lang}", lang if i % 3 else None,
             lang if i % 2 else "com") for i, text, _, said, lang in rows(rng, 200)]
    df = spark.createDataFrame(data, schema)
    c = F.col
    got = {r.row.doc_id: r for r in L.identify(df, c("doc_id"), c("text"), c("lang"), c("host"), c("domain"),
                                               c("suffix")).collect()}
    model = L.train(df.select(c("doc_id").alias("id"), "text", F.when(c("lang") != "", c("lang")).alias("declared")))
    k = len(model.langs)
    score = {r[0]: model.scores(r[1]) for r in data}
    best = {i: None if s.max() == s.min() else int(s.argmax()) for i, s in score.items()}

    def table_of(col):
        return {v: [sum(r[col] == v and best[r[0]] == j for r in data) for j in range(k)]
                for v in {r[col] for r in data} - {None, ""}}

    def evidence(col, v):
        seen = table_of(col)
        if not v:
            return np.zeros(k)
        return np.array([math.log((seen[v][j] + 1) / (sum(x[j] for x in seen.values()) + len(seen) + 1)) for j in range(k)])

    def smooth(n, parent):
        return (np.array(n) + L.PRIOR_WEIGHT * parent) / (sum(n) + L.PRIOR_WEIGHT)

    whole = [sum(b == j for b in best.values()) for j in range(k)]
    base = (np.array(whole) + 1) / (sum(whole) + k)
    hosts = table_of(3)
    for i, _, said, host, domain, suffix in data:
        # Hosts keep one of their domains' shares; here every host has rows with and without its domain.
        parents = [smooth([sum(r[4] == d and best[r[0]] == j for r in data) for j in range(k)], base)
                   for d in {r[4] for r in data if r[3] == host}]
        options = []
        for parent in parents:
            total = score[i] + evidence(2, said) + evidence(5, suffix) + np.log(smooth(hosts[host], parent))
            options.append((model.langs[int(total.argmax())], round(float(1 / np.exp(total - total.max()).sum()), 9)))
        assert (got[i].lang, round(got[i].confidence, 9)) in options
