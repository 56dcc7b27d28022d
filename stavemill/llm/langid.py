"""Language identification by Bayesian fusion of evidence.

The posterior of a row's language adds up log evidence:

* **text**: a naive Bayes model over character trigrams of lower-cased text, with the mean log-likelihood
  of a trigram counted ``TEXT_WEIGHT`` times (trigrams of a text depend on each other, so a long text does
  not count without bound);
* **declared language** (of the markup, or a metadata column) and **address suffix**: how often rows that
  the text model gives a language carry them, smoothed;
* **host prior**: the share of each language on the host, smoothed towards its registered domain, and that
  towards the whole corpus.

Counts of declared languages, suffixes, domains and hosts come from grouped aggregations over all rows; the
text is scored once, in a pandas UDF, and only its scores go on. Hot hosts shrink to counts before the
shuffle; the host table is joined back as a shuffle join whose hot side adaptive execution splits.

Declared languages are counted over all rows, and each is a possible answer. The trigram model is trained on about
``MAX_TRAIN`` rows shared evenly by them (but ``LEAST_TRAIN`` each at least), those with the lowest hashes of id and
text; of a language with fewer rows, on all of them. Every language backs off to the model of all together, so one
with few rows neither attracts what it has not seen nor gets lost.

Defined cases: null or blank text gives no text evidence; missing or empty declarations, suffixes and hosts give
none of theirs; without any evidence the language is the most frequent one; without training rows it is
null; ties go to the first language by name; equal rows give equal rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, register, small, small_batches, staged, table
from .page_text import main_text

MAX_TRAIN = 4000
#: Sampled rows that no language's share of ``MAX_TRAIN`` falls below.
LEAST_TRAIN = 100
TEXT_WEIGHT = 40.0
#: Trigrams kept for the model and pseudo-counts.
MAX_TRIGRAMS, SMOOTHING = 20_000, 0.5
#: Trigrams of the model of all languages together that every language's own are added to.
SHARED = 2000.0
EVIDENCE_SMOOTHING, PRIOR_WEIGHT = 1.0, 10.0


def trigrams(text: str) -> Counter:
    t = " " + " ".join(text.lower().split()) + " "
    return Counter(map("".join, zip(t, t[1:], t[2:]))) if len(t) > 2 else Counter()


class Model:
    """Log-likelihoods of trigrams (last row: any other) by language."""

    def __init__(self, langs: list[str], counts: dict[str, Counter]):
        total = Counter()
        for c in counts.values():
            total.update(c)
        self.langs = langs
        self.place = {g: i for i, (g, _) in enumerate(total.most_common(MAX_TRIGRAMS))}
        self.log = np.empty((len(self.place) + 1, len(langs)))
        shared = np.full(len(self.place) + 1, SMOOTHING)
        for g, k in total.items():
            shared[self.place.get(g, -1)] += k
        shared /= shared.sum()
        for j, lang in enumerate(langs):
            n = SHARED * shared
            for g, k in counts[lang].items():
                n[self.place.get(g, -1)] += k
            self.log[:, j] = np.log(n / n.sum())

    def scores(self, text: str | None) -> np.ndarray:
        """Weighted mean log-likelihood for each language; zeros without text."""
        grams = trigrams(text or "")
        if not grams or not (text or "").strip():
            return np.zeros(len(self.langs))
        at = np.fromiter((self.place.get(g, -1) for g in grams), np.int64, len(grams))
        n = np.fromiter(grams.values(), float, len(grams))
        out = TEXT_WEIGHT * (n @ self.log[at]) / n.sum()
        return out - out.max()


def train(rows: DataFrame, max_train: int = MAX_TRAIN) -> Model | None:
    """``rows`` (id, text, declared). Trigrams of the sample are counted in its tasks."""
    known = rows.where("declared is not null and text is not null")
    totals = {r["declared"]: r["count"] for r in known.groupBy("declared").count().collect()}
    langs = sorted(totals)
    if not langs:
        return None
    bound = max(LEAST_TRAIN, max_train // len(langs))
    below = F.create_map(*[F.lit(x) for lang in langs
                           for x in (lang, int(min(1.0, bound / totals[lang]) * (1 << 30)))])
    sample = known.where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
                         < F.coalesce(F.element_at(below, F.col("declared")), F.lit(0)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, Counter] = {}
        for b in batches:
            for lang, text in zip(b["declared"], b["text"]):
                found.setdefault(lang, Counter()).update(trigrams(text))
        for lang, c in found.items():
            yield pd.DataFrame({"lang": lang, "gram": list(c), "n": list(c.values())})

    sums = (sample.select("declared", "text").mapInPandas(count, "lang string, gram string, n long")
            .groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect())  # of a bounded sample
    sums.sort(key=lambda r: (r["lang"], r["gram"]))  # ties among trigrams fall alike in every run
    counts = {lang: Counter() for lang in langs}
    for r in sums:
        counts[r["lang"]][r["gram"]] = r["n"]
    return Model(langs, counts)


def shares(rows: DataFrame, key: str, langs: list[str]) -> dict:
    """Log P(value of ``key`` given the text's language), for every value; '' stands for unseen."""
    seen = {(r[key], r["best"]): r["count"] for r in
            rows.where(F.col(key).isNotNull()).groupBy(key, "best").count().collect()}
    values = sorted({v for v, _ in seen})
    out = {}
    for v in values + [""]:
        out[v] = [math.log((seen.get((v, j), 0) + EVIDENCE_SMOOTHING)
                           / (sum(seen.get((u, j), 0) for u in values)
                              + EVIDENCE_SMOOTHING * (len(values) + 1))) for j in range(len(langs))]
    return out


def _smoothed(n: Column, parent: Column, k: int) -> Column:
    """Shares of counts, smoothed towards the parent's shares."""
    total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(n, parent, lambda c, p: (c + PRIOR_WEIGHT * p) / (total + PRIOR_WEIGHT))


def identify(docs: DataFrame, ident: Column, text: Column, declared: Column, host: Column,
             domain: Column, suffix: Column) -> DataFrame:
    """Adds to the packed ``row``: lang, confidence, text_lang, evidence (number of kinds used)."""
    small_batches(docs.sparkSession)
    none = F.lit(None).cast("string")
    stated = lambda c: F.when(F.coalesce(c, none) != "", c).otherwise(none)
    rows = packed(docs, id=ident, text=text, declared=stated(declared), host=stated(host), domain=stated(domain),
                  suffix=stated(suffix))
    model = train(rows.select("id", "text", "declared"))
    if model is None:
        return rows.select("row", none.alias("lang"), F.lit(None).cast("double").alias("confidence"),
                           none.alias("text_lang"))
    langs, k = model.langs, len(model.langs)

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([model.scores(t).tolist() for t in s], dtype="object")

    keep = [c for c in docs.columns if c not in ("text", "html")]
    rows = rows.select(F.struct(*[F.col("row")[c].alias(c) for c in keep]).alias("row"), "declared",
                       "host", "domain", "suffix", score("text").alias("score"))
    flat = F.array_max("score") == F.array_min("score")
    best = F.when(flat, None).otherwise(F.array_position("score", F.array_max("score")) - 1)
    rows = staged(rows.withColumn("best", best.cast("int")), "scored")

    said = shares(rows, "declared", langs)
    ends = shares(rows, "suffix", langs)
    # Counts by language of hosts, domains and all rows.
    n = F.array(*[F.count(F.when(F.col("best") == j, 1)).cast("double") for j in range(k)])
    hosts = rows.where("host is not null").groupBy("host", "domain").agg(n.alias("n"))
    hosts = staged(hosts, "hosts")
    add = F.array(*[F.sum(F.col("n")[j]) for j in range(k)])
    whole = rows.agg(n.alias("n")).first()["n"]
    base = [(x + 1) / (sum(whole) + k) for x in whole]
    base_col = F.array(*[F.lit(x) for x in base])
    domains = hosts.groupBy("domain").agg(add.alias("dn")).select(
        F.col("domain").alias("d"), _smoothed(F.col("dn"), base_col, k).alias("parent"))
    priors = (hosts.join(domains, F.col("domain").eqNullSafe(F.col("d")), "left")
              .groupBy("host").agg(F.first("parent").alias("parent"), add.alias("n"))
              .select("host", _smoothed(F.col("n"), F.coalesce("parent", base_col), k).alias("prior")))
    rows = rows.join(small(staged(priors, "priors")), "host", "left")

    def looked_up(key: str, logs: dict) -> Column:
        pairs = spark_map(logs)
        return F.when(F.col(key).isNull(), F.array(*[F.lit(0.0)] * k)).otherwise(
            F.coalesce(F.element_at(pairs, F.col(key)), F.array(*[F.lit(x) for x in logs[""]])))

    def spark_map(logs: dict) -> Column:
        return F.create_map(*[c for v, x in sorted(logs.items()) for c in
                              (F.lit(v), F.array(*[F.lit(y) for y in x]))])

    prior = F.transform(F.coalesce("prior", base_col), lambda p: F.log(p))
    total = F.col("score")
    for part in (looked_up("declared", said), looked_up("suffix", ends), prior):
        total = F.zip_with(total, part, lambda a, b: a + b)
    rows = rows.withColumn("total", total).withColumn("top", F.array_max("total"))
    mass = F.aggregate("total", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    names = F.array(*[F.lit(x) for x in langs])
    return rows.select("row", F.element_at(names, F.array_position("total", F.col("top")).cast("int"))
                       .alias("lang"), (1 / mass).alias("confidence"),
                       F.get(names, F.col("best")).alias("text_lang"))


@register("op10_language_id")
def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Documents: the declared language is the metadata column, the source is the host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = identify(docs, F.col("doc_id"), F.col("text"), F.lower("lang"), F.col("source"),
                     F.lit(None), F.lit(None))
    return found.select("row.doc_id", "lang", F.round("confidence", 6).alias("confidence"), "text_lang",
                        F.lower("row.lang").alias("declared"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with text, declared (markup), host, domain and suffix."""
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(h) for h in s], dtype="object")

    attr = F.regexp_extract("html", r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1)
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    suffix = F.regexp_extract(host, r"([^.]+)$", 1)
    blank = lambda c: F.when(c != "", c)
    return pages.select("page_id", "url", extract("html").alias("text"),
                        blank(F.lower(attr)).alias("declared"), blank(host).alias("host"),
                        blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
                        blank(suffix).alias("suffix"))


@register("language_id_pages")
def language_id_pages(spark, sf_dir: str) -> DataFrame:
    pages = page_evidence(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = identify(pages, F.col("page_id"), F.col("text"), F.col("declared"), F.col("host"),
                     F.col("domain"), F.col("suffix"))
    return found.select("row.page_id", "row.url", "lang",
                        F.round("confidence", 6).alias("confidence"), "text_lang", "row.declared")
