"""Quality rules: base rules on words, then line labelling by a linear-chain conditional random field.

Every line that has a word is described by ``FEATURES``; a chain with the states content and boilerplate
scores lines and neighbouring pairs, Viterbi decoding marks each line, and a document is kept when at
least ``MIN_SHARE`` of its words lie in content lines and the base rules pass.

The field is trained on labelled documents (a line takes the label of its document) by gradient ascent
on the conditional likelihood, with forward-backward sums. Training reads a sample of at most
``MAX_LABELLED`` documents of each label, those with the lowest hashes of their id; everything else
covers all rows. Decoding is a pandas UDF over the text alone: rows never leave the JVM, one batch of
texts is in memory at a time, and a lost task is simply run again.

Defined cases: a null or blank text has no words, fails the base rules and is not kept; without labels of
both kinds every line counts as content; rows whose label or id is null do not train; equal rows get
equal results; long texts are read whole.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, register, small_batches, table

MAX_LABELLED = 1500
MIN_SHARE = 0.5
SYMBOLS = "#*$%&|<>"
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
FEATURES = ("one", "symbols a word", "words with capitals only", "exclamation marks a word",
            "distinct share", "letters a word", "long words", "few words", "seen before", "no stop",
            "digits a word", "words of symbols only", "same as word before", "any symbol")
VERDICT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
           "base_failed boolean, content_words long, kept boolean")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_DIGITS = re.compile(r"[0-9]")


def repeat_words(words: list) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    sums = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        sums = sums * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n] + np.uint64(1)
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    if not same.any():
        return 0
    # Equal sums only nominate; the windows themselves are compared.
    named = order[np.r_[same, False] | np.r_[False, same]]
    wins = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[named]
    _, inverse, counts = np.unique(wins, axis=0, return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = named[counts[inverse.ravel()] > 1]
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def read_lines(text: str) -> tuple[list[list[str]], list[bool]]:
    """The words of every line that has some, and whether an equal line came before."""
    lines, again, seen = [], [], set()
    for line in text.split("\n"):
        words = _WORD.findall(line)
        if words:
            lines.append(words)
            again.append(line in seen)
            seen.add(line)
    return lines, again


def line_features(lines: list[list[str]], again: list[bool]) -> np.ndarray:
    out = np.empty((len(lines), len(FEATURES)), np.float64)
    for i, words in enumerate(lines):
        n = len(words)
        body = "".join(words)
        symbols = sum(map(body.count, SYMBOLS))
        bare = sum(map(words.count, SYMBOLS)) if symbols else 0
        out[i] = (1.0, min(2.0, symbols / n), sum(map(str.isupper, words)) / n,
                  min(2.0, body.count("!") / n), len(set(words)) / n, min(2.0, len(body) / n / 10),
                  sum(len(w) > 14 for w in words) / n, n < 4, again[i],
                  body[-1] not in ".!?…", min(2.0, len(_DIGITS.findall(body)) / n),
                  bare / n, sum(map(operator.eq, words, words[1:])) / n, symbols > 0)
    return out


def _path_sums(unary: np.ndarray, jump: np.ndarray, mask: np.ndarray):
    """Forward and backward log sums of padded chains. unary: docs x lines x 2, state 1 is content."""
    d, t, _ = unary.shape
    alpha, beta = np.empty_like(unary), np.zeros_like(unary)
    alpha[:, 0] = unary[:, 0]
    for i in range(1, t):
        new = np.logaddexp(alpha[:, i - 1, None, 0] + jump[0], alpha[:, i - 1, None, 1] + jump[1])
        alpha[:, i] = np.where(mask[:, i, None], new + unary[:, i], alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        ahead = unary[:, i + 1] + beta[:, i + 1]
        new = np.logaddexp(jump[None, :, 0] + ahead[:, None, 0], jump[None, :, 1] + ahead[:, None, 1])
        beta[:, i] = np.where(mask[:, i + 1, None], new, 0.0)
    return alpha, beta


def train(chains: list[np.ndarray], labels: list[np.ndarray], steps: int = 200,
          decay: float = 1e-4, at_once: int = 200) -> dict:
    """Weights of a field for chains of line features and their line labels."""
    order = np.argsort([len(c) for c in chains], kind="stable")
    groups = []
    for start in range(0, len(order), at_once):  # chains of like length are padded together
        own = [int(i) for i in order[start:start + at_once]]
        longest = max(len(chains[i]) for i in own)
        x = np.zeros((len(own), longest, len(FEATURES)))
        y = np.full((len(own), longest), -1)
        for k, i in enumerate(own):
            x[k, :len(chains[i])], y[k, :len(chains[i])] = chains[i], labels[i]
        groups.append((x, y >= 0, y))
    n = sum(m.sum() for _, m, _ in groups)
    theta = np.zeros(len(FEATURES) + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        grad = -decay * theta
        w, jump = theta[:-4], theta[-4:].reshape(2, 2)
        for x, mask, y in groups:
            score = x @ w
            unary = np.stack([np.zeros_like(score), score], axis=-1)
            alpha, beta = _path_sums(unary, jump, mask)
            last = mask.sum(1) - 1
            z = np.logaddexp(*alpha[np.arange(len(y)), last].T)
            p = np.exp(np.minimum(0, alpha[..., 1] + beta[..., 1] - z[:, None]))
            grad[:-4] += np.einsum("dt,dtf->f", np.where(mask, y - p, 0.0), x) / n
            if x.shape[1] > 1:
                pair = np.exp(np.minimum(0, alpha[:, :-1, :, None] + jump + unary[:, 1:, None]
                                         + beta[:, 1:, None] - z[:, None, None, None]))
                pair[~mask[:, 1:]] = 0
                seen = [[((y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)]
                grad[-4:] += (np.array(seen) - pair.sum((0, 1))).ravel() / n
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad ** 2
        theta = theta + 0.2 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-9)
    return {"w": theta[:-4].tolist(), "jump": theta[-4:].reshape(2, 2).tolist()}


def train_on_documents(chains: list[np.ndarray], quality: list[int]) -> dict | None:
    """A field from labels of documents; None without both labels. First every line takes the label
    of its document; then lines of poor documents that look like content on their own are relabelled,
    if others remain, and the field is trained once more."""
    if len(set(quality)) < 2:
        return None
    first = train(chains, [np.full(len(c), q) for c, q in zip(chains, quality)])
    labels = []
    for c, q in zip(chains, quality):
        own = (c @ np.array(first["w"]) > 0).astype(int)
        labels.append(np.ones(len(c), int) if q else own if not own.all() else np.zeros(len(c), int))
    return train(chains, labels)


def viterbi(scores: np.ndarray, jump) -> np.ndarray:
    """The most likely states (1: content) for content scores of lines; ties are content."""
    a, b = 0.0, float(scores[0])
    (j00, j01), (j10, j11) = jump
    back = []
    for s in scores[1:].tolist():
        to0, to1 = b + j10 >= a + j00, b + j11 >= a + j01
        back.append((to0, to1))
        a, b = (b + j10 if to0 else a + j00), (b + j11 if to1 else a + j01) + s
    state, out = int(b >= a), [int(b >= a)]
    for step in reversed(back):
        state = int(step[state])
        out.append(state)
    return np.array(out[::-1])


def judge(text: str | None, model: dict | None) -> tuple:
    """The columns of ``VERDICT`` for one text."""
    lines, again = read_lines(text or "")
    words = [w for line in lines for w in line]
    n, repeated = len(words), repeat_words(words)
    failed = n < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * n
    content = n
    if n and model:
        marks = viterbi(line_features(lines, again) @ np.array(model["w"]), model["jump"])
        content = int(np.array([len(x) for x in lines]) @ marks)
    return (n, sum(map(len, words)), sum(map((text or "").count, SYMBOLS)), sum(again), repeated,
            failed, content, not failed and content >= MIN_SHARE * n)


def labelled_chains(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc features (flat array) and quality of at most ``most`` documents of each label."""
    known = (labels.where("doc_id is not null and quality in (0, 1)")
             .select("doc_id", F.col("quality").cast("int").alias("quality")).dropDuplicates())
    picked = None
    for q in (0, 1):
        own = (known.where(F.col("quality") == q)
               .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
        picked = own if picked is None else picked.unionByName(own)

    @F.pandas_udf("array<double>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([line_features(*read_lines(t)).ravel().tolist() for t in s.fillna("")])

    return (docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            .select("quality", features("text").alias("x")))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> dict | None:
    """Collects the features of the sample (bounded by ``most`` documents a label) and trains."""
    small_batches(docs.sparkSession)
    rows = sorted((r["quality"], r["x"]) for r in labelled_chains(docs, labels, most).collect()
                  if r["x"])
    return train_on_documents([np.array(x).reshape(-1, len(FEATURES)) for _, x in rows],
                              [q for q, _ in rows])


def judged(docs: DataFrame, model: dict | None) -> DataFrame:
    """The packed ``row`` and struct ``q`` with the columns of ``VERDICT``."""
    names = [c.split()[0] for c in VERDICT.split(", ")]

    @F.pandas_udf(VERDICT)
    def verdict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            yield pd.DataFrame([judge(t, model) for t in s], columns=names)

    return packed(docs, text=F.col("text")).select("row", verdict("text").alias("q"))


@register("op3_quality_rules")
def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, model).select("row.doc_id", "q.*")


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are kept."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return judged(docs, model).where("q.kept").select("row.*")
