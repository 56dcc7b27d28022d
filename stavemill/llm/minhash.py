"""Near-duplicates by BagMinHash, bands and exact multiset overlap.

A document is the multiset of its five-word shingles (fewer than five words: one shingle of them all).
Two texts are linked when the sum of smaller counts over the sum of larger counts is at least 0.8, and
classes are the connected components of links and equal texts.

**Signatures.** Weights are cut at 0, 1, 2, 4, 8, ...; every shingle has one Poisson process for each cut
interval up to its count, with the interval's length as rate, so heavy shingles send points sooner. A
point has a time, a slot and a level inside its interval, all drawn from the hash of (shingle, interval,
number); points above the count are skipped. A slot keeps its earliest time. Processes run together in
rounds and end as soon as their time passes the latest slot, so a document costs about one point a
shingle however many slots there are. Two documents agree in a slot with the probability of their
weighted Jaccard similarity.

**Bands.** 20 bands of 4 slots: a pair at 0.8 shares no band with probability (1 - 0.8^4)^20 < 3e-5.

**Links.** Equal texts collapse first (grouped by digest) and are nodes of their own numbering, whatever their
ids. In every bucket each text is compared with one centre, the text whose buckets are largest (of a group of
near copies the one with the fewest edits): linear in the bucket, and large buckets are cut into parts. Texts
are fetched once, and only pairs whose signatures agree in ``MIN_AGREE`` slots (a pair at 0.8 fails that with
probability < 1e-7) are verified. Verified links join into components. Buckets that then still hold two components or
more are completed across components, so no class depends on the choice of centres: in those of at most
``FEW`` texts, pairs that agree likewise are verified; for the texts of larger ones an exact prefix filter
proposes the pairs, each once. Shingles are ranked from the rarest; two texts at 0.8 share one among their
first ranks, and in a large group of near copies the first ranks are the edits, which few share. So a large
group never becomes pairs.

Defined cases: a null text is its own class; equal texts without words are copies; a null id is a class id
only of a class without other ids, whose texts are compared like all others; rows that share an id but not
their text are compared each for itself; of equal rows the pipeline keeps one; long texts are read whole; empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, register, small, small_batches, staged, table

SHINGLE, MIN_SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
SLOTS = BANDS * ROWS
MIN_AGREE = 44
#: Buckets of at most so many texts are completed by comparing signatures.
FEW = 32
#: Larger buckets are compared with their centre in parts of about so many members.
PART = 512
#: Prefixes of at most so many tokens are carried along to propose a pair once.
CARRIED = 256
#: Hash ranges of tokens: at least so many, and one for so many characters of text.
LEAST_RANGES, RANGE_CHARS = 16, 8_000_000
_G = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + _G
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Hashes of words seen in this task, forgotten when they grow too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, known: _Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes and their counts."""
    parts = text.encode("utf-8", "surrogatepass").split()  # bytes split at the blanks of the contract
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(known.__getitem__, parts), np.uint64, n)
    k = min(SHINGLE, n)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _G + h[i:i + n - k + 1]
    return np.unique(_mix(out), return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """The slots' earliest times for each multiset (inf in all for an empty one). The multisets run
    through the rounds together."""
    best = np.full((len(bags), slots), np.inf)
    elements = np.concatenate([e for e, _ in bags]) if bags else np.empty(0, np.uint64)
    counts = np.concatenate([c for _, c in bags]).astype(float) if bags else np.empty(0)
    owner = np.repeat(np.arange(len(bags)), [len(e) for e, _ in bags])
    parts = [(_mix(elements), np.ones(len(elements)), np.zeros(len(elements)), counts, owner)]
    low = 1.0
    while (own := counts > low).any():  # the interval (low, 2 low]
        elements, counts, owner = elements[own], counts[own], owner[own]
        parts.append((_mix(_mix(elements) ^ np.uint64(int(low))), np.full(len(elements), low),
                      np.full(len(elements), low), counts, owner))
        low *= 2
    key, rate, low_, top, owner = map(np.concatenate, zip(*parts))
    time = np.zeros(len(key))
    while len(key):
        key = _mix(key)
        time = time - np.log1p(-(key >> np.uint64(11)).astype(float) * 2.0 ** -53) / rate
        draw = _mix(key ^ _G)
        slot = (draw % np.uint64(slots)).astype(np.int64)
        inside = (rate == 1) | (low_ + (draw >> np.uint64(40)).astype(float) * 2.0 ** -24 * rate < top)
        at = owner * slots + slot
        np.minimum.at(best.reshape(-1), at[inside], time[inside])
        live = np.flatnonzero(time < best.max(axis=1)[owner])
        key, rate, low_, top, owner, time = (x[live] for x in (key, rate, low_, top, owner, time))
    return best


def overlap(a: tuple, b: tuple) -> float:
    """Weighted Jaccard similarity of two multisets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    return both / max(1, int(a[1].sum()) + int(b[1].sum()) - both)


def signed(docs: DataFrame) -> DataFrame:
    """``docs`` (id, text) to id, digest, sig (null without words) and bands."""
    at_once = 100_000  # shingles

    def columns(bags: list) -> tuple[list, list]:
        best = signatures(bags)
        bits = _mix(best.view(np.uint64))
        short = (bits >> np.uint64(48)).astype(np.uint16).view(np.int16)
        key = np.arange(BANDS, dtype=np.uint64)[None, :]
        for r in range(ROWS):
            key = _mix(key ^ bits[:, r::ROWS])
        empty = np.isinf(best[:, 0])
        return ([None if e else x for e, x in zip(empty, short)],
                [None if e else x for e, x in zip(empty, key.view(np.int64))])

    @F.pandas_udf("sig array<short>, bands array<long>")
    def sign(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for s in texts:
            sigs, bands, bags, n = [], [], [], 0
            for t in s:
                bags.append(shingles(t or "", known))
                n += len(bags[-1][0])
                if n >= at_once:
                    more = columns(bags)
                    sigs, bands, bags, n = sigs + more[0], bands + more[1], [], 0
            more = columns(bags)
            yield pd.DataFrame({"sig": sigs + more[0], "bands": bands + more[1]})

    return (docs.select("id", F.md5("text").alias("digest"), sign("text").alias("s"))
            .select("id", "digest", "s.sig", "s.bands"))


def rare_tokens(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """``nodes`` (node, class) to (node, class, size, token, rank, before): the shingles of each, the n-th
    occurrence as a token of its own, ranked from the rarest among these nodes; only ranks that a pair at
    the threshold can need, and only tokens that two nodes share. ``before`` are the node's tokens of lower
    rank, none for nodes with more than ``CARRIED`` of them.

    Tokens travel in arrays: a node's tokens are dealt to ranges of their hash, each range is counted as a whole,
    and only the prefix becomes rows."""
    # Staged before the tokens are made, or they would be made of every text that the join reads.
    bags = staged(nodes.join(texts, "node").select("node", "class", "text"), "open-texts")
    chars = bags.agg(F.sum(F.char_length("text"))).first()[0] or 0
    ranges = max(LEAST_RANGES, -(-chars // RANGE_CHARS))

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            out = []
            for node, label, text in zip(batch["node"], batch["class"], batch["text"]):
                e, c = shingles(text, known)
                nth = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
                t = np.sort(_mix(np.repeat(e, c) ^ nth.astype(np.uint64)))
                at = (t >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
                cuts = np.flatnonzero(np.diff(at)) + 1
                out += [(node, label, len(t), int(part[0] >> np.uint64(32)) * ranges >> 32, part.view(np.int64))
                        for part in np.split(t, cuts)]
            yield pd.DataFrame(out, columns=["node", "class", "size", "range", "tokens"])

    def counted(part: pd.DataFrame) -> pd.DataFrame:
        lengths = [len(t) for t in part["tokens"]]
        _, which, n = np.unique(np.concatenate(part["tokens"].to_list()), return_inverse=True, return_counts=True)
        return part[["node", "class", "size", "tokens"]].assign(
            n=np.split(n[which], np.cumsum(lengths)[:-1]))

    parts = bags.mapInPandas(dealt, "node long, class long, size int, range long, tokens array<long>")
    each = parts.groupBy("range").applyInPandas(
        counted, "node long, class long, size int, tokens array<long>, n array<long>")
    pairs = F.arrays_zip(F.col("n"), F.col("tokens").alias("token"))
    least = (each.select("node", "class", "size", pairs.alias("t")).groupBy("node", "class", "size")
             .agg(F.array_sort(F.flatten(F.collect_list("t"))).alias("t"))
             .select("node", "class", "size", F.slice("t", F.lit(1), F.floor(F.col("size") / 5).cast("int") + 1)
                     .alias("t")))
    # Tokens of one node only come first; the others keep their rank.
    alone = F.size(F.filter("t", lambda x: x["n"] == 1))
    shared = least.withColumn("alone", alone).withColumn("t", F.transform(
        F.filter("t", lambda x: x["n"] > 1), lambda x: x["token"]))
    none = F.array().cast("array<long>")
    before = F.when(F.size("t") <= CARRIED, F.slice("t", F.lit(1), F.col("i"))).otherwise(none)
    return staged(shared.select("node", "class", "size", "alone", "t", F.posexplode("t").alias("i", "token")).select(
        "node", "class", "size", "token", (F.col("alone") + F.col("i") + 1).alias("rank"), before.alias("before")),
        "tokens")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of node ids whose similarity reaches the threshold. ``texts``: node, text."""

    @F.pandas_udf("double")
    def similarity(cols: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known, last = _Words(), {}
        for left, right in cols:
            out = []
            for a, b in zip(left, right):
                if a not in last:  # pairs come together by their left text
                    last.clear()
                    last[a] = shingles(a, known)
                out.append(overlap(last[a], shingles(b, known)))
            yield pd.Series(out, dtype="float64")

    left = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    right = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    return (pairs.join(left, "b").join(right, "a")
            .where(similarity("text_a", "text_b") >= MIN_SIMILARITY).select("a", "b").distinct())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Links (a, b) to (node, class): the smallest node of its component, for every other node of it.
    Alternating star contractions; every round is written to the shared folder."""
    edges = staged(_ordered(links), "links")
    done = None
    for _ in range(rounds):
        sides = edges.select("a", "b").union(edges.select("b", "a"))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"),
                                                             F.col("m").alias("b"))
        large = _ordered(large)
        low = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        small = large.join(low, large["b"] == low["u"]).select("a", "b", "m")
        small = small.select("a", F.col("m").alias("b")).union(small.select("b", F.col("m")))
        edges = staged(_ordered(small), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == done:
            break
        done = now
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    return edges.select(F.col("b").alias("node"), F.col("a").alias("class"))


def _ordered(links: DataFrame) -> DataFrame:
    return (links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .where("a < b").distinct())


def _agree(x: str, y: str):
    """In how many slots two signatures agree."""
    return F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: e))


def centre_pairs(crowded: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's centre. Buckets are cut into parts of about ``PART``
    members and the centre copied to each, so that a large bucket is no single task."""
    central = crowded.groupBy("node").agg(F.sum("n").alias("central"))
    centre = (crowded.join(central, "node").groupBy("band", "n")
              .agg(F.max(F.struct("central", F.xxhash64("node").alias("h"), "node")).alias("c"))
              .select("band", F.col("c.node").alias("centre"), F.explode(F.sequence(
                  F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / PART))).alias("part")))
    parts = F.pmod(F.xxhash64("node"), F.floor((F.col("n") - 1) / PART) + 1)
    return _ordered(crowded.withColumn("part", parts).join(centre, ["band", "part"])
                    .select(F.col("centre").alias("a"), F.col("node").alias("b")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (id long, text) to (id, digest, class, stays) for every row; digest is null for null texts,
    ``stays`` marks the rows of the text that stands for its class."""
    small_batches(docs.sparkSession)
    sigs = staged(signed(docs), "signatures")
    reps = sigs.where("digest is not null").groupBy("digest").agg(F.min("id").alias("id"))
    # One signature row for each distinct text; ids may be null or repeated, nodes are not.
    nodes = staged(sigs.where("sig is not null").groupBy("digest").agg(
        F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    members = nodes.select("node", F.explode("bands").alias("band"))
    sizes = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    crowded = staged(members.join(small(sizes), "band"), "buckets")
    asked = nodes.join(small(crowded.select("node").distinct()), "node", "left_semi")
    asked = staged(asked.select("node", "digest", "id", "sig"), "asked")
    # Their texts, each once: of equal texts the row with the least id, and of equal rows one.
    keys = small(asked.select("node", F.col("digest").alias("d"), F.col("id").alias("i")))
    texts = staged(docs.select("id", F.md5("text").alias("digest"), "text").join(
        keys, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")))
        .select("node", "text").dropDuplicates(["node"]), "texts")
    tried = staged(centre_pairs(crowded), "pairs")
    sig = asked.select(F.col("node").alias("b"), F.col("sig").alias("sig_b"))
    alike = tried.join(sig, "b").join(sig.toDF("a", "sig_a"), "a").where(_agree("sig_a", "sig_b") >= MIN_AGREE)
    links = staged(verified(staged(alike.select("a", "b"), "alike"), texts), "verified")
    classes = components(links)

    # Buckets that still hold several components; those of two members were already compared.
    labelled = (crowded.join(classes, "node", "left")
                .select("band", "n", "node", F.coalesce("class", "node").alias("class")))
    split = (labelled.where("n > 2").groupBy("band")
             .agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
             .where("lo < hi").select("band"))
    open_ = staged(labelled.join(small(split), "band"), "open-buckets")
    few = open_.where(F.col("n") <= FEW).join(asked.select("node", "sig"), "node")
    x, y = few.alias("x"), few.alias("y")
    near = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node"))
                  & (F.col("x.class") != F.col("y.class")) & (_agree("x.sig", "y.sig") >= MIN_AGREE))
    many = rare_tokens(open_.where(F.col("n") > FEW).select("node", "class").distinct(), texts)
    x, y = many.alias("x"), many.alias("y")
    # Pairs at 0.8 share at least 4/9 of both sizes together, hence a token among these first ranks. A pair is
    # proposed at the first token it shares; where that is not known, at each, and made distinct afterwards.
    least = F.ceil((F.col("x.size") + F.col("y.size")) * 4 / 9)
    rare = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node") < F.col("y.node"))
                  & (F.col("x.class") != F.col("y.class"))
                  & (F.col("x.rank") <= F.col("x.size") - least + 1)
                  & (F.col("y.rank") <= F.col("y.size") - least + 1)
                  & ~F.arrays_overlap("x.before", "y.before"))
    more = near.select("x.node", F.col("y.node").alias("b")).union(
        rare.select("x.node", F.col("y.node").alias("b"))).toDF("a", "b").distinct()
    more = staged(more.join(tried, ["a", "b"], "left_anti"), "more-pairs")
    extra = staged(verified(more, texts), "verified-more")
    if not extra.isEmpty():
        classes = components(links.union(extra))

    # A class is named by its least id; of the texts with that id, the one of the least digest stays.
    roots = classes.select("class", "class").distinct().toDF("node", "class")
    linked = classes.union(roots).join(asked.select("node", "id", "digest"), "node")
    best = linked.groupBy("class").agg(F.min(F.struct(
        F.col("id").isNull().alias("none"), "id", "digest")).alias("best"))
    named = linked.join(small(best), "class").select("digest", F.col("best.id").alias("class"),
                                                     F.col("best.digest").alias("stay"))
    label = (reps.join(named, "digest", "left").select(
        "digest", F.when(F.col("stay").isNull(), F.col("id")).otherwise(F.col("class")).alias("class"),
        F.coalesce("stay", "digest").alias("stay")))
    null = F.col("digest").isNull()
    return (sigs.select("id", "digest").join(label, "digest", "left")
            .withColumn("class", F.when(null, F.col("id")).otherwise(F.col("class")))
            .withColumn("stays", null | ((F.col("digest") == F.col("stay"))
                                         & F.col("id").eqNullSafe(F.col("class")))).drop("stay"))


@register("op7_minhash_near_dedup")
def op7_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.col("class").alias("class_id"), F.col("stays").alias("kept"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the row of its smallest id."""
    found = near_duplicates(docs.select(F.col("doc_id").alias("id"), "text"))
    stay = found.where("stays").select(_key(F.col("id"), F.col("digest")).alias("key")).distinct()
    rows = packed(docs, key=_key(F.col("doc_id"), F.md5("text")))
    first = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.join(stay, "key").withColumn("n", first).where("n = 1").select("row.*")


def _key(ident, digest):
    return F.concat_ws(":", F.coalesce(ident.cast("string"), F.lit("n")),
                       F.coalesce(digest, F.lit("n")))
