"""Benchmark decontamination: SimHash fingerprints of item-sized windows.

Words are lower-cased; an item of ``L`` words is compared with windows of ``L`` words of a document (a shorter
document: all its words),
both as multisets of five-word shingles (shorter items: one shingle of all their words). A document is
contaminated by an item when some window's fingerprint lies within ``RADIUS`` bits of the item's and
their weighted shingle similarity (sum of smaller counts over sum of larger counts) is at least 0.8.

* **Fingerprints.** 64-bit SimHash over shingle hashes. Bit counts are kept in 16-bit lanes: sixteen sums
  of ``(hash >> k) & 0x0001000100010001`` hold all 64 counters.
* **Multi-index Hamming blocks.** A fingerprint is cut into 8 blocks of 8 bits. Two fingerprints within
  23 bits agree in some block up to 2 bits (8 blocks with 3 or more differing bits make 24), so items are
  indexed under all values within 2 bits of each of their blocks and windows look up their own blocks:
  nothing within the radius is missed. At similarity 0.8 about 10 of 64 bits differ.
* **Which windows.** Two bags of m shingles at 0.8 share at least 8/9 of m, in any order. Shingles of
  documents are looked up among the shingles of all items of m shingles; every window with that many hits
  is fingerprinted, so no window at 0.8 is left out before the fingerprints are compared. A document with
  n < m shingles is one window, which needs 4/9 of n + m hits.

Looking up is a narrow pass over the documents; hits are grouped by text digest and item size into ranges of
starts (combined before the shuffle, so copies shrink in their own task), and a second narrow pass
fingerprints the windows of texts that have any. Item tables and ranges are broadcast only while they hold
at most ``common.BROADCAST_ROWS`` rows (else they are joined by shuffle). Verified windows shrink to (document,
item) at the end with maxima before the shuffle.

Defined cases: null and blank texts and items have no words and match nothing; null ids stay null; equal
rows give one result row for each (doc_id, item_id), different texts of one doc_id one each; equal items are reported each; items longer than
65,535 shingles are an error of the lanes and are refused.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, GAP, packed, register, small, staged, table, words

SHINGLE, MIN_SIMILARITY = 5, 0.8
RADIUS, BLOCKS, BLOCK_BITS = 23, 8, 8
REACH = RADIUS // BLOCKS
_LANES = 0x0001000100010001


def shingle_hashes(tokens: Column, k: int) -> Column:
    """Hashes of all shingles of ``k`` words in order (fewer words: none)."""
    n = F.size(tokens) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                                     lambda i: F.xxhash64(F.slice(tokens, i, k)))
                  ).otherwise(F.array().cast("array<bigint>"))


def with_fingerprint(df: DataFrame, hashes: str) -> DataFrame:
    """Adds ``fp``, the 64-bit SimHash of an array of hashes; ties in a bit count as 0."""
    def lane(k: int) -> Column:
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.shiftrightunsigned(
            h, k).bitwiseAND(F.lit(_LANES)))

    def bit(k: int, j: int) -> Column:
        ones = F.shiftrightunsigned(F.col("lanes")[k], 16 * j).bitwiseAND(F.lit(0xFFFF))
        return F.when(ones * 2 > F.size(hashes), F.lit(_signed(1 << (16 * j + k)))).otherwise(
            F.lit(0).cast("long"))

    bits = reduce(Column.bitwiseOR, [bit(k, j) for k in range(16) for j in range(4)])
    return (df.withColumn("lanes", F.array(*[lane(k) for k in range(16)]))
            .withColumn("fp", bits).drop("lanes"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def block(fp: Column, i: Column) -> Column:
    """The i-th block of a fingerprint."""
    return F.expr(f"shiftrightunsigned(fp, cast(i * {BLOCK_BITS} as int))").bitwiseAND(
        F.lit((1 << BLOCK_BITS) - 1))


def near_values() -> list[int]:
    """All masks of a block with at most ``REACH`` bits."""
    return [m for m in range(1 << BLOCK_BITS) if m.bit_count() <= REACH]


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of shingle hashes, as multisets."""
    def count(h, x):
        return F.size(F.filter(h, lambda y: y == x))

    both = F.aggregate(F.array_distinct(b), F.lit(0),
                       lambda s, x: s + F.least(count(a, x), count(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def prepared_items(items: DataFrame) -> DataFrame:
    """``items`` (item_id, text) to item_id, item (a number of the row's content), k, hashes, fp."""
    tokens = items.select("item_id", words(F.lower("text")).alias("w")).where(F.size("w") > 0)
    tokens = tokens.withColumn("k", F.least(F.size("w"), F.lit(SHINGLE)))
    hashes = reduce(lambda other, k: F.when(F.col("k") == k, shingle_hashes(F.col("w"), k))
                    .otherwise(other), range(1, SHINGLE),
                    shingle_hashes(F.col("w"), SHINGLE))
    out = tokens.select("item_id", "k", hashes.alias("hashes"))
    out = out.withColumn("hashes", F.when(F.size("hashes") > 65535, F.raise_error(
        F.lit("item too long"))).otherwise(F.col("hashes")))
    return staged(with_fingerprint(out, "hashes"), "items")


def contaminated(docs: DataFrame, items: DataFrame, digests: bool = False) -> DataFrame:
    """``docs`` (doc_id, text) and ``items`` (item_id, text) to (doc_id, item_id, similarity,
    first_word): the best window of each text and item, the first of equals. ``digests`` adds the text's
    digest."""
    items = prepared_items(items)
    ks = [r["k"] for r in items.select("k").distinct().collect()]
    docs = docs.select("doc_id", "text", F.md5("text").alias("digest"))
    found = [_hits(docs, items.where(F.col("k") == k), k) for k in sorted(ks)]
    if not found:
        return docs.select("doc_id", *(["digest"] if digests else []), F.lit(None).cast("long").alias("item_id"),
                           F.lit(0.0).alias("similarity"), F.lit(0).alias("first_word")).limit(0)
    hits = reduce(DataFrame.unionByName, found)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    return (hits.groupBy("doc_id", "digest", "item_id").agg(best)
            .select("doc_id", *(["digest"] if digests else []), "item_id", F.col("best.similarity").alias("similarity"),
                    (-F.col("best.s") - 1).alias("first_word")))


def _ranges(hits: DataFrame) -> DataFrame:
    """``hits`` (digest, n, m, p: positions from 0 that hold a shingle of an item with m shingles) to
    ranges (digest, m, size, low, high) of starts from 1 without overlap: all windows of ``size``
    shingles (m, or all n of a shorter document) with as many hits as the similarity needs."""
    found = (hits.groupBy("digest", "n", "m").agg(F.array_sort(F.collect_set(F.col("p") + 1)).alias("at"))
             .withColumn("size", F.least("n", "m"))  # a shorter document is one window
             .withColumn("least", F.expr("cast((4 * (size + m) + 8) div 9 as int)"))
             .where("size(at) >= least"))
    # The j-th hit and the one that completes it bound the starts; those up to the hit before are others'.
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("at") - F.col("least") + 1, F.lit(1))),
                       lambda j: F.struct(
        F.greatest(F.try_element_at("at", j + F.col("least") - 1) - F.col("size") + 1, F.lit(1),
                   F.when(j > 1, F.try_element_at("at", F.greatest(j - 1, F.lit(1))) + 1)).alias("low"),
        F.least(F.try_element_at("at", j), F.col("n") - F.col("size") + 1).alias("high")))
    return (found.select("digest", "m", "size", F.explode(each).alias("r"))
            .select("digest", "m", "size", "r.low", "r.high").where("low <= high"))


def _hits(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Verified windows of ``docs`` (doc_id, text, digest) for items with shingles of ``k`` words."""
    size = F.size("hashes")
    anchors = items.select(size.alias("m"), F.explode("hashes").alias("hash")).distinct()
    anchors = small(staged(anchors, "anchors"))
    # A blank text gives one empty word here, which no item has.
    tokens = F.split(F.btrim(F.lower(F.coalesce("text", F.lit(""))), F.lit(BLANKS)), GAP)

    def hashed(rows: DataFrame, *keep: str) -> DataFrame:  # in two steps: else words are cut for each shingle
        return (rows.select(*keep, tokens.alias("w"))
                .select(*keep, shingle_hashes(F.col("w"), k).alias("hashes")))

    # The outer form: for the other Spark would test the array's size first, and compute it twice.
    at = hashed(docs, "digest").select("digest", "hashes", F.posexplode_outer("hashes").alias("p", "hash"))
    ranges = staged(_ranges(at.join(anchors, "hash").withColumn("n", size)), "ranges")
    matched = docs.join(small(ranges.select("digest").distinct()), "digest", "left_semi")
    around = (hashed(matched, "doc_id", "digest").join(small(ranges), "digest")
              .select("doc_id", "digest", "m", "size", "low", "high",
                      F.slice("hashes", F.col("low"), F.col("high") - F.col("low") + F.col("size"))
                      .alias("part")))
    windows = (around.select("doc_id", "digest", "m", "size", "low", "part",
                             F.explode(F.sequence("low", "high")).alias("start"))
               .select("doc_id", "digest", "m", "start",
                       F.slice("part", F.col("start") - F.col("low") + 1, F.col("size")).alias("window")))
    windows = with_fingerprint(windows, "window")
    numbers = F.array(*[F.lit(i) for i in range(BLOCKS)])
    index = (items.select("item_id", size.alias("m"), F.col("fp").alias("item_fp"),
                          F.col("hashes").alias("item_hashes"), "fp", F.explode(numbers).alias("i"))
             .withColumn("value", block(F.col("fp"), F.col("i"))).drop("fp")
             .select("*", F.explode(F.array(*[F.lit(m).cast("long") for m in near_values()]))
                     .alias("mask"))
             .withColumn("value", F.col("value").bitwiseXOR(F.col("mask"))).drop("mask"))
    index = staged(index.select("item_id", "m", "i", "value", "item_fp"), "blocks")
    lookups = (windows.select("*", F.explode(numbers).alias("i"))
               .withColumn("value", block(F.col("fp"), F.col("i"))))
    near = (lookups.join(small(index), ["m", "i", "value"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS))
    own = items.select("item_id", F.col("fp").alias("item_fp"), F.col("hashes").alias("item_hashes"),
                       size.alias("m")).distinct()
    return (near.join(small(own), ["item_id", "item_fp", "m"])
            .select("doc_id", "digest", "item_id", "start",
                    similarity(F.col("window"), F.col("item_hashes")).alias("similarity"))
            .where(F.col("similarity") >= MIN_SIMILARITY))


@register("op2_benchmark_decontamination")
def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without benchmark passages; they are told apart by their texts, so rows that share an id
    (or have none) with a contaminated one stay."""
    found = contaminated(docs.select("doc_id", "text"),
                         table(spark, sf_dir, "benchmark").select("item_id", "text"), digests=True)
    bad = staged(found.select(F.col("digest").alias("bad")).distinct(), "contaminated")
    rows = packed(docs, digest=F.md5("text"))
    return rows.join(small(bad), F.col("digest") == F.col("bad"), "left_anti").select("row.*")
