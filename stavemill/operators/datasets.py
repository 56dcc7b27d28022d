"""Training-sample assembly.

Random choices are arithmetic hashes of (id, seed): the same rows on every run and engine, no
matter how the data is partitioned or how often a lost task is recomputed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vocab import EOS_ID, PAD_ID, SOS_ID
from .ranges import interval_join
from .sequence import flag, split_systems

MODULUS = 1 << 32
# Fixed values: (shift, multiplier) rounds of a 32-bit mix; every product stays below 2^63.
ROUNDS, LAST_SHIFT = ((16, 0x21F0AAAD), (15, 0x735A2D97)), 15
HALF = MODULUS - 1


def _mixed(x: Column) -> Column:
    for shift, factor in ROUNDS:
        x = (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(HALF))
    return x.bitwiseXOR(F.shiftright(x, LAST_SHIFT))


def hash_of(key: Column, seed: int) -> Column:
    """0 .. 2^32 - 1: both halves of the 64-bit key go through a nonlinear mix with the seed."""
    key = key.cast("bigint")
    high = _mixed(F.shiftright(key, 32).bitwiseAND(F.lit(HALF)).bitwiseXOR(F.lit(seed).cast("bigint")))
    return _mixed(key.bitwiseAND(F.lit(HALF)).bitwiseXOR(high))


def uniform(key: Column, seed: int) -> Column:
    """[0, 1)."""
    return hash_of(key, seed) / float(MODULUS)


def explode_samples(scores: DataFrame) -> DataFrame:
    """``scores(score_id, tokens, n_staves, breaks)`` to one sample per system (grand score
    on an even number of staves) or per staff row, of any length. Scores without a detected staff
    give none."""
    usable = scores.filter(F.col("n_staves") > 0).withColumn(
        "by_system", F.array_contains("tokens", "staff-bass") & (F.col("n_staves") >= 2)
        & (F.col("n_staves") % 2 == 0))
    n = F.when(F.col("by_system"), (F.col("n_staves") / 2).cast("int")).otherwise(F.col("n_staves"))
    rows = usable.select(
        "score_id", n.alias("n_systems"), F.when(F.col("by_system"), F.col("breaks")).alias("breaks"),
        F.posexplode("tokens").alias("pos", "token"))
    return split_systems(rows).withColumnRenamed("system_idx", "sample_idx")


def overlong_samples(samples: DataFrame, max_seq: int) -> DataFrame:
    """Samples of more than ``max_seq`` tokens, with their length; nothing is cut."""
    return samples.groupBy("score_id", "sample_idx").agg(F.count("*").alias("n_tokens")).filter(
        F.col("n_tokens") > max_seq)


def kth_smallest(rows: DataFrame, key: str, seed: int, k) -> tuple[int, int] | None:
    """The k-th smallest (hash, key); ``k`` is a function of the row count. None for no row.

    Two grouped counts of 2^12 buckets each narrow the place down to 2^8 hash values, and only the rows
    of those are sorted. The driver sees counts and one row.
    """
    df, below, prefix, shift = rows.select(key).withColumn("_h", hash_of(F.col(key), seed)), 0, None, 32
    want = None
    for _ in range(2):
        shift -= 12
        inside = df if prefix is None else df.filter(F.shiftright("_h", shift + 12) == prefix)
        counts = sorted((r["b"], r["count"]) for r in
                        inside.groupBy(F.shiftright("_h", shift).alias("b")).count().collect())
        if want is None:
            n = sum(c for _, c in counts)
            want = min(k(n), n)
            if want <= 0:
                return None
        for prefix, c in counts:
            if below + c >= want:
                break
            below += c
    last = df.filter(F.shiftright("_h", shift) == prefix).orderBy("_h", key).offset(want - below - 1)
    r = last.limit(1).first()
    return r["_h"], r[key]


def in_first(rows: DataFrame, key: str, seed: int, k) -> Column:
    """Whether a row is among the ``k`` with the smallest (hash, key); keys are unique. A row-local
    test: no join, no shuffle of the rows."""
    top = kth_smallest(rows, key, seed, k)
    if top is None:
        return F.lit(False)
    h = hash_of(F.col(key), seed)
    return (h < top[0]) | ((h == top[0]) & (F.col(key) <= top[1]))


def pick_first(rows: DataFrame, key: str, seed: int, k: int) -> DataFrame:
    """The ``k`` rows with the smallest (hash, key), exactly, without a global sort."""
    return rows.filter(in_first(rows, key, seed, lambda n: k))


def replay_sample(current: DataFrame, replay: DataFrame, key: str, k: int, seed: int = 42
                  ) -> DataFrame:
    """The current set plus ``k`` seeded rows of an earlier one (all of it if smaller)."""
    chosen = pick_first(replay, key, seed, k)
    return current.withColumn("replayed", F.lit(False)).unionByName(
        chosen.withColumn("replayed", F.lit(True)))


def split_dataset(rows: DataFrame, key: str, ratio: float = 0.1, seed: int = 42) -> DataFrame:
    """D3: adds ``split``; validation takes max(1, floor(n * ratio)) seeded rows."""
    val = in_first(rows, key, seed, lambda n: max(1, int(n * ratio)))
    return rows.withColumn("split", F.when(val, "val").otherwise("train"))


def shift_targets(samples: DataFrame, ids: str = "ids") -> DataFrame:
    """Decoder input and expected output."""
    return (samples.withColumn("tgt_in", F.concat(F.array(F.lit(SOS_ID)), ids))
            .withColumn("tgt_out", F.concat(ids, F.array(F.lit(EOS_ID)))))


def pad_batch(samples: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Pads both targets to the longest of the batch; ``mask`` is true on padding."""
    longest = F.max(F.size("tgt_in")).over(Window.partitionBy(batch))
    df = samples.withColumn("_max", longest)
    fill = F.col("_max") - F.size("tgt_in")
    pad = lambda c: F.concat(c, F.array_repeat(F.lit(PAD_ID), fill))
    mask = F.concat(F.transform("tgt_in", lambda _: F.lit(False)),
                    F.array_repeat(F.lit(True), fill))
    return (df.withColumn("mask", mask).withColumn("tgt_out", pad(F.col("tgt_out")))
            .withColumn("tgt_in", pad(F.col("tgt_in"))).drop("_max"))


def augment_policy(samples: DataFrame, key: str, base: int, top: int, p_top: float, epoch: int,
                   seed: int = 42) -> DataFrame:
    """Adds ``augmented`` and ``level``. Photographs (``is_photo``) are never augmented;
    validation rows (``is_val``) draw from their index alone, so every epoch repeats them."""
    u = F.when(F.col("is_val"), uniform(F.col(key), seed)).otherwise(
        uniform(F.col(key) * 1009 + epoch, seed))
    return samples.withColumn("augmented", ~F.col("is_photo")).withColumn(
        "level", F.when(~F.col("is_photo"), F.when(u < p_top, top).otherwise(base)))


def weighted_pick(rows: DataFrame, key: str, weights: dict, name: str, seed: int = 42) -> DataFrame:
    """One category per row, by cumulative weights over a hash uniform."""
    u, total, cum, expr = uniform(F.col(key), seed), sum(weights.values()), 0.0, None
    items = list(weights.items())
    for value, w in items[:-1]:
        cum += w
        cond = u < cum / total
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return rows.withColumn(name, expr.otherwise(items[-1][0]) if expr is not None
                           else F.lit(items[-1][0]))


PICK_BIN = MODULUS // 64


def weighted_pick_by(rows: DataFrame, key: str, group: str, weights: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """D7 with a table: adds ``name``, a category drawn by the weights of the row's ``group``; null where the
    group has none. ``weights`` are ``(group, name, weight)``; weights that are not positive count as none. A
    category owns a range of hashes as wide as its share, and rows meet their range in a join on group and bin:
    any number of categories, and a hot group is spread over its bins."""
    order = Window.partitionBy("_g").orderBy(name)
    upto = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cum = weights.where("weight > 0").select(F.col(group).alias("_g"), name, "weight").withColumn("_upto", upto)
    total = F.max("_upto").over(Window.partitionBy("_g"))
    bound = lambda c: F.floor(c / F.col("_total") * float(MODULUS)).cast("bigint")
    own = cum.withColumn("_total", total).withColumn("_from", F.lag("_upto", 1, 0).over(order)).select(
        "_g", name, bound(F.col("_from")).alias("_lo"), (bound(F.col("_upto")) - 1).alias("_hi"))
    drawn = rows.withColumn("_g", F.col(group)).withColumn("_u", hash_of(F.col(key), seed))
    met = interval_join(own, drawn, ["_g"], F.col("_lo"), F.col("_hi"), "_u", PICK_BIN, "right")
    return met.select(*rows.columns, name)


def vocab_remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old(token, id, vector)`` rows move to the ids of ``new(token, id)``; new tokens
    keep a NULL vector (the default initialisation)."""
    o = old.select("token", F.col("id").alias("old_id"), "vector")
    return new.join(o, "token", "left").withColumn("matched", F.col("old_id").isNotNull())


def vocab_dropped(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old tokens the new vocabulary lost."""
    return old.join(new.select("token"), "token", "left_anti")


def remap_report(old: DataFrame, new: DataFrame) -> DataFrame:
    """Matched / new / old counts, from one pass over both vocabularies' tokens."""
    both = old.select("token", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(
        new.select("token", F.lit(0).alias("o"), F.lit(1).alias("n")))
    per = both.groupBy("token").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return per.agg(F.sum(flag((F.col("o") == 1) & (F.col("n") == 1))).alias("matched"),
                   F.sum("n").cast("bigint").alias("new_total"),
                   F.sum("o").cast("bigint").alias("old_total"))
