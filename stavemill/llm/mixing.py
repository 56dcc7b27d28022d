"""Mixing sources to target weights by entropy balancing.

Every document ``i`` of source ``s`` gets a rate ``r_i``: the rates nearest to 1 in relative entropy
whose words add up to the target of their source, with ``r_i <= cap``. The dual has one multiplier
per source and is convex; its solution tilts exponentially,

    r_i = min(cap, exp(lambda_s * size_i / mean_s)),    sum(r_i * size_i) = target_s,

with ``mean_s`` the mean size in the source. Newton steps need two sums per source, which Spark
computes over the histogram of sizes (source, size, count): documents are read once for it, hot sources
and groups of copies shrink to counts before any shuffle, and only one row per source reaches the
driver, which takes the step (bracketed, so that the caps cannot throw it off).

Rounding is systematic: copies of a cell (source, size) are differences of rounded running sums of
the rates in order of size, so a source misses its target by about one document; then up to
``FIX_ROUNDS`` single copies are added or removed to close that gap. Within a cell the documents with
the lowest hashes of their id get the extra copy. Ranks are counted within 64 hash buckets of a cell,
so that no task holds a large group of equal sizes. Reruns give the same copies.

Defined cases: null text has size 0; a null source is a source of its own, last in order; documents of
size 0 keep one copy and take nothing; an empty table gives an empty result; equal rows are ranked by
hash and text and are interchangeable. Sources may number at most ``MAX_SOURCES`` (an error beyond it).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, packed, register, staged, table

#: Weights of the sources in order, repeating, and the share of all words that the mix takes.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No source and no document is taken more than so many times.
CAP = 2.0
MAX_SOURCES = 100_000
BUCKETS = 64
FIX_ROUNDS = 4


def weighted_targets(sizes: dict, weights=WEIGHTS, share=SHARE, cap=CAP) -> dict:
    """Target of each source: ``share`` of all words by weight, sources in code point order with null
    last; a target stops at ``cap`` times the size, its excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in order if s in free and unit * weight[s] > cap * sizes[s]]
        if not over:
            out |= {s: unit * weight[s] for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def source_key(source: Column) -> Column:
    """Never null, so that joins and windows share one partitioning."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _rate(lam: Column, size: Column, mean: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(lam * size / mean, F.lit(math.log(cap) + 1))))


def solve_dual(cells: DataFrame, state: dict, cap: float = CAP, rounds: int = 80) -> dict:
    """Newton iterations for the multipliers. ``cells``: key, size, n. ``state``: key to a dict with
    size, mean, target. Returns key to multiplier."""
    spark = cells.sparkSession
    lam, lo, hi = {}, {}, {}
    for k, s in state.items():
        if s["size"] <= 0 or s["target"] >= cap * s["size"] * (1 - 1e-12):
            lam[k] = 0.0 if s["size"] <= 0 else math.inf
        elif s["target"] <= 0:
            lam[k] = -math.inf
        else:
            lam[k], lo[k], hi[k] = math.log(s["target"] / s["size"]), -math.inf, math.inf
    live = set(lo)
    for _ in range(rounds):
        if not live:
            break
        now = spark.createDataFrame([(k, lam[k], state[k]["mean"]) for k in sorted(live)],
                                    "key string, lam double, mean double")
        rate = _rate(F.col("lam"), F.col("size"), F.col("mean"), cap)
        took = F.col("n") * F.col("size") * rate
        exact = lambda c: F.sum(c.cast("decimal(38,9)"))  # noqa: E731 - the same in any order, so reruns agree
        sums = (cells.join(F.broadcast(now), "key")
                .groupBy("key")
                .agg(exact(took).alias("f"),
                     exact(F.when(rate < cap, took * F.col("size") / F.col("mean"))
                           .otherwise(0.0)).alias("d")).collect())
        for r in sums:
            k, slope = r["key"], float(r["d"])
            gap = float(r["f"]) - state[k]["target"]
            if abs(gap) <= 1e-9 * state[k]["target"]:
                live.discard(k)
                continue
            (hi if gap > 0 else lo)[k] = lam[k]
            step = lam[k] - gap / slope if slope > 0 else math.nan
            if not lo[k] < step < hi[k]:
                if math.isinf(lo[k]):
                    step = lam[k] - max(1.0, abs(lam[k]))
                elif math.isinf(hi[k]):
                    step = lam[k] + max(1.0, abs(lam[k]))
                else:
                    step = (lo[k] + hi[k]) / 2
            if step == lam[k]:
                live.discard(k)
            lam[k] = step
    return lam


def mix(docs: DataFrame, source: Column, size: Column, ident: Column, tie: Column,
        targets=weighted_targets, cap: float = CAP) -> DataFrame:
    """Adds to ``row`` (the packed input row): key, size, source_size, target, rate, copies.

    ``targets``: function from ``{source: size}`` to ``{source: target}``. ``ident``: what ranks
    documents of one size; ``tie``: orders rows of equal ``ident``.
    """
    spark = docs.sparkSession
    rows = packed(docs, key=source_key(source), source=source.cast("string"), size=size.cast("long"),
                  hash=F.xxhash64(ident), tie=tie)
    rows = rows.withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)).cast("int"))
    bins = staged(rows.groupBy("key", "source", "size", "bucket").agg(F.count("*").alias("n")),
                  "mix-bins")
    cells = bins.groupBy("key", "size").agg(F.sum("n").alias("n"))
    per = (bins.groupBy("key", "source")
           .agg(F.sum(F.col("size") * F.col("n")).alias("size"), F.sum("n").alias("n")))
    sources = per.limit(MAX_SOURCES + 1).collect()
    if len(sources) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    goal = targets({r["source"]: r["size"] for r in sources})
    state = {r["key"]: {"size": r["size"], "mean": max(r["size"] / r["n"], 1e-9),
                        "target": float(goal[r["source"]])} for r in sources}
    lam = solve_dual(cells, state, cap)

    facts = spark.createDataFrame(
        [(k, s["size"], s["mean"], s["target"], max(min(lam[k], 1e300), -1e300))
         for k, s in sorted(state.items())],
        "key string, source_size long, mean double, target double, lam double")
    by_size = Window.partitionBy("key").orderBy(F.desc("size"))
    upto = F.sum(F.col("n") * F.col("rate")).over(by_size.rowsBetween(Window.unboundedPreceding, 0))
    cells = (cells.join(F.broadcast(facts), "key")
             .withColumn("rate", _rate(F.col("lam"), F.col("size"), F.col("mean"), cap))
             .withColumn("cum", F.floor(F.round(upto, 6) + 0.5))
             .withColumn("total", F.col("cum") - F.coalesce(F.lag("cum").over(by_size), F.lit(0)))
             .withColumn("total", F.least("total", F.floor(F.col("n") * cap)))
             .select("key", "size", "n", "rate", "total", "source_size", "target"))
    cells = staged(cells, "mix-cells")
    cells = _close_gaps(cells, state, cap)

    before = Window.partitionBy("key", "size").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    plan = (bins.select("key", "size", "bucket", F.col("n").alias("here"))
            .withColumn("offset", F.coalesce(F.sum("here").over(before), F.lit(0)))
            .join(cells, ["key", "size"]).drop("here"))
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("hash", "tie"))
    return (rows.drop("source").join(plan, ["key", "size", "bucket"])
            .withColumn("rank", F.col("offset") + rank - 1)
            .withColumn("copies", (F.floor(F.col("total") / F.col("n"))
                                   + (F.col("rank") < F.col("total") % F.col("n")).cast("int"))
                        .cast("int"))
            .select("row", "key", "size", "source_size", "target", "rate", "copies"))


def _close_gaps(cells: DataFrame, state: dict, cap: float) -> DataFrame:
    """Adds or removes single copies, each time in the cell whose size is nearest to what a source
    misses, while that brings it nearer."""
    spark = cells.sparkSession
    taken = {r["key"]: r["t"] for r in
             cells.groupBy("key").agg(F.sum(F.col("size") * F.col("total")).alias("t")).collect()}
    gap = {k: state[k]["target"] - t for k, t in taken.items()}
    moves: dict[tuple[str, int], int] = {}
    for _ in range(FIX_ROUNDS):
        want = [(k, g) for k, g in sorted(gap.items()) if abs(g) >= 1]
        if not want:
            break
        now = spark.createDataFrame(want, "key string, gap double")
        done = spark.createDataFrame([(k, s, d) for (k, s), d in sorted(moves.items())],
                                     "key string, size long, moved long")
        best = (cells.join(F.broadcast(done), ["key", "size"], "left")
                .withColumn("at", F.col("total") + F.coalesce("moved", F.lit(0)))
                .join(F.broadcast(now), "key")
                .where((F.col("size") > 0) & F.when(F.col("gap") > 0, F.col("at") < F.floor(
                    F.col("n") * cap)).otherwise(F.col("at") > 0))
                .groupBy("key")
                .agg(F.min(F.struct(F.abs(F.abs("gap") - F.col("size")).alias("miss"),
                                    F.col("size"))).alias("b")).collect())
        for r in best:
            k, size = r["key"], r["b"]["size"]
            if r["b"]["miss"] < abs(gap[k]):
                step = 1 if gap[k] > 0 else -1
                moves[k, size] = moves.get((k, size), 0) + step
                gap[k] -= step * size
    done = spark.createDataFrame([(k, s, d) for (k, s), d in sorted(moves.items())],
                                 "key string, size long, moved long")
    return (cells.join(F.broadcast(done), ["key", "size"], "left")
            .withColumn("total", F.col("total") + F.coalesce("moved", F.lit(0))).drop("moved"))


def mix_documents(docs: DataFrame) -> DataFrame:
    return mix(docs, F.col("source"), n_words(F.col("text")), F.col("doc_id"),
               F.crc32(F.coalesce("text", F.lit(""))))


@register("op8_mixing")
def op8_mixing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mix(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"),
                            F.crc32(F.coalesce("text", F.lit(""))).alias("crc")),
                F.col("source"), F.col("size"), F.col("doc_id"), F.col("crc"))
    return mixed.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"), "copies", "rate")


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mix_documents(docs).where("copies > 0")
    return (mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
            .select("row.*"))
