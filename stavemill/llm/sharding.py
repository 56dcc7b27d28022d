"""Resharding by minimum-cost flow.

Old shards have sizes, new shards have capacities; a byte that stays where it is costs nothing and a
byte that moves costs one. The flow of least cost from old to new shards says how many bytes each
pair exchanges, hence the fewest bytes that can move. It is solved on the driver over shards only.

A flow becomes an assignment of rows without moving any row to the driver: rows of an old shard lie on
a line of hashes, the flow cuts that line into intervals, one for each new shard, the stay first. Where
a cut falls is found in three grouped counts of bytes (2^11 bins of a shard, then 2^11 bins of each bin
that holds a cut, then the hashes of those), each bounded by the number of shards and bins. Then the
new shard is a comparison of a row's hash with constants: no join and no shuffle. Only files of old
shards that lose rows and of new shards that gain some are rewritten.

Slots number the rows of a new shard without a gap: counts of (shard, bin) give each bin its first slot,
rows are ranked within their bin.

Defined cases: null text has size 1; null ids hash like any value, with source and text as the rest of
the hash; equal rows share a hash and stay together; with less rows than shards some shards are empty;
an empty table gives an empty result; added columns whose name a table has already get an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, register, shared_path, table

SHARDS = 8
BITS = (11, 11, 10)
HASHES = 1 << sum(BITS)


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """Flow from supplies to capacities at least cost, by cheapest augmenting paths (Bellman-Ford on the
    residual graph). Sizes are those of the shard lists."""
    n, m = len(supply), len(capacity)
    if sum(capacity) < sum(supply):
        raise ValueError("capacities hold less than the supplies")
    flow = [[0] * m for _ in range(n)]
    left, room = list(supply), list(capacity)
    while any(left):
        far = float("inf")
        dist = [0 if left[i] else far for i in range(n)] + [far] * m
        back: list[int | None] = [None] * (n + m)
        changed = True
        while changed:
            changed = False
            for i in range(n):
                for j in range(m):
                    if dist[i] + cost[i][j] < dist[n + j]:
                        dist[n + j], back[n + j], changed = dist[i] + cost[i][j], i, True
                    if flow[i][j] and dist[n + j] - cost[i][j] < dist[i]:
                        dist[i], back[i], changed = dist[n + j] - cost[i][j], n + j, True
        end = min((j for j in range(m) if room[j]), key=lambda j: dist[n + j])
        path, at = [], n + end
        while back[at] is not None:
            path.append((back[at], at))
            at = back[at]
        amount = min([left[at], room[end]] + [flow[b][a - n] for a, b in path if a >= n])
        for a, b in path:
            if a < n:
                flow[a][b - n] += amount
            else:
                flow[b][a - n] -= amount
        left[at] -= amount
        room[end] -= amount
    return flow


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _bin(depth: int) -> Column:
    """The first ``depth`` groups of bits of the hash."""
    return F.shiftright("hash", sum(BITS[depth:]))


def plan(rows: DataFrame, old_shards: int, capacities=None, shards: int = SHARDS):
    """``rows``: old (int), hash (long, below HASHES), bytes. Returns the flow and, for each old shard,
    its cuts: ``[(upper hash, new shard), ...]`` in rising order."""
    sums = {(r["old"], r["b"]): r["bytes"] for r in
            rows.groupBy("old", _bin(1).alias("b")).agg(F.sum("bytes").alias("bytes")).collect()}
    supply = [sum(v for (o, _), v in sums.items() if o == i) for i in range(old_shards)]
    room = list(capacities) if capacities else even_capacities(sum(supply), shards)
    flow = min_cost_flow(supply, room, [[int(i != j) for j in range(len(room))]
                                        for i in range(old_shards)])
    # (old shard, new shard) -> bytes of the old shard up to and with that interval
    order = [[i] * (i < len(room)) + [j for j in range(len(room)) if j != i]
             for i in range(old_shards)]
    ends: dict[tuple[int, int], int] = {}
    for i in range(old_shards):
        upto, used = 0, [j for j in order[i] if flow[i][j]]
        for j in used[:-1]:
            upto += flow[i][j]
            ends[i, j] = upto
    # Narrow each cut: which bin holds it, and how many bytes lie below that bin.
    at = {k: (0, 0) for k in ends}
    for depth in range(1, len(BITS) + 1):
        if depth > 1:
            if not ends:
                break
            bins = sorted({(k[0], at[k][0]) for k in ends})
            held = F.lit(False)
            for o in sorted({o for o, _ in bins}):
                held |= (F.col("old") == o) & _bin(depth - 1).isin([b for p, b in bins if p == o])
            sums = {(r["old"], r["b"]): r["bytes"] for r in
                    rows.where(held).groupBy("old", _bin(depth).alias("b"))
                    .agg(F.sum("bytes").alias("bytes")).collect()}
        last = depth == len(BITS)
        for k, end in ends.items():
            parent, below = at[k]
            inside = sorted((b, v) for (o, b), v in sums.items()
                            if o == k[0] and (depth == 1 or b >> BITS[depth - 1] == parent))
            for b, v in inside:
                if below + v >= end or b == inside[-1][0]:
                    # At single hashes the row goes to the side that it exceeds less.
                    at[k] = (b + (below + v - end <= end - below), below) if last else (b, below)
                    break
                below += v
    cuts = []
    for i in range(old_shards):
        used, own = [j for j in order[i] if flow[i][j]], []
        for j in used:
            own.append((at[i, j][0] if (i, j) in at else HASHES, j))
        cuts.append(own)
    return flow, cuts


def assigned(old: Column, hashed: Column, cuts) -> Column:
    """The new shard of a row: comparisons with the cuts of its old shard."""
    out = F.lit(None).cast("int")
    for i, own in enumerate(cuts):
        if own:
            here = F.lit(own[-1][1])
            for upper, j in reversed(own[:-1]):
                here = F.when(hashed < upper, j).otherwise(here)
            out = F.when(old == i, here).otherwise(out)
    return out.cast("int")


def reshard(docs: DataFrame, old: Column, size: Column, ident: list[Column], old_shards: int,
            capacities=None, shards: int = SHARDS) -> DataFrame:
    """The packed ``row`` with old, bytes, hash and the new shard."""
    rows = packed(docs, old=old.cast("int"), bytes=size.cast("long"),
                  hash=F.pmod(F.xxhash64(*ident), F.lit(HASHES)))
    _, cuts = plan(rows.select("old", "hash", "bytes"), old_shards, capacities, shards)
    return rows.withColumn("shard", assigned(F.col("old"), F.col("hash"), cuts))


def with_slots(rows: DataFrame, *tie: Column) -> DataFrame:
    """Numbers the rows of each shard from 0, by old shard and hash."""
    rows = rows.withColumn("bin", (F.col("old") * (1 << BITS[0]) + _bin(1)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    first = (rows.groupBy("shard", "bin").agg(F.count("*").alias("n"))
             .withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    rank = F.row_number().over(Window.partitionBy("shard", "bin").orderBy("hash", *tie))
    return (rows.join(F.broadcast(first), ["shard", "bin"])  # at most old shards * 2^11 + cuts rows
            .withColumn("slot", F.col("first") + rank - 1).drop("first", "bin"))


def free_name(name: str, rows: DataFrame) -> str:
    """``name``, or with underscores before it where the row has a column of that name."""
    taken = {c.lower() for c in rows.select("row.*").columns}
    while name in taken:
        name = "_" + name
    return name


def rewrite(rows: DataFrame, out_dir: str, shards: int = SHARDS) -> list[int]:
    """Writes the new files of every shard whose rows change, one folder for each, and returns their
    numbers; the files of other shards stay as they are."""
    name = free_name("new_shard", rows)
    lost = {r["old"] for r in rows.where("old <> shard").select("old").distinct().collect()}
    won = {r["shard"] for r in rows.where("old <> shard").select("shard").distinct().collect()}
    touched = sorted(x for x in lost | won if x < shards)
    (rows.where(F.col("shard").isin(touched)).select("row.*", F.col("shard").alias(name))
     .write.partitionBy(name).parquet(out_dir))
    return touched


def text_bytes(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + 1).cast("long")


def by_source(source: Column, shards: int = SHARDS) -> Column:
    """The layout before: whole sources, dealt to shards by a checksum of their name."""
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def shard_documents(docs: DataFrame, text: Column, crc: Column) -> DataFrame:
    rows = reshard(docs, by_source(F.col("source")), text, [F.col("doc_id"), F.col("source"), crc],
                   SHARDS)
    return rows


@register("op5_sharding")
def op5_sharding(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", text_bytes(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    rows = shard_documents(docs, F.col("size"), F.col("text_crc32"))
    rows = with_slots(rows, F.col("row.doc_id"), F.col("row.text_crc32"), F.col("bytes"))
    return rows.select("row.doc_id", F.col("bytes").alias("size"), "row.text_crc32",
                       F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"),
                       F.lit(None).cast("int").alias("grown_shard"), "old",
                       (F.col("old") != F.col("shard")).alias("moved"))


def pipeline_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and slot."""
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = shard_documents(docs, text_bytes(F.col("text")), crc)
    rows = with_slots(rows, F.col("row.doc_id"), F.col("row.text"))
    return rows.select("row.*", F.col("shard").alias(free_name("new_shard", rows)),
                       F.col("slot").alias(free_name("new_slot", rows)))
