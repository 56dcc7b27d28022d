"""Exact deduplication with a heavy-hitter split.

Misra-Gries counters find the digests that may be frequent: every task keeps a bounded table of counters
(``approx_top_k_accumulate``, the mergeable form with median decrements), tables are merged in two steps, and
what is left holds every text that makes up more than about ``7 / (2 * TRACKED)`` of all rows. Those candidates
are counted exactly, which also finds the row of each that stays. These verified winners, at most ``TRACKED``
short rows whatever the input, are broadcast: rows of a frequent text are decided where they are read and never
shuffled. All other digests are shuffled as usual, and none of their groups can be large.

Texts are read once: later passes read a staged table of ids and digests.

Defined cases: a null text counts as empty; null ids are smaller than all others; rows with the same text and
the same largest id (repeated rows) leave one row, the last in the staged order; an empty table gives an empty
result; columns of any name stay as they are. Texts are equal if their SHA-256 is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, register, staged, table

#: Counters of a Misra-Gries table, which bounds what is broadcast.
TRACKED = 4096
#: Tables are merged in so many groups before the last merge.
MERGES = 64


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def digests(df: DataFrame, key: Column, text: Column) -> DataFrame:
    """``(key, digest, uid)`` of every row as a staged table; ``uid`` tells repeated rows apart."""
    return staged(df.select(key.alias("key"), digest_of(text).alias("digest"),
                            F.monotonically_increasing_id().alias("uid")), "digests")


def frequent(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``(digest)``: at most ``tracked`` candidates, among them every frequent one."""
    sketch = F.expr(f"approx_top_k_accumulate(digest, {tracked})").alias("sketch")
    merge = F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch")
    groups = rows.groupBy(F.pmod(F.spark_partition_id(), F.lit(MERGES)).alias("part")).agg(sketch)
    items = F.explode(F.expr(f"approx_top_k_estimate(sketch, {tracked})")).alias("x")
    # Grouped, as there is no table of counters to estimate from if there are no rows.
    return groups.groupBy(F.lit("all")).agg(merge).select(items).select(F.col("x.item").alias("digest"))


def winners(rows: DataFrame, tracked: int = TRACKED) -> DataFrame:
    """``(digest, n, best)`` of the candidates that really have copies: exact count and the row that stays."""
    counted = rows.join(F.broadcast(frequent(rows, tracked)), "digest").groupBy("digest").agg(
        F.count("*").alias("n"), F.max(F.struct("key", "uid")).alias("best"))
    return staged(counted.where("n > 1"), "winners")


def exact_groups(df: DataFrame, key: Column, text: Column, tracked: int = TRACKED) -> DataFrame:
    """One row per row of ``df``: ``(key, digest, keep_key, group_size, kept)``; the largest key stays."""
    rows = digests(df, key, text)
    won = F.broadcast(winners(rows, tracked))
    same = Window.partitionBy("digest")
    hot = rows.join(won, "digest")
    cold = rows.join(won, "digest", "left_anti").select(
        "*", F.count("*").over(same).alias("n"), F.max(F.struct("key", "uid")).over(same).alias("best"))
    return hot.unionByName(cold).select(
        "key", "digest", F.col("best.key").alias("keep_key"), F.col("n").alias("group_size"),
        (F.col("uid") == F.col("best.uid")).alias("kept"))


def deduplicated(df: DataFrame, key: Column, text: Column, tracked: int = TRACKED) -> DataFrame:
    """The rows of ``df`` that stay, whole. Copies of frequent texts are dropped in the scan unless they carry
    the winner's key; of the rest, each task passes on one row of a text."""
    won = F.broadcast(winners(digests(df, key, text), tracked).withColumnRenamed("digest", "won"))
    rows = packed(df, key=key, digest=digest_of(text))
    left = rows.join(won, F.col("digest") == F.col("won"), "left").where(
        F.col("won").isNull() | F.col("key").eqNullSafe(F.col("best.key")))
    rank = F.row_number().over(Window.partitionBy("digest").orderBy(F.col("key").desc_nulls_last()))
    return left.select("row", "digest", "key").withColumn("rank", rank).where("rank = 1").select("row.*")


OP13_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@register("op13_exact_dedup", OP13_SQL)
def op13_exact_dedup(spark, sf_dir: str) -> DataFrame:
    groups = exact_groups(table(spark, sf_dir, "documents"), F.col("doc_id"), F.col("text"))
    return groups.select(F.col("key").alias("doc_id"), F.col("keep_key").alias("keep_id"), "group_size", "kept",
                         F.col("digest").alias("text_sha256"))
