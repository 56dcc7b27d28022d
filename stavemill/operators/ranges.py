"""Joins of points with intervals as equi joins on bins.

Every interval is copied to the bins it covers, a point lies in one bin; both meet on their keys and the bin, and
an exact test follows. A pair meets once, as a point has one bin. The bin is part of the join key, so one key
with very many points is spread over tasks, and no nested loop is planned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bin_of(point: Column, width: int) -> Column:
    return F.floor(point / width).cast("bigint")


def covered(start: Column, end: Column, width: int) -> Column:
    """The bins of the closed interval; none if it is empty."""
    return F.when(start <= end, F.sequence(bin_of(start, width), bin_of(end, width))).otherwise(
        F.array().cast("array<bigint>"))


def interval_join(intervals: DataFrame, points: DataFrame, keys: list[str], start: Column, end: Column, point: str,
                  width: int, how: str = "inner") -> DataFrame:
    """``intervals`` with the ``points`` that share their ``keys`` and lie in ``[start, end]``; no other column of
    the two may share a name. With ``how="left"`` an interval that is empty or meets no point stays, once for
    each bin. ``width`` should be about as long as an interval, which then has two bins."""
    left = intervals.select("*", start.alias("_start"), end.alias("_end"),
                            F.explode_outer(covered(start, end, width)).alias("_bin"))
    right = points.select(*[F.col(k).alias(f"_{k}") for k in keys],
                          *[c for c in points.columns if c not in keys],
                          bin_of(F.col(point), width).alias("_at"))
    cond = (F.col("_bin") == F.col("_at")) & F.col(point).between(F.col("_start"), F.col("_end"))
    for k in keys:
        cond &= F.col(k) == F.col(f"_{k}")
    return left.join(right, cond, how).drop("_start", "_end", "_bin", "_at", *[f"_{k}" for k in keys])
