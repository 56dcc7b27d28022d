"""Training-log monitoring (L1-L6): rows ``(run_id, epoch, val_ter)``, one window per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .sequence import flag


def _run() -> WindowSpec:
    return Window.partitionBy("run_id").orderBy("epoch")


def _so_far() -> WindowSpec:
    return _run().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def accuracy(ter: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - ter) * 100


def best_so_far(log: DataFrame) -> DataFrame:
    """L1: running minimum and whether this epoch set it (strictly)."""
    before = F.min("val_ter").over(_run().rowsBetween(Window.unboundedPreceding, -1))
    return (log.withColumn("is_best", F.coalesce(F.col("val_ter") < before, F.lit(True)))
            .withColumn("best_ter", F.min("val_ter").over(_so_far())))


def patience_stop(log: DataFrame, k: int) -> DataFrame:
    """L2: epochs since the last improvement; stops at ``k``."""
    df = best_so_far(log)
    last_best = F.max(F.when(F.col("is_best"), F.col("epoch"))).over(_so_far())
    return (df.withColumn("since_best", F.col("epoch") - last_best)
            .withColumn("patience_stop", F.col("since_best") >= k))


def target_stop(log: DataFrame, target_acc: float, epochs: int, check_epoch: int | None = None,
                freeze_epochs: int = 0, after_unfreeze: int | None = None) -> DataFrame:
    """L3: at one epoch (given, after the freeze, or half of all epochs) the best accuracy so far
    must reach the target."""
    if after_unfreeze is not None:
        check_epoch = freeze_epochs + after_unfreeze
    check_epoch = check_epoch or max(1, epochs // 2)
    df = best_so_far(log).withColumn("best_acc", accuracy(F.col("best_ter")))
    return df.withColumn("target_stop", (F.col("epoch") == check_epoch)
                         & (F.col("best_acc") < target_acc))


def plateau_stop(log: DataFrame, lo: float, hi: float, n: int, min_epoch: int | None = None
                 ) -> DataFrame:
    """L4: ``n`` epochs in a row with accuracy inside [lo, hi]."""
    acc = accuracy(F.col("val_ter"))
    df = log.withColumn("_in", (acc >= lo) & (acc <= hi))
    df = df.withColumn("_isle", F.sum(flag(~F.col("_in"))).over(_so_far()))
    streak = F.sum(flag(F.col("_in"))).over(
        Window.partitionBy("run_id", "_isle").orderBy("epoch")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn("streak", F.when(F.col("_in"), streak).otherwise(0))
    late = F.col("epoch") >= (min_epoch or 0)
    return df.withColumn("plateau_stop", (F.col("streak") >= n) & late).drop("_in", "_isle")


def teacher_forcing_ratio(epoch: Column, start: float = 1.0, floor: float = 0.1,
                          ss_epochs: int = 0, warmup: int = 0) -> Column:
    """Linear decay after the warm-up, never below the floor."""
    if ss_epochs <= 0:
        return F.lit(start)
    step = (start - floor) / ss_epochs
    return F.when(epoch > warmup, F.greatest(F.lit(floor), start - step * (epoch - warmup - 1))
                  ).otherwise(start)


def stop_epoch(log: DataFrame, epochs: int, target_acc: float, k: int, band: tuple[float, float],
               n: int, min_epoch: int | None = None) -> DataFrame:
    """Earliest stop per run; on the same epoch target, then patience, then plateau."""
    df = patience_stop(log, k).select("run_id", "epoch", "val_ter", "patience_stop")
    df = target_stop(df, target_acc, epochs).drop("is_best", "best_ter", "best_acc")
    df = plateau_stop(df, *band, n, min_epoch)
    reason = (F.when(F.col("target_stop"), F.struct(F.lit(0).alias("o"), F.lit("target").alias("r")))
              .when(F.col("patience_stop"), F.struct(F.lit(1).alias("o"), F.lit("patience").alias("r")))
              .when(F.col("plateau_stop"), F.struct(F.lit(2).alias("o"), F.lit("plateau").alias("r"))))
    df = df.withColumn("_why", reason)
    hit = F.min(F.when(F.col("_why").isNotNull(), F.struct("epoch", "_why")))
    return df.groupBy("run_id").agg(hit.alias("h"), F.max("epoch").alias("last")).select(
        "run_id", F.coalesce("h.epoch", "last").alias("stop_epoch"),
        F.col("h._why.r").alias("reason"))
