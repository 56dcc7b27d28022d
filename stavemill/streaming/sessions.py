"""Held notes, checks, trackers, live boards and windows, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.library import ANONYMOUS
from ..operators.ranges import bin_of, covered, interval_join
from ..sources.storage import new_path
from ..sources.versioned import VersionedTable, merge_stream
from . import stateful

CHECK_MS = 6000  # fixed value: time to hear the target note
JOB_LIMIT_MS = 5 * 60 * 1000  # fixed value: a job without an end by then has failed
JOB_KEEP_MS = 24 * 3600 * 1000  # event time for which a closed job ignores further rows


def run_available(stream: DataFrame, name: str, mode: str = "append", path: str | None = None,
                  progress: list | None = None) -> DataFrame:
    """Runs a stream over everything available and returns the sink table.

    The sink and its checkpoint live in the shared folder; an earlier run's ``path`` resumes it.
    Append streams use the file sink; update streams replace one folder per batch, so a repeated
    batch writes the same rows again. ``progress`` collects the reports of the batches.
    """
    spark = stream.sparkSession
    path = path or new_path(spark, name)
    out, writer = f"{path}/out", stream.writeStream.option("checkpointLocation", f"{path}/cp")
    schema = stream.schema
    with stateful.rocksdb(spark):
        if mode == "append":
            q = writer.format("parquet").outputMode("append").trigger(availableNow=True).start(out)
        else:
            def save(df: DataFrame, batch_id: int) -> None:
                df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            q = writer.outputMode(mode).foreachBatch(save).trigger(availableNow=True).start()
        q.awaitTermination()
    if progress is not None:
        progress += q.recentProgress
    return spark.read.schema(schema).parquet(out)


def run_to_end(make, spark, schema: str, row: dict, name: str, mode: str = "append") -> DataFrame:
    """Runs ``make(closing)`` over everything available and closes its tails: ``closing`` is a stream of
    rows of ``schema`` to union with the input. It is empty at first; once the input has been read, the same
    query resumes with the one row ``row`` in it, whose far event time lets the watermark pass all others."""
    path, end = new_path(spark, name), new_path(spark, name + "-end")
    spark.createDataFrame([], schema).write.parquet(end)
    stream = lambda: make(spark.readStream.schema(schema).parquet(end))
    run_available(stream(), name, mode, path)
    (spark.range(1).select(*[F.lit(row.get(f.name)).cast(f.dataType).alias(f.name) for f in
                             spark.createDataFrame([], schema).schema]).write.mode("append").parquet(end))
    return run_available(stream(), name, mode, path)


# -- R2 ----------------------------------------------------------------------------------------

def held_notes(presses: DataFrame) -> DataFrame:
    """R2: ``(session_id, pitch, from_ms, to_ms)``; a repeated press keeps the hold, a release
    without a press does nothing, an open hold has no end."""
    w = Window.partitionBy("session_id", "pitch").orderBy("seq")
    prev = F.coalesce(F.lag("kind").over(w), F.lit("off"))
    changes = presses.withColumn("_p", prev).filter(F.col("_p") != F.col("kind"))
    nxt = F.lead("t_ms").over(w)
    return changes.withColumn("to_ms", nxt).filter("kind = 'on'").select(
        "session_id", "pitch", F.col("t_ms").alias("from_ms"), "to_ms")


def held_notes_stream(presses: DataFrame) -> DataFrame:
    """R2 as keyed state: emits each hold when it ends."""
    return stateful.held_notes_stream(presses)


# -- R6 ----------------------------------------------------------------------------------------

def heard(checks: DataFrame, presses: DataFrame, how: str = "left") -> DataFrame:
    """The presses within six seconds of each check, met on the session and on bins of six seconds."""
    on = presses.filter("kind = 'on'").select("session_id", "t_ms", "pitch")
    return interval_join(checks, on, ["session_id"], F.col("check_ms"), F.col("check_ms") + CHECK_MS, "t_ms",
                         CHECK_MS, how)


def connection_check(checks: DataFrame, presses: DataFrame) -> DataFrame:
    """``checks(session_id, check_ms, target)``: was the target, or any note, heard
    within six seconds."""
    return check_results(heard(checks.select("session_id", "check_ms", "target"), presses))


def target_heard(checks: DataFrame, presses: DataFrame) -> DataFrame:
    """How long after its start a check first heard its target."""
    hits = heard(checks.select("session_id", "check_ms", "target"), presses, "inner").where("pitch = target")
    return hits.groupBy("session_id", "check_ms").agg((F.min("t_ms") - F.col("check_ms")).alias("after_ms"))


def connection_check_stream(checks: DataFrame, presses: DataFrame) -> DataFrame:
    """R6 as a stream-stream interval join on session and bin: a row for every press heard within six seconds
    of a check, and one without a press for each bin in which the watermark shows that there was none. Both
    inputs carry ``ts``."""
    bins = covered(F.col("check_ms"), F.col("check_ms") + CHECK_MS, CHECK_MS)
    c = checks.withWatermark("ts", "10 seconds").withColumn("bin", F.explode(bins)).alias("c")
    p = presses.filter("kind = 'on'").withWatermark("ts", "10 seconds").withColumn(
        "bin", bin_of(F.col("t_ms"), CHECK_MS)).alias("p")
    cond = F.expr("c.session_id = p.session_id AND c.bin = p.bin AND p.ts >= c.ts "
                  "AND p.ts <= c.ts + INTERVAL 6 SECONDS")
    return c.join(p, cond, "leftOuter").select(
        F.col("c.session_id").alias("session_id"), F.col("c.check_ms").alias("check_ms"),
        F.col("c.target").alias("target"), F.col("p.pitch").alias("pitch"))


def check_results(heard: DataFrame) -> DataFrame:
    """One row per check from the rows of the stream."""
    return heard.groupBy("session_id", "check_ms", "target").agg(
        F.coalesce(F.bool_or(F.col("pitch") == F.col("target")), F.lit(False)).alias("ok"),
        F.count("pitch").alias("n_heard"))


# -- R7 ----------------------------------------------------------------------------------------

def job_tracker(events: DataFrame, now_ms: int | None = None) -> DataFrame:
    """R7 over ``(job_id, event_id, t_ms, status)`` with normalised status: the first end inside
    five minutes counts and closes the job; without one the job failed when the limit passed
    (``now_ms``; by default it has passed), otherwise it shows its latest status."""
    end = F.col("status").isin("COMPLETED", "FAILED")
    per = events.groupBy("job_id").agg(
        F.min("t_ms").alias("start_ms"),
        F.min(F.when(end, F.struct("t_ms", "event_id", "status"))).alias("end"),
        F.max(F.struct("t_ms", "event_id", "status")).alias("latest"))
    # Only the earliest end can lie inside the limit, so one aggregation decides.
    in_time = F.coalesce(F.col("end.t_ms") <= F.col("start_ms") + JOB_LIMIT_MS, F.lit(False))
    expired = F.lit(True) if now_ms is None else F.col("start_ms") + JOB_LIMIT_MS < now_ms
    status = (F.when(in_time, F.col("end.status")).when(expired, "FAILED")
              .otherwise(F.col("latest.status")))
    return per.select("job_id", status.alias("status"), (~in_time & expired).alias("timed_out"))


def job_tracker_stream(events: DataFrame) -> DataFrame:
    """R7 as keyed state with an event-time timer. ``events`` carries ``ts``; a job is reported once."""
    return stateful.job_tracker_stream(events, JOB_LIMIT_MS, JOB_KEEP_MS)


# -- R8 ----------------------------------------------------------------------------------------

def named_entries(entries: DataFrame) -> DataFrame:
    """Entries with the ``name`` they count under: one for each nickname, and an own one for every entry
    under the shared default name."""
    name = F.coalesce("nickname", F.lit(ANONYMOUS))
    return entries.withColumn("name", F.when(name == ANONYMOUS, F.concat(
        F.lit("#"), F.col("entry_id").cast("string"))).otherwise(F.concat(F.lit("@"), name)))


def leaderboard_table(spark: SparkSession, path: str) -> VersionedTable:
    """The stored board, replaced part by part."""
    schema = spark.createDataFrame([], stateful.BOARD).schema
    return VersionedTable(spark, path, schema, ["song", "part"], 8)


def follow_leaderboard(entries: DataFrame, board: VersionedTable, checkpoint: str, k: int = 3) -> None:
    """Brings the board up to date with the entries that have come. After every batch it holds the best of
    the input so far; a repeated batch changes nothing."""
    with stateful.rocksdb(entries.sparkSession):
        merge_stream(stateful.board_changes(named_entries(entries), k), board, checkpoint,
                     stateful.replaced_parts, "update")


def live_leaderboard(entries: DataFrame, k: int = 3) -> DataFrame:
    """The top ``k`` of each song; the earliest entry of a name counts, by time, then id."""
    spark = entries.sparkSession
    board = leaderboard_table(spark, new_path(spark, "leaderboard")).create()
    follow_leaderboard(entries, board, new_path(spark, "leaderboard-cp"), k)
    return stateful.board_top(board.read(), k)


# -- R9 ----------------------------------------------------------------------------------------

def press_windows(presses: DataFrame, width: str = "1 minute", late: str = "30 seconds") -> DataFrame:
    """Presses per tumbling window (``presses`` carries ``ts``)."""
    return (presses.filter("kind = 'on'").withWatermark("ts", late)
            .groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"))
            .select(F.unix_millis("w.start").alias("from_ms"), F.unix_millis("w.end").alias("to_ms"),
                    "n"))


def press_sessions(presses: DataFrame, gap: str = "5 seconds", late: str = "30 seconds") -> DataFrame:
    """Bursts of presses per session, split at pauses of ``gap``."""
    return (presses.filter("kind = 'on'").withWatermark("ts", late)
            .groupBy("session_id", F.session_window("ts", gap).alias("w"))
            .agg(F.count("*").alias("n"))
            .select("session_id", F.unix_millis("w.start").alias("from_ms"),
                    F.unix_millis("w.end").alias("to_ms"), "n"))


def with_ts(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ts", F.timestamp_millis("t_ms"))
