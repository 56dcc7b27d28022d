"""Batch and stream give the same results; restarts and late rows behave."""

from pyspark.sql import functions as F

from stavemill.sources import midi as MD
from stavemill.sources import performances as PF
from stavemill.sources.storage import new_path
from stavemill.streaming import folds as FO
from stavemill.streaming import sessions as SS

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_grading_survives_restarts_and_file_order(spark):
    messages = PF.performance_messages(spark, SF)
    src, path = new_path(spark, "src"), new_path(spark, "run")
    half = F.col("seq") < 60
    messages.filter(half).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: FO.grades(spark.readStream.schema(messages.schema)
                                     .option("maxFilesPerTrigger", 1).parquet(src), "performance")
    SS.run_available(stream(), "run", "update", path)
    messages.filter(~half).coalesce(1).write.mode("append").parquet(src)
    got = FO.latest_results(SS.run_available(stream(), "run", "update", path))
    assert rows(got) == rows(FO.grades(messages, "performance"))


def test_wait_and_quiz_streams_equal_batch(spark):
    for mode, messages in (("wait", PF.wait_messages(spark, SF)), ("quiz", PF.quiz_messages(spark, SF))):
        src = new_path(spark, mode)
        messages.write.parquet(src)
        stream = spark.readStream.schema(messages.schema).parquet(src)
        got = FO.latest_results(SS.run_available(FO.grades(stream, mode), mode, "update"))
        assert rows(got) == rows(FO.grades(messages, mode))


def _files(spark, name, *batches):
    """One file per batch, read one at a time in write order."""
    src = new_path(spark, name)
    schema = "session_id bigint, seq bigint, t_ms bigint, kind string, pitch string"
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(src)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_late_rows_are_dropped_by_the_watermark(spark):
    press = lambda seq, t: (1, seq, t, "on", "C4")
    # Late rows are judged by the watermark the previous batch started with.
    s = _files(spark, "late", [press(0, 1_000), press(1, 200_000)], [press(3, 201_000)], [press(2, 2_000)])
    out = SS.run_available(SS.press_windows(SS.with_ts(s)), "w", "update")
    got = {r.from_ms: r.n for r in out.groupBy("from_ms").agg(F.max("n").alias("n")).collect()}
    assert got == {0: 1, 180_000: 2}


def test_repeated_messages_do_not_extend_a_hold(spark):
    ev = [(1, 0, 10, "on", "C4"), (1, 1, 20, "on", "C4"), (1, 2, 30, "off", "C4"), (1, 3, 40, "off", "C4"),
          (1, 4, 50, "on", "C4")]
    schema = "session_id bigint, seq bigint, t_ms bigint, kind string, pitch string"
    batch = SS.held_notes(spark.createDataFrame(ev, schema))
    assert rows(batch) == [(1, "C4", 10, 30), (1, "C4", 50, None)]
    out = SS.run_available(SS.held_notes_stream(_files(spark, "held", ev[:2], ev[2:])), "held")
    assert rows(out) == [(1, "C4", 10, 30)]


def test_job_tracker(spark):
    schema = "job_id bigint, event_id bigint, t_ms bigint, status string"
    # Times start above zero: a row at the initial watermark (0) counts as late.
    ev = [(1, 0, 500, "IN_QUEUE"), (1, 1, 1000, "COMPLETED"), (1, 2, 2000, "FAILED"),
          (2, 3, 500, "IN_QUEUE"), (2, 4, 400_000, "COMPLETED"), (3, 5, 500, "IN_PROGRESS")]
    df = spark.createDataFrame(ev, schema)
    assert rows(SS.job_tracker(df)) == [(1, "COMPLETED", False), (2, "FAILED", True), (3, "FAILED", True)]
    assert rows(SS.job_tracker(df, now_ms=10_000))[2] == (3, "IN_PROGRESS", False)
    src = new_path(spark, "jobs")
    for batch in (ev[:3] + ev[3:4] + ev[5:], [(9, 7, 2_000_000, "IN_QUEUE")], ev[4:5]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = SS.run_available(SS.job_tracker_stream(SS.with_ts(stream)), "jobs")
    assert rows(out) == [(1, "COMPLETED", False), (2, "FAILED", True), (3, "FAILED", True)]


def test_job_that_ends_after_its_limit_is_reported_once(spark):
    schema = "job_id bigint, event_id bigint, t_ms bigint, status string"
    src = new_path(spark, "jobs")
    for batch in ([(1, 0, 500, "IN_QUEUE")], [(9, 1, 2_000_000, "IN_QUEUE")], [(9, 2, 2_010_000, "IN_QUEUE")],
                  [(1, 3, 2_050_000, "COMPLETED")], [(9, 4, 2_060_000, "IN_QUEUE")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = SS.run_available(SS.job_tracker_stream(SS.with_ts(stream)), "jobs")
    assert [r for r in rows(out) if r[0] == 1] == [(1, "FAILED", True)]


def test_leaderboard_does_not_depend_on_batches(spark):
    schema = "entry_id bigint, song string, nickname string, score double, created_at timestamp"
    e = lambda i, n, s: (i, "a", n, s, None)
    entries = [e(1, "kim", 10.0), e(2, "익명", 5.0), e(3, "kim", 99.0), e(4, "익명", 7.0), e(5, "lee", 1.0)]
    want = [("kim", 10.0), ("익명", 7.0), ("익명", 5.0)]
    for n in (1, 2, 5):
        src = new_path(spark, "entries")
        for start in range(0, 5, -(-5 // n)):
            spark.createDataFrame(entries[start:start + -(-5 // n)], schema).coalesce(1).write.mode(
                "append").parquet(src)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
        top = SS.live_leaderboard(stream, 3).orderBy("rank").collect()
        assert [(r.nickname, r.score) for r in top] == want


def test_closed_streams_match_batch(spark):
    from stavemill.plans.registry import QUERIES
    for name in ("r06_connection_check", "r07_job_tracker", "r09_press_sessions"):
        assert rows(QUERIES[name + "_stream"](spark, SF)) == rows(QUERIES[name](spark, SF)), name


def test_midi_decoding(spark):
    ev = [(1, 0, 0, 0x93, 60, 64), (1, 1, 0, 0x90, 60, 0), (1, 2, 0, 0x8F, 61, 5), (1, 3, 0, 0xB0, 60, 9)]
    df = spark.createDataFrame(ev, MD.MIDI_SCHEMA)
    assert [(r.kind, r.pitch) for r in MD.decode_midi(df).orderBy("seq").collect()] == [
        ("on", "C4"), ("off", "C4"), ("off", "C#4")]
