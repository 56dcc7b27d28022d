"""Keyed state: what it holds, what a batch costs, what late or missing messages do."""

import random

from pyspark.sql import functions as F

from stavemill.operators.practice import leaderboard_topk
from stavemill.sources import performances as PF
from stavemill.sources.storage import new_path
from stavemill.streaming import folds as FO
from stavemill.streaming import sessions as SS
from stavemill.streaming import stateful as ST

SF = "/root/testdata/sf0.001"
PLAN = '{"notes": ["C4", "D4", "E4", "F4"]}'


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def message(seq, pitch, kind="on", session=1, start=0):
    at = 10_000_000 + start
    return session, seq, kind, pitch, PLAN if kind == "start" else None, at


def stream_of(spark, src):
    return (spark.readStream.schema(PF.MESSAGE_SCHEMA).option("maxFilesPerTrigger", 1).parquet(src))


def put(spark, src, batch):
    schema = PF.MESSAGE_SCHEMA.replace("started_at timestamp", "at bigint")
    (spark.createDataFrame(batch, schema).withColumn("started_at", F.timestamp_millis("at")).drop("at")
     .coalesce(1).write.mode("append").parquet(src))


def state(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/cp")


def test_messages_in_any_order_equal_the_batch(spark):
    """Files of random messages, the plan often last."""
    for mode, made in (("performance", PF.performance_messages), ("wait", PF.wait_messages),
                       ("quiz", PF.quiz_messages)):
        # All at one time: sessions that started hours apart are not open together.
        messages = made(spark, SF).where("session_id % 3 < 2").withColumn("started_at", F.timestamp_seconds(F.lit(9)))
        src = new_path(spark, mode)
        for part in messages.randomSplit([1.0] * 4, seed=5):
            part.orderBy(F.rand(3)).coalesce(1).write.mode("append").parquet(src)
        out = SS.run_available(FO.grades(stream_of(spark, src), mode), mode, "update")
        assert rows(FO.latest_results(out)) == rows(FO.grades(messages, mode)), mode
        assert out.agg(F.max("late")).first()[0] == 0


def test_state_holds_only_what_is_out_of_order(spark):
    src, path = new_path(spark, "src"), new_path(spark, "run")
    run = lambda: SS.run_available(FO.grades(stream_of(spark, src), "wait"), "run", "update", path)
    put(spark, src, [message(0, None, "start"), message(1, "C4"), message(2, "D4"), message(5, "X4")])
    run()
    waiting = state(spark, path, "waiting").collect()
    assert [tuple(r.user_map_key) + tuple(r.user_map_value) for r in waiting] == [(5, "on", "X4")]
    place = state(spark, path, "fold").first().value
    assert (place.next, place.seen, place.right, place.wrong, place.waiting) == (3, 4, 2, 0, 1)
    # A restart goes on from there: the gap closes, a repeated and an overtaken message are late.
    put(spark, src, [message(3, "A4"), message(4, "E4"), message(2, "D4"), message(5, "F4")])
    out = run()
    last = FO.latest_results(out).first()
    assert (last.seen, last.correct, last.wrong, last.done) == (8, 3, 2, False)
    assert out.agg(F.max("late")).first()[0] == 2
    assert state(spark, path, "waiting").count() == 0


def test_sessions_end_by_event_time_and_late_rows_are_counted(spark):
    src, path, progress = new_path(spark, "src"), new_path(spark, "run"), []
    later = 3 * ST.KEEP_MS
    for batch in ([message(0, None, "start"), message(1, "C4"), message(3, "E4"), message(4, "D4")],
                  [message(0, None, "start", 2, later)], [message(1, "C4", "on", 2, later)],
                  [message(2, "D4")], [message(2, "D4", "on", 2, later)]):
        put(spark, src, batch)
    out = SS.run_available(FO.grades(stream_of(spark, src), "wait"), "run", "update", path, progress)
    # The gap at 2 never closed: what waited was folded at the end of the session.
    assert (1, 4, 2, 1, False) in rows(FO.latest_results(out))
    assert {r.key.session_id for r in state(spark, path, "fold").collect()} == {2}
    assert sum(op.numRowsDroppedByWatermark for p in progress for op in p.stateOperators) == 1


def test_open_holds_are_forgotten_after_a_day(spark):
    schema = "session_id bigint, seq bigint, t_ms bigint, kind string, pitch string"
    src, path, day = new_path(spark, "held"), new_path(spark, "run"), ST.HOLD_KEEP_MS
    for batch in ([(1, 0, 1000, "on", "C4"), (2, 0, 1000, "on", "C4"), (2, 1, 3000, "off", "C4")],
                  [(3, 0, 2 * day, "on", "D4")], [(3, 1, 2 * day + 5, "off", "D4")]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = SS.run_available(SS.held_notes_stream(stream), "held", "append", path)
    assert rows(out) == [(2, "C4", 1000, 3000), (3, "D4", 2 * day, 2 * day + 5)]
    assert state(spark, path, "since").count() == 0


def test_job_state_is_read_after_a_restart_and_closed_marks_leave(spark):
    schema = "job_id bigint, event_id bigint, t_ms bigint, status string"
    src, path = new_path(spark, "jobs"), new_path(spark, "run")
    run = lambda: SS.run_available(SS.job_tracker_stream(SS.with_ts(
        spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src))), "jobs", "append", path)

    def add(*batch):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(src)

    add((1, 0, 500, "IN_QUEUE"), (2, 1, 600, "IN_QUEUE"), (2, 2, 900, "COMPLETED"))
    run()
    held = {r.key.job_id: (r.value.closed, r.value.due) for r in state(spark, path, "job").collect()}
    assert held == {1: (False, 500 + SS.JOB_LIMIT_MS), 2: (True, 600 + SS.JOB_LIMIT_MS + SS.JOB_KEEP_MS)}
    add((1, 3, 700, "COMPLETED"), (2, 4, 1000, "FAILED"))
    assert rows(run()) == [(1, "COMPLETED", False), (2, "COMPLETED", False)]
    add((9, 5, 3 * SS.JOB_KEEP_MS, "IN_QUEUE"))
    add((9, 6, 3 * SS.JOB_KEEP_MS + 1, "IN_PROGRESS"))
    run()
    assert [r.key.job_id for r in state(spark, path, "job").collect()] == [9]


def test_board_equals_the_ranking_after_every_batch(spark):
    rng = random.Random(9)
    schema = "entry_id bigint, song string, nickname string, score double, created_at timestamp_ntz"
    entries = [(i, rng.choice("aaab"), rng.choice([f"p{rng.randint(0, 25)}", "익명", None]),
                rng.choice([None, float(rng.randint(0, 30))]), rng.randint(0, 200)) for i in range(240)]
    src, cp = new_path(spark, "entries"), new_path(spark, "cp")
    board = SS.leaderboard_table(spark, new_path(spark, "board")).create()
    so_far = []
    at = (F.timestamp_seconds("at").cast("timestamp_ntz"))
    for start in range(0, 240, 80):
        so_far += entries[start:start + 80]
        make = lambda part: spark.createDataFrame(part, schema.replace(
            "created_at timestamp_ntz", "at bigint")).withColumn("created_at", at).drop("at")
        make(entries[start:start + 80]).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        SS.follow_leaderboard(stream, board, cp, 4)
        first = {}
        for e in so_far:
            name = (e[1], e[2] if e[2] not in (None, "익명") else e[0])
            if name not in first or (e[4], e[0]) < (first[name][4], first[name][0]):
                first[name] = e
        want = leaderboard_topk(make(list(first.values())), 4).select("song", "rank", "entry_id", "score")
        got = ST.board_top(board.read(), 4)
        assert rows(got.select("song", "rank", "entry_id", "score")) == rows(want), start
    version = board.state()
    assert not board.merge(version[1], board.read().limit(1), ST.replaced_parts)
    assert board.state() == version
