"""What the keyed state keeps of sessions that are done, and how a board's names are stored."""

from pyspark.sql import functions as F

from stavemill.sources import performances as PF
from stavemill.sources.storage import new_path
from stavemill.streaming import folds as FO
from stavemill.streaming import sessions as SS
from stavemill.streaming import stateful as ST

PLAN = '{"notes": ["C4", "D4"]}'


def put(spark, src, *batch):
    rows = [(s, seq, "on" if p else "start", p, None if p else PLAN, None) for s, seq, p in batch]
    (spark.createDataFrame(rows, PF.MESSAGE_SCHEMA).withColumn("started_at", F.timestamp_millis(F.lit(10_000_000)))
     .coalesce(1).write.mode("append").parquet(src))


def state(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(path)


def test_plans_of_sessions_that_are_done_are_not_kept(spark):
    src, path = new_path(spark, "src"), new_path(spark, "run")
    run = lambda: SS.run_available(FO.grades(
        spark.readStream.schema(PF.MESSAGE_SCHEMA).parquet(src), "wait"), "run", "update", path)
    put(spark, src, (1, 0, None), (1, 1, "C4"), (1, 2, "D4"), (2, 0, None), (2, 1, "C4"))
    run()
    assert [r.key.session_id for r in state(spark, f"{path}/cp", "steps").collect()] == [2]
    put(spark, src, (2, 2, "D4"), (1, 3, "D4"))
    out = FO.latest_results(run())
    assert sorted(map(tuple, out.collect())) == [(1, 4, 2, 0, True), (2, 3, 2, 0, True)]
    assert state(spark, f"{path}/cp", "steps").count() == 0


def test_names_of_a_board_share_entries(spark):
    """Two names of one chunk and part; an earlier entry of a name on the board changes its place."""
    src, cp = new_path(spark, "entries"), new_path(spark, "cp")
    names = [r.n for r in spark.range(400_000).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("n")).where(
        (F.pmod(F.xxhash64(F.concat(F.lit("@"), "n")), F.lit(ST.PARTS)) == 3)
        & (F.crc32(F.concat(F.lit("@"), "n")) % 4096 == 7)).limit(2).collect()]
    board = SS.leaderboard_table(spark, new_path(spark, "board")).create()
    schema = "entry_id bigint, song string, nickname string, score double, created_at timestamp_ntz"

    def follow(*entries):
        at = F.timestamp_seconds("at").cast("timestamp_ntz")
        (spark.createDataFrame(entries, schema.replace("created_at timestamp_ntz", "at bigint"))
         .withColumn("created_at", at).drop("at").coalesce(1).write.mode("append").parquet(src))
        SS.follow_leaderboard(spark.readStream.schema(schema).parquet(src), board, cp, 1)
        return [(r.nickname, r.score, r.entry_id) for r in ST.board_top(board.read(), 1).collect()]

    assert follow((1, "a", names[0], 5.0, 100), (2, "a", names[1], 9.0, 100)) == [(names[1], 9.0, 2)]
    assert follow((3, "a", names[1], 1.0, 50), (4, "a", names[0], 99.0, 200)) == [(names[0], 5.0, 1)]
    assert state(spark, cp, "firsts").count() == 1
