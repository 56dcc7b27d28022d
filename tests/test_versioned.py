"""Micro-batches merged into versioned, bucketed tables."""

import itertools

from pyspark.sql import functions as F

from stavemill.operators import library as L
from stavemill.sources.storage import new_path
from stavemill.sources.versioned import VersionedTable, merge_stream

LIB = "id bigint, title string, updated_at bigint, list_pos bigint"
SAVE = "id bigint, title string, updated_at bigint"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def library(spark):
    return spark.createDataFrame([(i, f"t{i}", 0, i) for i in range(20)], LIB)


def test_result_does_not_depend_on_batches_or_their_order(spark):
    saves = [(3, "a", 5), (3, "b", 9), (99, "x", 4), (99, "y", 7), (98, "z", 6), (3, "old", 1)]
    want = {i: (f"t{i}", i) for i in range(20)} | {3: ("b", 3), 99: ("y", -4), 98: ("z", -6)}
    for n, batches in enumerate(([saves], [saves[:3], saves[3:]], [saves[3:], saves[:3]], [[s] for s in saves])):
        table = VersionedTable(spark, new_path(spark, "lib"), library(spark).schema, ["id"], 4).create(library(spark))
        for i, batch in enumerate(batches):
            assert table.merge(i, spark.createDataFrame(batch, SAVE), L.merge_saves)
        assert {r.id: (r.title, r.list_pos) for r in table.read().collect()} == want, n
    whole = L.merge_saves(library(spark), spark.createDataFrame(saves, SAVE))
    assert {r.id: (r.title, r.list_pos) for r in whole.collect()} == want


def test_repeated_batch_and_untouched_buckets(spark):
    table = VersionedTable(spark, new_path(spark, "lib"), library(spark).schema, ["id"], 8).create(library(spark))
    before, old_rows = table.state(), rows(table.read())
    save = spark.createDataFrame([(3, "new", 5)], SAVE)
    assert table.merge(0, save, L.merge_saves)
    after = table.state()
    changed = [b for b in after[2] if after[2][b] != before[2].get(b)]
    assert len(changed) == 1 and after[:2] == (1, 0)
    files = set(table.read().inputFiles())
    assert not table.merge(0, save.withColumn("title", F.lit("again")), L.merge_saves)
    assert table.state() == after and set(table.read().inputFiles()) == files
    assert rows(table.read(version=0)) == old_rows
    assert table.merge(1, save.limit(0), L.merge_saves)  # an empty batch is recorded, nothing rewritten
    assert table.state()[1] == 1 and set(table.read().inputFiles()) == files


def test_a_batch_that_failed_leaves_no_trace(spark):
    table = VersionedTable(spark, new_path(spark, "lib"), library(spark).schema, ["id"], 4).create(library(spark))
    want, save = rows(table.read()), spark.createDataFrame([(3, "new", 5)], SAVE)

    def broken(old, new):
        return L.merge_saves(old, new).withColumn("title", F.raise_error(F.lit("lost")).cast("string"))

    try:
        table.merge(0, save, broken)
        raise AssertionError("should fail")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert rows(table.read()) == want and table.state()[:2] == (0, -1)
    assert table.merge(0, save, L.merge_saves)
    assert ("new",) in {(r.title,) for r in table.read().collect()}


def test_stream_goes_on_after_a_restart(spark):
    src, cp = new_path(spark, "saves"), new_path(spark, "cp")
    table = VersionedTable(spark, new_path(spark, "lib"), library(spark).schema, ["id"], 4).create(library(spark))
    stream = lambda: spark.readStream.schema(SAVE).option("maxFilesPerTrigger", 1).parquet(src)
    seen = []
    for part in ([(1, "a", 3), (50, "p", 4)], [(50, "q", 5)], [(1, "c", 9), (51, "r", 8)]):
        spark.createDataFrame(part, SAVE).coalesce(1).write.mode("append").parquet(src)
        merge_stream(stream(), table, cp, L.merge_saves)
        seen.append(table.state()[1])
    assert seen == [0, 1, 2]
    assert {r.id: (r.title, r.list_pos) for r in table.read().collect() if r.title < "t"} == {
        1: ("c", 1), 50: ("q", -4), 51: ("r", -8)}


def test_any_split_of_a_key_stays_in_its_bucket(spark):
    schema = spark.createDataFrame([], "a bigint, b string, n bigint").schema
    table = VersionedTable(spark, new_path(spark, "t"), schema, ["a", "b"], 3).create()
    total = lambda old, new: old.unionByName(new).groupBy("a", "b").agg(F.sum("n").alias("n"))
    for i, (x, y) in enumerate(itertools.product((1, 2, None), ("u", None))):
        part = spark.createDataFrame([(x, y, 1), (1, "u", 1)], schema)
        table.merge(i, part, total)
    assert set(rows(table.read())) == {(1, None, 1), (1, "u", 7), (2, None, 1), (2, "u", 1), (None, None, 1), (None, "u", 1)}
