"""Raw keyboard bytes: ranges, growth, truncated records."""

import struct

import pytest

from stavemill.sources import raw_midi as RM
from stavemill.sources.storage import new_path
from stavemill.streaming import sessions as SS


def record(t, session=1, status=0x90, d1=60, d2=64):
    return struct.pack(">qiBBB", t, session, status, d1, d2)


@pytest.fixture()
def source(spark, tmp_path):
    spark.dataSource.register(RM.RawMidi)
    return lambda **files: [(tmp_path / f"{k}.raw").write_bytes(v) for k, v in files.items()] and str(tmp_path)


def times(df):
    return sorted((r.session_id, r.t_ms) for r in df.collect())


@pytest.mark.parametrize("size", [1, 15, 16, 44, 1 << 20])
def test_any_range_size_reads_every_record_once(spark, source, size):
    path = source(a=b"".join(record(t) for t in range(200)), b=record(7, 2), c=b"", d=record(9, 3) + b"\x00\x01")
    df = spark.read.format("raw_midi").option("rangeBytes", size).load(path)
    assert times(df) == [(1, t) for t in range(200)] + [(2, 7), (3, 9)]
    assert df.where("file like '%a.raw'").selectExpr("count(distinct at)", "max(at)").first()[:] == (200, 199 * 15)


def test_values_come_back(spark, source):
    path = source(a=record(-5, -1, 255, 0, 127) + record(1 << 60, 2**31 - 1, 0x80, 1, 2))
    got = spark.read.format("raw_midi").load(path).drop("file", "at").orderBy("t_ms").collect()
    assert [tuple(r) for r in got] == [(-1, -5, 255, 0, 127), (2**31 - 1, 1 << 60, 128, 1, 2)]
    again = new_path(spark, "raw")
    for _ in range(2):
        spark.createDataFrame(got).write.format("raw_midi").mode("append").save(again)
    assert spark.read.format("raw_midi").load(again).count() == 4


def test_growing_files_and_a_truncated_record(spark, source, tmp_path):
    whole = [record(t) for t in range(10)]
    path, run = source(a=b"".join(whole[:3]) + whole[3][:8]), new_path(spark, "run")
    read = lambda: times(SS.run_available(
        spark.readStream.format("raw_midi").option("rangeBytes", 30).load(path), "raw", path=run))
    assert read() == [(1, 0), (1, 1), (1, 2)]
    (tmp_path / "a.raw").write_bytes(b"".join(whole[:6]))
    (tmp_path / "b.raw").write_bytes(record(50, 2))
    assert read() == [(1, t) for t in range(6)] + [(2, 50)]
    assert read() == [(1, t) for t in range(6)] + [(2, 50)]


def test_an_empty_or_missing_folder(spark, source, tmp_path):
    spark.dataSource.register(RM.RawMidi)
    assert spark.read.format("raw_midi").load(f"{tmp_path}/none").count() == 0
