import itertools
import random

import pytest
from pyspark.sql import functions as F
from stavemill.llm import sharding as S

from .conftest import clashing


def test_flow_costs_what_brute_force_costs():
    rng = random.Random(1)
    for _ in range(30):
        supply = [rng.randint(0, 4) for _ in range(3)]
        room = [rng.randint(0, 4) for _ in range(3)]
        room[0] += max(0, sum(supply) - sum(room))
        cost = [[rng.randint(0, 5) for _ in range(3)] for _ in range(3)]
        flow = S.min_cost_flow(supply, room, cost)
        assert [sum(r) for r in flow] == supply
        assert all(sum(flow[i][j] for i in range(3)) <= room[j] for j in range(3))
        units = [i for i, n in enumerate(supply) for _ in range(n)]
        best = min((sum(cost[i][j] for i, j in zip(units, to))
                    for to in itertools.product(range(3), repeat=len(units))
                    if all(to.count(j) <= room[j] for j in range(3))), default=0)
        assert sum(flow[i][j] * cost[i][j] for i in range(3) for j in range(3)) == best
    with pytest.raises(ValueError):
        S.min_cost_flow([2], [1], [[0]])


def sharded(df):
    crc = F.crc32(F.coalesce("text", F.lit("")))
    rows = S.shard_documents(df, S.text_bytes(F.col("text")), crc)
    return S.with_slots(rows, F.col("row.doc_id"), F.col("row.text"))


def test_even_gapless_and_fewest_bytes(spark, docs):
    rng = random.Random(2)
    rows = [(i, "é" * rng.randint(0, 60), rng.choice("aaabcdef")) for i in range(3000)]
    got = sharded(docs(rows)).select("row.doc_id", "old", "shard", "slot", "bytes").collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    size = [sum(r.bytes for r in got if r.shard == k) for k in range(8)]
    mean = sum(size) / 8
    assert max(abs(x - mean) for x in size) <= 8 * 121
    for k in range(8):
        own = [r.slot for r in got if r.shard == k]
        assert sorted(own) == list(range(len(own)))
    # Only what a shard holds beyond its capacity has to leave it.
    moved = sum(r.bytes for r in got if r.old != r.shard)
    held = [sum(r.bytes for r in got if r.old == k) for k in range(8)]
    assert abs(moved - sum(max(0, h - mean) for h in held)) <= 16 * 121
    again = sharded(docs(rows).repartition(5)).select("row.doc_id", "shard", "slot").collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {r.doc_id: (r.shard, r.slot) for r in again}


def test_defined_cases(spark, docs):
    assert sharded(docs([])).count() == 0
    rows = [(None, None, None), (1, ""), (1, ""), (2, "x" * 500_000), (3, "y")]
    got = sharded(clashing(docs(rows))).collect()
    assert sorted(r.bytes for r in got) == [1, 1, 1, 2, 500_001]
    assert all(r.shard is not None and r.slot is not None for r in got)


def test_rewrite_touches_changed_shards_only(spark, docs, tmp_path):
    df = docs([(i, "t" * 20, "abcdefghijkl"[i % 12]) for i in range(600)])
    rows = S.shard_documents(df, S.text_bytes(F.col("text")), F.crc32("text"))
    touched = S.rewrite(rows, str(tmp_path / "out"))
    changed = rows.where("old <> shard").select("old", "shard").collect()
    assert set(touched) == {x for r in changed for x in (r.old, r.shard)}
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {r.new_shard for r in back.select("new_shard").distinct().collect()} <= set(touched)
    assert back.count() == rows.where(F.col("shard").isin(touched)).count()
    assert S.pipeline_stage(spark, df, "").columns == df.columns + ["new_shard", "new_slot"]


def test_added_columns_never_clash(spark, docs, tmp_path):
    df = docs([(i, "t" * i, "ab"[i % 2]) for i in range(40)]).withColumn("new_shard", F.lit("x")).withColumn(
        "NEW_SLOT", F.lit("y"))
    out = S.pipeline_stage(spark, df, "")
    assert out.columns == df.columns + ["_new_shard", "_new_slot"]
    out.write.parquet(str(tmp_path / "stage"))
    rows = S.shard_documents(df, S.text_bytes(F.col("text")), F.crc32("text"))
    S.rewrite(rows, str(tmp_path / "out"))
    assert set(spark.read.parquet(str(tmp_path / "out")).columns) == {*df.columns, "_new_shard"}
