"""Counts taken while rows pass, and sketches that merge."""

import json
import random

from pyspark.sql import Observation
from pyspark.sql import functions as F

from stavemill.operators import stats as ST
from stavemill.sources import labels as LB
from stavemill.sources.storage import new_path


def label_files(spark, tmp_path):
    good = [json.dumps({"id": str(i), "tokens": ["<SOS>", "a", "<EOS>"]}) for i in range(5)]
    lines = good + ['{"id": "9", "tokens": []}', '{"id": "10", "tok', '{"id": "11", "tokens": ["<PAD>"]}']
    (tmp_path / "labels.json").write_text("\n".join(lines))
    return str(tmp_path)


WANT = {"rows": 8, "read": 5, "unreadable": 1, "empty": 2}


def test_label_counts_come_with_the_read(spark, tmp_path):
    seen = Observation()
    spark.sparkContext.setJobGroup("counted", "")
    LB.counted_labels(LB.read_labels(spark, label_files(spark, tmp_path)), seen).write.format("noop").mode(
        "overwrite").save()
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    assert seen.get == WANT
    assert jobs == 1 == len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    spark.sparkContext.setJobGroup("", "")


def test_label_counts_of_a_stream_come_with_each_batch(spark, tmp_path):
    stream = LB.counted_labels(LB.read_labels(spark, label_files(spark, tmp_path), stream=True), "labels")
    q = stream.writeStream.format("noop").option("checkpointLocation", new_path(spark, "cp")).trigger(
        availableNow=True).start()
    q.awaitTermination()
    assert [p.observedMetrics["labels"].asDict() for p in q.recentProgress if p.numInputRows] == [WANT]


def test_orphans_are_counted_while_pairing(spark):
    images = spark.createDataFrame([("/a.png",), ("/b.png",), ("/x.gif",)], "path string")
    labels = spark.createDataFrame([("/a.json",), ("/c.json",), ("/d.json",)], "path string")
    seen = Observation()
    LB.counted_pairs(LB.pair_manifest(images, labels), seen).collect()
    assert seen.get == {"rows": 4, "pair": 1, "image_only": 1, "label_only": 2}


def test_merged_sketches_stay_within_their_bound(spark):
    rng = random.Random(4)
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    values = [(i % 23, int(rng.paretovariate(0.7) * 100) if i % 2 else rng.randint(0, 9)) for i in range(60_000)]
    df = spark.createDataFrame(values + [(1, None)], "part int, v bigint")
    one = ST.merged_quantiles(ST.quantile_sketches(df, "v"), probs)
    many = ST.merged_quantiles(ST.quantile_sketches(df, "v", "part"), probs)
    for merged in (one, many):
        assert merged.first()["n"] == 60_000
        errors = ST.rank_errors(df, "v", merged, probs).collect()
        assert {r["name"] for r in errors} == set(probs) and max(r.error for r in errors) <= ST.KLL_ERROR
    # A part that comes later is merged with the stored sketches.
    first = ST.quantile_sketches(df.where("part < 20"), "v", "part")
    later = ST.quantile_sketches(df.where("part >= 20"), "v", "part")
    grown = ST.merged_quantiles(first.unionByName(later), probs)
    assert max(r.error for r in ST.rank_errors(df, "v", grown, probs).collect()) <= ST.KLL_ERROR
    assert ST.merged_quantiles(ST.quantile_sketches(df.where("v < 0"), "v", "part"), probs).count() == 0
    few = spark.createDataFrame([(1, x) for x in (5, 1, 3)], "part int, v bigint")
    assert ST.merged_quantiles(ST.quantile_sketches(few, "v", "part"), {"m": 0.5}, "part").first()["m"] == 3
