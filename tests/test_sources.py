"""Files in and out."""

import json

from pyspark.sql import functions as F

from stavemill.functions import vocab
from stavemill.operators import library as L
from stavemill.sources import labels as LB
from stavemill.sources import storage


def test_labels_from_single_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(
        {"id": "x", "tokens": ["<SOS>", "note-C4", "<EOS>"], "system_breaks": [1]}))
    (tmp_path / "b.json").write_text("{broken")
    (tmp_path / "c.json").write_text(json.dumps({"id": "c", "tokens": ["<SOS>"]}))
    r = LB.read_labels(spark, str(tmp_path), one_per_file=True).cache()
    assert {x.score_id: x.skipped for x in r.collect()} == {"a": None, "b": "unreadable", "c": "empty"}
    assert [(x.score_id, x.tokens, x.system_breaks) for x in LB.usable_labels(r).collect()] == [
        ("a", ["note-C4"], [1])]
    assert {x.outcome: x.n for x in LB.skip_report(r).collect()} == {"read": 1, "unreadable": 1, "empty": 1}


def test_manifest_and_uploads_from_a_folder(spark, tmp_path):
    for name in ("a.png", "b.JPG", "c.gif", "a.json", "d.json", "a_staffs.json"):
        (tmp_path / name).write_bytes(b"x")
    files = LB.list_files(spark, str(tmp_path))
    got = {r.stem: r.status for r in LB.pair_manifest(files, files).collect()}
    assert got == {"a": "pair", "b": "image_only", "d": "label_only"}
    big = files.withColumn("length", F.when(F.col("path").endswith("a.png"), 10 * 1024 * 1024 + 1)
                           .otherwise(F.col("length")))
    assert [LB_stem(r.path) for r in LB.valid_uploads(big).collect()] == ["b", "c"]


def LB_stem(path):
    return path.rsplit("/", 1)[1].rsplit(".", 1)[0]


def test_vocabulary_file(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({t: i for i, t in enumerate(vocab.vocabulary())}))
    v = {r.token: r.id for r in vocab.load_vocab(spark, str(tmp_path / "v.json")).collect()}
    assert v == {r.token: r.id for r in vocab.vocab_dim(spark).collect()}


def test_markov_file_default_limit(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"table": {"-1": 0.25, "2": 0.75}}')
    got = {r.interval: (r.prob, r.max_interval) for r in LB.read_markov(spark, str(tmp_path)).collect()}
    assert got == {-1: (0.25, 14), 2: (0.75, 14)}


def test_upsert_keeps_places_and_puts_new_scores_first(spark):
    schema = "id bigint, title string, updated_at bigint"
    lib = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], schema).withColumn("list_pos", F.col("id"))
    new = spark.createDataFrame([(2, "B", 5), (3, "c", 6), (4, "d", 7), (4, "D", 8)], schema)
    rows = L.upsert_scores(lib, new).orderBy("list_pos").collect()
    assert [(r.id, r.title) for r in rows] == [(4, "D"), (3, "c"), (1, "a"), (2, "B")]


def test_shared_folder_is_the_one_the_session_names(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_stored_labels_need_no_exchange(spark):
    from stavemill.operators import evaluate as EV
    from stavemill.operators import repair as R
    from stavemill.plans.evaluate_queries import stored
    from stavemill.sources import fixtures as fx
    d = "/root/testdata/sf0.001"
    truth = stored(spark, fx.tokens(spark, d), "truth", 6)
    pred = stored(spark, fx.predictions(spark, d), "pred", 6)
    repaired = R.repair(LB.stored_tokens(truth))
    for df in (repaired, EV.measure_ter(EV.stack_labels(pred, truth))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Bucketed: true" in plan
    want = sorted(map(tuple, R.repair(fx.tokens(spark, d)).collect()))
    assert sorted(map(tuple, repaired.collect())) == want
