import corpus_pipeline
from stavemill.llm import decontam, minhash, mixing, quality, sharding


def test_stages_in_order():
    assert [f for _, f in corpus_pipeline.STAGES] == [
        quality.pipeline_stage, minhash.pipeline_stage, decontam.pipeline_stage, mixing.pipeline_stage,
        sharding.pipeline_stage]


def test_run_is_its_stages(spark, docs, folder):
    import random
    rng = random.Random(6)
    vocab = [f"word{i}." for i in range(400)]
    text = lambda: "\n".join(" ".join(rng.choice(vocab) for _ in range(15)) for _ in range(4))
    item = " ".join(f"item{i}" for i in range(20))
    good = [(i, text(), "ab"[i % 2]) for i in range(60)]
    copies = [(100 + i, good[0][1], "a") for i in range(5)]
    leaks = [(200 + i, text() + "\n" + item, "b") for i in range(3)]
    junk = [(300 + i, "\n".join("BUY!! $$$ NOW!! ### %% FREE!! && *** WIN!!" + f" {rng.random()}"
                                for _ in range(5)), "a") for i in range(20)]
    labels = [(i, 1) for i, _, _ in good] + [(i, 0) for i, _, _ in junk]
    df = docs(good + copies + leaks + junk)
    sf = folder(documents=df, labels=spark.createDataFrame(labels, "doc_id long, quality int"),
                benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    at, kept = df, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, sf)
        assert at.columns == df.columns
        kept.append({r.doc_id for r in at.select("doc_id").collect()})
    assert kept[0] == {i for i, _, _ in good + copies + leaks}
    assert kept[1] == {i for i, _, _ in good + leaks}
    assert kept[2] == {i for i, _, _ in good}
    out = corpus_pipeline.run(spark, sf)
    assert out.columns == df.columns + ["new_shard", "new_slot"]
    want = sorted(r.doc_id for r in at.select("doc_id").collect())
    assert sorted(r.doc_id for r in out.collect()) == want
    words = {i: len(t.split()) for i, t, _ in good}
    assert abs(sum(words[i] for i in want) - 1.5 * sum(words.values())) <= 120
