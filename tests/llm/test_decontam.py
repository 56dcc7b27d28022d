import random
from collections import Counter

from pyspark.sql import functions as F
from stavemill.llm import decontam as D

from .conftest import clashing


def shingles(words, k):
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = (text or "").lower().split()
        for i, item in items:
            v = (item or "").lower().split()
            k = min(5, len(v))
            own = Counter(shingles(v, k))
            for s in range(len(w) - len(v) + 1) if v else ():
                win = Counter(shingles(w[s:s + len(v)], k))
                both = sum((own & win).values())
                sim = both / (2 * sum(own.values()) - both)
                if sim >= 0.8:
                    out[d, i] = max(out.get((d, i), 0), sim)
    return out


def test_against_all_windows(spark, docs):
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(80)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 6, 20, 20, 50]))))
             for i in range(14)] + [(20, None), (21, " "), (22, "w1 " * 12)]
    rows = []
    for d in range(80):
        words = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        for _, item in rng.sample(items[:14] + items[-1:], 2):
            passage = item.split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(passage)) if passage else 0
                passage[at:at + 1] = rng.choice([[], ["new"], passage[at:at + 1] + ["new"]])
            at = rng.randint(0, len(words))
            words[at:at] = [p.upper() if rng.random() < 0.2 else p for p in passage]
        rows.append((d, "\n ".join(words)))
    got = D.contaminated(docs(rows).select("doc_id", "text"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id) for r in got} == set(want)
    for r in got:
        assert abs(r.similarity - want[r.doc_id, r.item_id]) < 1e-9


def test_reordered_passages(spark, docs):
    rng = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([59, 40, 41, 50, 59])]
    rows = []
    for i, item in items:
        v = item.split()
        for half in (len(v) // 2, len(v) // 3, 7):
            for pad in (0, 1, 70):
                noise = [rng.choice(vocab) for _ in range(pad)]
                rows.append((len(rows), " ".join(noise + v[half:] + v[:half] + noise)))
        a, b = len(v) // 4, len(v) // 2
        rows.append((len(rows), " ".join(["x"] * 30 + v[a:b] + v[:a] + v[b:])))
    got = D.contaminated(docs(rows).select("doc_id", "text"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute(rows, items)
    assert len(want) >= 30
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {
        k: round(v, 9) for k, v in want.items()}


def test_documents_shorter_than_the_item(spark, docs):
    rng = random.Random(6)
    items = [(i, " ".join(f"u{rng.randrange(3000)}" for _ in range(n))) for i, n in enumerate([59, 40, 20, 9, 4])]
    rows, want = [], {}
    for i, item in items:
        v = item.split()
        for cut in range(1, min(16, len(v))):
            for w in (v[:-cut], v[cut:], v[cut // 2:len(v) - cut + cut // 2]):
                a, b = Counter(shingles(v, min(5, len(v)))), Counter(shingles(w, min(5, len(v))))
                both = sum((a & b).values())
                sim = both / (sum(a.values()) + sum(b.values()) - both)
                if sim >= 0.8:
                    want[len(rows), i] = round(sim, 9)
                rows.append((len(rows), " ".join(w)))
    got = D.contaminated(docs(rows).select("doc_id", "text"),
                         spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(want) >= 50
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert {r.first_word for r in got} == {0}


def test_fingerprint_is_the_bitwise_majority(spark):
    rng = random.Random(2)
    hashes = [[rng.randrange(-2**63, 2**63) for _ in range(n)] for n in (1, 2, 7, 300)]
    df = spark.createDataFrame([(h,) for h in hashes], "h array<long>")
    for r in D.with_fingerprint(df, "h").collect():
        want = sum(1 << b for b in range(64)
                   if 2 * sum((h >> b) & 1 for h in r.h) > len(r.h))
        assert r.fp & (2**64 - 1) == want


def test_blocks_find_everything_within_the_radius():
    rng = random.Random(1)
    masks = set(D.near_values())
    for _ in range(300):
        x = 0
        for b in rng.sample(range(64), D.RADIUS):
            x |= 1 << b
        assert any((x >> (8 * i)) & 255 in masks for i in range(D.BLOCKS))


def test_defined_cases(spark, docs, folder):
    item = " ".join(f"i{k}" for k in range(15))
    bench = spark.createDataFrame([(1, item), (2, item), (None, None)], "item_id long, text string")
    sf = folder(benchmark=bench)
    rows = [(1, None), (2, ""), (3, "x " * 50_000 + item), (3, "x " * 50_000 + item), (4, "fine text"),
            (None, "other text")]
    df = clashing(docs(rows))
    out = D.pipeline_stage(spark, df, sf)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "2", "4", "None"]
    pairs = D.contaminated(df.select("doc_id", "text"), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.first_word) for r in pairs) == [(3, 1, 50_000), (3, 2, 50_000)]
    assert D.pipeline_stage(spark, docs([]), sf).count() == 0
    none = D.contaminated(df.select("doc_id", "text"), bench.limit(0))
    assert none.count() == 0 and none.columns == ["doc_id", "item_id", "similarity", "first_word"]


def test_clean_rows_stay_beside_contaminated_ones_of_their_id(spark, docs, folder):
    item = " ".join(f"i{k}" for k in range(15))
    sf = folder(benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    rows = [(None, item), (None, "a clean text"), (None, None), (5, "x " + item), (5, "clean too"), (5, item)]
    out = D.pipeline_stage(spark, docs(rows), sf).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == [
        ("5", "clean too"), ("None", "None"), ("None", "a clean text")]
