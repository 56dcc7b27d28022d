import gzip
import hashlib
import io
import random

import pytest
from pyspark.sql import functions as F
from stavemill.llm import warc as W
from stavemill.llm.common import staged


def records(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        payload = "".join(rng.choice(["a", "é", "\x1f", "\r\n\r\n", "WARC/1.1", "<p>"])
                          for _ in range(rng.choice([0, 5, 300, 30_000]))).encode()
        out.append(W.record(i, f"http://h/{i}", payload, hashlib.sha1(payload).hexdigest(), None))
    return out


def test_any_split_reads_every_record_once():
    parts = records(1, 40)
    data = b"".join(parts)
    assert gzip.decompress(data).count(b"WARC-Record-ID") == 40
    for step in (1 << 30, 100_000, 997, 64):
        ids = [W.parsed(r)[0] for a in range(0, len(data), step)
               for r in W.range_records(io.BytesIO(data), a, min(len(data), a + step))]
        assert ids == list(range(40))


def test_members_just_before_a_border_of_large_archives():
    rng = random.Random(4)
    words = ["<div class=x>", "<p>some text</p>", "<a href=/y>", "page", "é"]
    parts = []
    for i in range(60):
        payload = rng.randbytes(100_000) + " ".join(rng.choice(words) for _ in range(2000)).encode()
        parts.append(W.record(i, f"http://h/{i}", payload, hashlib.sha1(payload).hexdigest(), None))
    data = b"".join(parts)
    starts = [sum(map(len, parts[:i])) for i in range(60)]
    assert len(data) > W.SPLIT_BYTES + (1 << 20)
    member = next(a for a in starts if a > W.SPLIT_BYTES)
    for before in range(1, 81):
        end = member + before
        borders = [0, end - W.SPLIT_BYTES, end, len(data)]
        ids = [W.parsed(r)[0] for a, b in zip(borders, borders[1:])
               for r in W.range_records(io.BytesIO(data), a, b)]
        assert ids == list(range(60)), before


def test_missing_records_are_an_error(spark):
    from stavemill.llm.common import shared_path
    df = spark.createDataFrame([(i, "u", "x" * i) for i in range(5)], "page_id long, url string, html string")
    manifest = staged(W.write_archives(W.with_revisits(df), shared_path(spark, "t")), "m")
    with pytest.raises(ValueError, match="records read"):
        W.read_archives(manifest.withColumn("records", F.col("records") + 1)).count()


def test_false_magic_is_rejected():
    inner = gzip.compress(b"not a record") + W._MAGIC + b"\x00" * 9
    good = records(2, 3)
    data = good[0] + good[1] + good[2]
    assert len(list(W.range_records(io.BytesIO(inner + data), 0, len(inner) + len(data)))) == 3


def test_round_trip_with_revisits(spark):
    big, small_ = "é" * 600, "s" * 999
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (4, "u4", small_), (5, "u5", small_),
            (None, "a\r\nb", big), (6, "u6", None), (7, "x", "y" * 200_000), (7, "x", "y" * 200_000),
            (None, "n", "z" * 2000), (None, "n", "z" * 2000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("top", F.lit(1))
    from stavemill.llm.common import shared_path
    manifest = staged(W.write_archives(W.with_revisits(df), shared_path(spark, "t")), "m")
    got = sorted(W.read_archives(manifest, 500).collect(), key=str)
    want = []
    for i, url, html in rows:
        b = (html or "").encode()
        same = [k for k, _, h in rows if h == html and k is not None]
        rev = len(b) >= 1000 and same and i != max(same)
        want.append((i, url if url != "a\r\nb" else "a%0D%0Ab", len(b), hashlib.sha1(b).hexdigest(),
                     "revisit" if rev else "response", max(same) if rev else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_empty_table(spark):
    from stavemill.llm.common import shared_path
    df = spark.createDataFrame([], "page_id long, url string, html string")
    manifest = staged(W.write_archives(W.with_revisits(df), shared_path(spark, "t")), "m")
    assert W.read_archives(manifest).count() == 0
