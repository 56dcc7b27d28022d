import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark):
    """Makes a documents table from (doc_id, text[, source[, lang]])."""
    def make(rows):
        full = [(r[0], r[1], r[3] if len(r) > 3 else "en", r[2] if len(r) > 2 else "s",
                 len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture()
def folder(spark, tmp_path):
    """Writes named tables as parquet; the folder's path."""
    def make(**tables):
        for name, df in tables.items():
            df.write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)
    return make


def clashing(df):
    """The table with further columns whose names operators use inside."""
    from pyspark.sql import functions as F
    for c in ("row", "key", "hash", "size", "class", "digest", "shard", "old", "copies", "q", "node",
              "bad_id", "n", "band", "rank"):
        df = df.withColumn(c, F.lit("x"))
    return df
