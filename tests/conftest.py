import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (SparkSession.builder.master("local[8]").appName("tests")
         .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def token_table(spark, scores: dict):
    """``{score_id: "tok tok ..."}`` as a token table."""
    rows = [(k, i, t) for k, text in scores.items() for i, t in enumerate(text.split())]
    return spark.createDataFrame(rows, "score_id bigint, pos int, token string")


def sequences(df, order="pos", value="token", key="score_id"):
    """A token table back to ``{score_id: [token]}``."""
    out: dict = {}
    for r in sorted(df.collect(), key=lambda r: (r[key], r[order])):
        out.setdefault(r[key], []).append(r[value])
    return out
