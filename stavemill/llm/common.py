"""Shared helpers: reading tables, staged intermediate tables, words, stable hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract: space, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"
GAP = r"[\x20\x09-\x0D]+"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own_folder: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names. A local session without that
    setting gets a folder of its own; on a cluster the setting is required."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own_folder:
            _own_folder.append(tempfile.mkdtemp(prefix="stavemill-llm-"))
        folder = _own_folder[0]
    return f"{folder.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: cuts the lineage, and later
    readers survive lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a Python worker gets at once; texts can be long, and Spark's own 10,000 of them fill a worker.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Python workers, unless the session has a setting of its own."""
    if spark.conf.get(_BATCH, "10000") == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


#: Tables of at most so many narrow rows are broadcast.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """The table with the broadcast hint, if a count shows that it is small enough for one."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def words(text: Column) -> Column:
    """The words of a text in order (null: none)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words as long, without keeping them (null: 0)."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(body == "", 0).otherwise(F.size(F.split(body, GAP))).cast("long")


def packed(df: DataFrame, **cols: Column) -> DataFrame:
    """The whole row as struct ``row`` beside computed columns, so that no name can clash."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"),
                     *[c.alias(k) for k, c in cols.items()])
