"""Tables bucketed by a key that micro-batches are merged into, each exactly once.

A commit is one small file that names, for every bucket the batch touched, the folder that holds the bucket
from then on, with the table's version and the batch's number. The file appears whole or not at all, and a
reader takes the newest folder of each bucket as of one version, so it never sees half a batch. A batch number
at or below the last one committed changes nothing, so a stream may repeat a batch after a failure. Buckets
without new rows are neither read nor written; their files keep their names. One stream writes a table.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_COMMIT = "version bigint, batch bigint, bucket int, folder string"


class VersionedTable:
    """``key`` columns decide the bucket; ``schema`` excludes the bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], buckets: int = 16
                 ) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _commits(self) -> DataFrame:
        return self.spark.read.schema(_COMMIT).parquet(f"{self.path}/commits")

    def create(self, rows: DataFrame | None = None) -> VersionedTable:
        """The first version, without a batch number."""
        self.spark.createDataFrame([], _COMMIT).write.parquet(f"{self.path}/commits")
        rows = self.spark.createDataFrame([], self.schema) if rows is None else rows
        self._commit(0, -1, rows.select(*self.schema.names))
        return self

    def state(self, version: int | None = None) -> tuple[int, int, dict[int, str]]:
        """Version, last batch and the folder of each bucket; at most one row a bucket reaches the driver."""
        rows = self._commits()
        if version is not None:
            rows = rows.where(F.col("version") <= version)
        last = rows.groupBy("bucket").agg(F.max("version").alias("version"), F.max("batch").alias("batch"),
                                          F.max_by("folder", "version").alias("folder")).collect()
        return (max(r.version for r in last), max(r.batch for r in last),
                {r.bucket: r.folder for r in last if r.bucket is not None})

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of its newest version, or of an older one."""
        return self._folders(self.state(version)[2].values())

    def _folders(self, folders) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in sorted(folders)])

    def merge(self, batch: int, rows: DataFrame, fn: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replaces every bucket that ``rows`` touch by ``fn(its rows, its new rows)``, which keeps rows in their
        bucket; ``False`` if the batch had been committed before."""
        version, last, folders = self.state()
        if batch <= last:
            return False
        touched = {r.bucket for r in rows.select(self._bucket().alias("bucket")).distinct().collect()}
        old = self._folders([folders[b] for b in touched if b in folders])
        self._commit(version + 1, batch, fn(old, rows).select(*self.schema.names), touched)
        return True

    def _commit(self, version: int, batch: int, rows: DataFrame, touched: set[int] | None = None) -> None:
        name = f"{version:012d}-{uuid.uuid4().hex[:12]}"
        if touched is None or touched:
            n = self.buckets if touched is None else len(touched)
            rows.withColumn("bucket", self._bucket()).repartition(n, "bucket").write.partitionBy("bucket").parquet(
                f"{self.path}/data/{name}")
        if touched is None:
            touched = {r.bucket for r in rows.select(self._bucket().alias("bucket")).distinct().collect()}
        # A row without a bucket records a batch even if it touched nothing.
        entries = [(version, batch, None, None)] + [(version, batch, b, f"{name}/bucket={b}") for b in sorted(touched)]
        self.spark.createDataFrame(entries, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")


def merge_stream(stream: DataFrame, table: VersionedTable, checkpoint: str,
                 fn: Callable[[DataFrame, DataFrame], DataFrame], mode: str = "append") -> None:
    """Merges everything available; run again with the same ``checkpoint`` it goes on where it stopped."""
    def save(rows: DataFrame, batch: int) -> None:
        rows.persist()  # read for its buckets and for the merge
        try:
            table.merge(batch, rows, fn)
        finally:
            rows.unpersist()
    (stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).foreachBatch(save)
     .trigger(availableNow=True).start().awaitTermination())
