"""Keyboard messages (S14): the batch table and the file stream have the same columns.

A session is 128 consecutive event ids, so keyed state and per-session windows are bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pitch as P
from .fixtures import table

EVENT_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
                "value double, props string")
MIDI_SCHEMA = "session_id bigint, seq bigint, t_ms bigint, status int, d1 int, d2 int"

# Status, note and velocity bytes of every event; control messages are mixed in.
MIDI_SQL = """
SELECT CAST((event_id - event_id % 128) / 128 AS bigint) AS session_id, event_id AS seq,
  event_id * 900 + k * 3 AS t_ms,
  CASE WHEN event_type = 'signup' AND k % 3 = 0 THEN 176 WHEN event_type = 'error' THEN 128
    ELSE 144 END + k % 16 AS status,
  48 + (k * 7 + CAST(event_id % 3 AS int)) % 12 AS d1,
  CASE WHEN k % 4 = 0 THEN 0 ELSE 40 + k % 60 END AS d2
FROM (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k
      FROM {events}) e
"""


def midi_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(MIDI_SQL, events=table(spark, sf_dir, "events"))


def file_stream(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    """A driver table as a file stream."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir))


def midi_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw three-byte messages as a stream."""
    return spark.sql(MIDI_SQL, events=file_stream(spark, sf_dir, "events", EVENT_SCHEMA))


def decode_midi(messages: DataFrame) -> DataFrame:
    """Note-on / note-off with the pitch; everything else is dropped. A note-on without
    velocity is a release."""
    cmd = F.col("status").bitwiseAND(0xF0)
    kind = (F.when((cmd == 0x90) & (F.col("d2") > 0), "on")
            .when((cmd == 0x80) | ((cmd == 0x90) & (F.col("d2") == 0)), "off"))
    return (messages.withColumn("kind", kind).filter("kind IS NOT NULL")
            .select("session_id", "seq", "t_ms", "kind", P.midi_to_pitch("d1").alias("pitch"),
                    F.col("d2").alias("velocity")))
