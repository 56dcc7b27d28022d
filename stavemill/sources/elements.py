"""Parsed-score tables (elements, dynamics, measures, headers) derived from ``events``.

The element text is shared with the check SQL; a score is 64 consecutive event ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import table

# One element per event: eight per measure, the second half in the lower part of grand scores.
ELEMENTS_SQL = """
SELECT score_id, event_id AS el_idx, k, event_type,
  CAST((i - i % 8) / 8 AS int) AS measure_idx,
  CASE WHEN grand = 1 AND i % 8 >= 4 THEN 'bass' ELSE 'treble' END AS part,
  CAST(CASE WHEN grand = 1 THEN i % 4 ELSE i % 8 END AS double) AS offset_q,
  event_type = 'error' AS is_rest,
  event_type = 'signup' OR k % 4 = 0 AS triplet,
  CASE WHEN k % 9 = 0 THEN CAST(0.4 AS double) WHEN k % 3 = 0 THEN CAST(0.5 AS double)
    WHEN k % 3 = 1 THEN CAST(1.0 AS double) ELSE CAST(1.5 AS double) END AS quarters,
  38 + k % 50 AS midi,
  CASE k % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'E#' WHEN 2 THEN 'Cb' WHEN 3 THEN 'G#' WHEN 4 THEN 'Bb'
    ELSE 'F' END AS name,
  CASE k % 6 WHEN 1 THEN '#' WHEN 3 THEN '#' WHEN 2 THEN 'b' WHEN 4 THEN 'b' END AS acc,
  CASE WHEN event_type = 'purchase' THEN 1 + k % 2 ELSE 0 END AS n_extra,
  CASE k % 8 WHEN 0 THEN 'Staccato' WHEN 1 THEN 'StrongAccent' WHEN 2 THEN 'Unknown' END AS artic,
  CASE k % 10 WHEN 3 THEN 'Fermata' WHEN 4 THEN 'InvertedMordent' WHEN 5 THEN 'Glissando' END AS expr,
  CASE k % 11 WHEN 0 THEN 'start' WHEN 1 THEN 'continue' WHEN 2 THEN 'stop' END AS tie,
  CASE k % 5 WHEN 0 THEN 'fz' WHEN 1 THEN 'mp' WHEN 2 THEN 'ff' END AS dyn,
  CASE k % 7 WHEN 0 THEN 'repeat' WHEN 1 THEN 'light-light' WHEN 2 THEN 'light-heavy'
    WHEN 3 THEN 'dashed' END AS right_bar,
  k % 13 = 0 AS starts_repeat
FROM (SELECT *, CASE WHEN score_id % 3 = 0 THEN 0 ELSE 1 END AS grand FROM (
  SELECT CAST((event_id - event_id % 64) / 64 AS bigint) AS score_id, event_id, event_type,
    CAST(event_id % 64 AS int) AS i, CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k
  FROM {events}) e0) e1
"""


def raw_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ELEMENTS_SQL, events=table(spark, sf_dir, "events"))


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_elements(spark, sf_dir)
    tone = lambda m, n, a: F.struct(m.cast("int").alias("midi"), n.alias("name"), a.alias("acc"))
    none = F.lit(None).cast("string")
    lower = tone(F.col("midi") - 3, F.lit("X"), F.lit("#"))
    upper = tone(F.col("midi") + 4, F.lit("X"), none)
    main = tone(F.col("midi"), F.col("name"), F.col("acc"))
    pitches = (F.when(F.col("n_extra") == 2, F.array(main, upper, lower))
               .when(F.col("n_extra") == 1, F.array(main, lower)).otherwise(F.array(main)))
    listed = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(
        F.array().cast("array<string>"))
    return raw.select("score_id", "part", "measure_idx", F.col("offset_q").alias("offset"), "el_idx",
                      "is_rest", "quarters", "triplet", pitches.alias("pitches"),
                      listed("artic").alias("artics"), listed("expr").alias("exprs"), "tie")


def dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two elements may carry one; half of them are moved to the measure start."""
    raw = raw_elements(spark, sf_dir).filter("dyn IS NOT NULL AND offset_q < 2")
    return raw.select("score_id", "part", "measure_idx",
                      F.when(F.col("k") % 2 == 0, F.lit(0.0)).otherwise(F.col("offset_q"))
                      .alias("offset"), F.col("el_idx").alias("dyn_idx"),
                      F.col("dyn").alias("value"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower parts of some scores are one measure short."""
    raw = raw_elements(spark, sf_dir)
    rows = raw.groupBy("score_id", "part", "measure_idx").agg(
        F.max_by("right_bar", "el_idx").alias("right_bar"),
        F.min_by("starts_repeat", "el_idx").alias("starts_repeat"))
    return rows.filter(~((F.col("part") == "bass") & (F.col("score_id") % 4 == 1)
                         & (F.col("measure_idx") >= 7)))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = raw_elements(spark, sf_dir)
    return raw.select("score_id", "part").distinct().select(
        "score_id", "part",
        F.when((F.col("part") == "bass") & (F.col("score_id") % 5 != 4), "F").alias("clef"),
        (F.col("score_id") % 15 - 7).cast("int").alias("fifths"),
        F.when(F.col("score_id") % 4 == 0, "3/4").when(F.col("score_id") % 4 == 1, "7/8")
        .alias("time_sig"))
