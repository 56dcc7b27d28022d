"""Music views derived from the driver tables.

The token text is one SQL definition that Spark and an ANSI engine both run, so results can be
compared. A score is 64 consecutive event ids and a session 128: ids are unique, so the size of
every window partition is bounded by construction (the recogniser's own limit is 608 tokens),
no matter how skewed the users, types or values are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Two characters per pitch class (or key), picked by position: portable and cheap to evaluate.
_NAME = "trim(substr('C DbD EbE F F#G AbA BbB ', CAST(1 + 2 * (({0}) % 12) AS int), 2))"
_SHARP = "trim(substr('C C#D D#E F F#G G#A A#B ', CAST(1 + 2 * (({0}) % 12) AS int), 2))"
_KEY = "trim(substr('C G D A E B F#F BbEbAbDbGb', CAST(1 + 2 * (score_id % 13) AS int), 2))"
_TIME = "trim(substr('4/4 3/4 2/4 6/8 12/8', CAST(1 + 4 * (event_id % 5) AS int), 4))"
_BODY_CLASS = "CASE WHEN k >= 97 THEN k WHEN event_type = 'signup' THEN k % 2 " \
    "WHEN event_type = 'error' THEN 2 WHEN event_type = 'purchase' AND k % 3 = 0 THEN 3 " \
    "WHEN event_type = 'purchase' THEN 4 WHEN event_type = 'view' OR score_id % 4 = 3 THEN 5 " \
    "WHEN k % 23 = 0 THEN 6 ELSE 7 END"

# (score_id, event_id, toks): the tokens each event contributes, in event_id order.
EVENT_TOKENS_SQL = f"""
SELECT score_id, event_id,
  CASE WHEN i = 0 AND score_id % 11 <> 10 THEN 'clef-G '
    || CASE WHEN score_id % 7 = 6 THEN '' ELSE 'key-' || {_KEY} || ' ' END
    || 'time-' || {_TIME} || ' '
    WHEN grand = 1 AND i = m THEN CASE WHEN score_id % 5 = 4 THEN 'staff-bass clef-G '
      ELSE 'staff-bass clef-F ' END
    WHEN grand = 1 AND slot = m THEN 'staff-bass ' ELSE '' END
  || CASE k % 10 WHEN 1 THEN 'slur-start ' WHEN 3 THEN 'hairpin-cresc-start '
       WHEN 5 THEN 'ottava-8va-start ' WHEN 7 THEN 'dynamic-p ' ELSE '' END
  || body
  || CASE k % 11 WHEN 1 THEN ' slur-end' WHEN 2 THEN ' hairpin-cresc-end'
       WHEN 3 THEN ' ottava-8va-end' WHEN 4 THEN ' dynamic-mf' WHEN 5 THEN ' artic-staccato'
       WHEN 6 THEN ' fermata' WHEN 7 THEN ' tie' WHEN 8 THEN ' trill-start'
       WHEN 9 THEN ' hairpin-dim-end' ELSE '' END
  || CASE WHEN slot <> slots - 1 THEN '' WHEN i = 63 THEN ' barline-final'
       WHEN k % 16 IN (0, 3) THEN ' barline-end-repeat' WHEN k % 16 = 1 THEN ' barline-double'
       WHEN k % 16 = 2 THEN ' barline-start-repeat' ELSE ' barline' END AS toks
FROM (
  SELECT score_id, event_id, k, i, m, grand, slots, CAST(i % slots AS int) AS slot,
    CASE kind
      WHEN 99 THEN 'note-C9 dur-1/4'
      WHEN 98 THEN 'note-E#4 dur-1/4'
      WHEN 97 THEN p || ' dur-x'
      WHEN 0 THEN 'tuplet-3-start ' || p || ' dur-1/8 ' || q || ' dur-1/8 '
        || CASE WHEN k % 3 = 0 THEN 'rest-1/8' ELSE p || ' dur-1/8' END || ' tuplet-3-end'
      WHEN 1 THEN p || ' dur-1/16 ' || q || ' dur-1/16 ' || p || ' dur-1/16 ' || q || ' dur-1/16'
      WHEN 2 THEN CASE WHEN k % 9 = 0 THEN 'rest-1/4 chord-G4' WHEN k % 9 = 1 THEN 'rest-1/4 tie'
        ELSE 'rest-1/4' END
      WHEN 3 THEN p || ' dur-1/8 tie note-' || s || ' dur-1/8'
        || CASE WHEN k % 2 = 0 THEN ' chord-' || substr(q, 6) ELSE '' END
      WHEN 4 THEN p || ' dur-1/4 chord-' || substr(q, 6)
        || CASE WHEN k % 5 = 0 THEN ' chord-C6' ELSE '' END
      WHEN 5 THEN p || ' dur-1/8 ' || q || ' dur-1/8'
      WHEN 6 THEN p || ' dur-3/8'
      ELSE p || ' dur-1/4' END AS body
  FROM (
    SELECT *, m * (1 + grand) AS slots, {_BODY_CLASS} AS kind,
      'note-' || {_NAME.format('k')} || CAST(3 + k % 3 AS string) AS p,
      'note-' || {_NAME.format('k + 4')} || CAST(3 + k % 3 AS string) AS q,
      {_SHARP.format('k')} || CAST(3 + k % 3 AS string) AS s
    FROM (
      SELECT *, CASE score_id % 4 WHEN 0 THEN 4 WHEN 2 THEN 2 ELSE 3 END AS m,
        CASE WHEN score_id % 3 = 0 THEN 0 ELSE 1 END AS grand
      FROM (
        SELECT CAST((event_id - event_id % 64) / 64 AS bigint) AS score_id, event_id, event_type,
          CAST(event_id % 64 AS int) AS i,
          CAST(regexp_extract(props, '[0-9]+', 0) AS int) AS k
        FROM {{events}}) e0) e1) e2) e3
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str, specials: bool = False) -> DataFrame:
    """``(score_id, tokens)``: one array row per score; the only exchange most plans need. The number of its
    partitions is given, as label rows are compact: merged by their size, they would leave cores without work
    once the tokens are exploded."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ev = spark.sql(EVENT_TOKENS_SQL, events=table(spark, sf_dir, "events")).repartition(n, "score_id")
    toks = F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "toks"))),
                                 lambda e: F.split(e["toks"], " ")))
    if specials:
        toks = F.concat(F.array(F.lit("<SOS>")), toks, F.array(F.lit("<EOS>")))
    return ev.groupBy("score_id").agg(toks.alias("tokens"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(score_id, pos, token)``; the explode keeps the partitioning on ``score_id``."""
    return labels(spark, sf_dir).select("score_id", F.posexplode("tokens").alias("pos", "token"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corrupted copy of ``tokens``: drops, pitch changes, doubled rows, missing scores."""
    code = (F.col("pos") * 7 + F.col("score_id")) % 160
    changed = (F.when(F.col("token").startswith("note-") & (code % 19 == 3), F.lit("note-A4"))
               .when(F.col("token").startswith("dur-") & (code % 23 == 5), F.lit("dur-1/8"))
               .otherwise(F.col("token")))
    # Scores 0, 9, 18, ... are predicted perfectly; scores 5, 22, 39, ... have no prediction.
    keep_clean = F.col("score_id") % 9 == 0
    out = F.when(~keep_clean & (code == 11), F.array().cast("array<string>")).when(
        ~keep_clean & (code == 47), F.array(changed, changed)).otherwise(
        F.array(F.when(keep_clean, F.col("token")).otherwise(changed)))
    rows = (labels(spark, sf_dir).filter(F.col("score_id") % 17 != 5)
            .select("score_id", F.posexplode("tokens").alias("pos", "token"))
            .select("score_id", "pos", F.posexplode(out).alias("j", "token")))
    w = Window.partitionBy("score_id").orderBy("pos", "j")
    return rows.select("score_id", (F.row_number().over(w) - 1).alias("pos"), "token")


def score_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(score_id, tokens, n_staves, breaks)``: the detector's staff count and line breaks."""
    n = F.when(F.col("score_id") % 3 == 0, F.col("score_id") % 4 + 1).otherwise(
        (F.col("score_id") % 3) * 2 + F.when(F.col("score_id") % 7 == 1, 1).otherwise(0))
    breaks = F.when(F.col("score_id") % 2 == 0, F.array(F.lit(1))).when(
        F.col("score_id") % 5 == 0, F.array(F.lit(900)))
    return (labels(spark, sf_dir)
            .select("score_id", "tokens", n.cast("int").alias("n_staves"), breaks.alias("breaks")))
