"""Queries over sequence structure and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import repair as R
from ..operators import sequence as S
from ..sources import fixtures as fx
from .base import add_cte, beats_sql, measure_sql, register, sql_list, ticks_sql, voice_sql

DATASET = sql_list(("barline", "barline-final", "barline-end-repeat", "barline-start-repeat",
                    "barline-double"))
EVAL = sql_list(("barline", "barline-final", "barline-start-repeat", "barline-end-repeat"))

add_cte("voices", """
SELECT score_id, voice, CAST(row_number() OVER (PARTITION BY score_id, voice ORDER BY pos) - 1
  AS INT) AS vpos, token FROM mv WHERE token <> 'staff-bass'""", "mv")
add_cte("hdr", """
SELECT t.*, pos < coalesce(body, 1000000000) AS in_header FROM tok t LEFT JOIN (
  SELECT score_id, min(pos) AS body FROM tok
  WHERE NOT regexp_matches(token, '^(clef|key|time)-|^<(SOS|EOS|PAD|UNK)>$') GROUP BY 1)
USING (score_id)""", "tok")
# Body measures with dataset barlines.
add_cte("body", f"SELECT * FROM ({measure_sql('(SELECT * FROM hdr WHERE NOT in_header)', 'dataset')})",
        "hdr")
add_cte("totals", "SELECT score_id, max(measure_idx) + 1 AS total FROM body GROUP BY 1", "body")
add_cte("vote", f"""
SELECT score_id, ticks, CASE WHEN ticks = 96 THEN 'time-4/4' WHEN ticks = 48 THEN 'time-2/4'
  WHEN ticks = 72 AND n8 > n4 THEN 'time-6/8' WHEN ticks = 72 THEN 'time-3/4' END AS voted
FROM (SELECT score_id, ticks, count(*) AS c, min(measure_idx) AS f, sum(n_eighth) AS n8,
        sum(n_quarter) AS n4,
        row_number() OVER (PARTITION BY score_id ORDER BY count(*) DESC, min(measure_idx)) AS r
      FROM beats JOIN grand USING (score_id)
      WHERE closed AND (NOT is_grand OR voice = 'bass') GROUP BY score_id, ticks) WHERE r = 1""",
        "beats", "grand")
add_cte("timed", """
SELECT t.score_id, pos, CASE WHEN pos = f AND voted IS NOT NULL THEN voted ELSE token END AS token
FROM tok t LEFT JOIN (SELECT score_id, min(pos) AS f FROM tok WHERE token LIKE 'time-%' GROUP BY 1)
  USING (score_id) LEFT JOIN vote USING (score_id)""", "tok", "vote")


def _accidental_sql(src: str) -> str:
    return f"""
SELECT score_id, pos, CASE WHEN fixed IN (SELECT token FROM vocab) THEN fixed ELSE token END
  AS token
FROM (SELECT t.*, CASE WHEN regexp_matches(token, '^(note|chord)-[A-G][0-9]$') THEN
    CASE WHEN n > 0 AND strpos('FCGDAEB', substr(token, length(token) - 1, 1)) <= n
           THEN left(token, length(token) - 1) || '#' || right(token, 1)
         WHEN n < 0 AND strpos('BEADGCF', substr(token, length(token) - 1, 1)) <= -n
           THEN left(token, length(token) - 1) || 'b' || right(token, 1) END END AS fixed
  FROM {src} t LEFT JOIN (SELECT score_id, list_position(['Gb','Db','Ab','Eb','Bb','F','C','G','D',
      'A','E','B','F#'], substr(arg_min(token, pos), 5)) - 7 AS n FROM {src}
    WHERE token LIKE 'key-%' GROUP BY 1) USING (score_id))"""


def _orphan_sql(src: str) -> str:
    return f"""
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY pos) - 1 AS INT) AS pos,
  token
FROM (SELECT *, last_value(CASE WHEN token NOT LIKE 'chord-%' THEN token END IGNORE NULLS) OVER
    (PARTITION BY score_id ORDER BY pos) AS anchor FROM {src})
WHERE token NOT LIKE 'chord-%' OR coalesce(regexp_matches(anchor, '^(note|dur)-'), false)"""


def _span_sql(src: str) -> str:
    """Pairs a start with the nearest later end that brings the depth back (self-join form)."""
    return f"""
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY pos) - 1 AS INT) AS pos,
  token
FROM {src} AS t WHERE NOT EXISTS (SELECT 1 FROM (
    WITH s AS (SELECT *, sum(step) OVER (PARTITION BY score_id, kind ORDER BY pos) AS d
      FROM (SELECT score_id, pos, regexp_extract(token, '^(.*)-(start|end)$', 1) AS kind,
          CASE WHEN token LIKE '%-start' THEN 1 ELSE -1 END AS step FROM {src}
        WHERE regexp_matches(token,
          '^(slur|hairpin-cresc|hairpin-dim|ottava-8va|ottava-8vb|tuplet-3)-(start|end)$')))
    SELECT a.score_id, a.pos FROM s a WHERE
      (step = 1 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.score_id = a.score_id
         AND b.kind = a.kind AND b.pos > a.pos AND b.d < a.d))
      OR (step = -1 AND d < 0 AND NOT EXISTS (SELECT 1 FROM s b WHERE b.score_id = a.score_id
         AND b.kind = a.kind AND b.pos < a.pos AND b.d <= a.d))) u
  WHERE u.score_id = t.score_id AND u.pos = t.pos)"""


add_cte("r1", _orphan_sql("tok"), "tok")
add_cte("r2", _span_sql("r1"), "r1")
add_cte("r2mv", voice_sql("r2"), "r2")
add_cte("r2beats", beats_sql("r2mv"), "r2mv")


@register("q01_measure_index", "SELECT score_id, pos, measure_idx, 'eval' AS barlines FROM mv "
          f"UNION ALL SELECT score_id, pos, measure_idx, 'dataset' FROM ({measure_sql('tok', 'dataset')}) "
          f"UNION ALL SELECT score_id, pos, measure_idx, 'notes' FROM ({measure_sql('tok', 'notes')})",
          ("mv",))
def measure_index(spark, d):
    t = fx.tokens(spark, d)
    parts = [S.measure_index(t, b).select("score_id", "pos", "measure_idx",
                                          F.lit(b).alias("barlines"))
             for b in ("eval", "dataset", "notes")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("q02_assign_voice", "SELECT score_id, pos, measure_idx, voice FROM mv", ("mv",))
def assign_voice(spark, d):
    return S.assign_voice(fx.tokens(spark, d)).select("score_id", "pos", "measure_idx", "voice")


@register("q03_extract_voices", "SELECT score_id, voice, vpos, token FROM voices", ("voices",))
def extract_voices(spark, d):
    return S.extract_voices(fx.tokens(spark, d))


@register("q04_split_header", "SELECT score_id, pos, in_header FROM hdr", ("hdr",))
def split_header(spark, d):
    return S.split_header(fx.tokens(spark, d)).select("score_id", "pos", "in_header")


@register("q05_strip_leading_header", """
SELECT score_id, CAST(pos - n AS INT) AS pos, token FROM tok JOIN (
  SELECT score_id, CASE
    WHEN regexp_matches(h, '^clef-[GF] key-[^ ]* time-') THEN 3
    WHEN regexp_matches(h, '^clef-[GF] key-') THEN 2 WHEN regexp_matches(h, '^clef-[GF] ') THEN 1
    ELSE 0 END AS n
  FROM (SELECT score_id, string_agg(token, ' ' ORDER BY pos) || ' ' AS h FROM tok WHERE pos < 3
        GROUP BY 1)) USING (score_id) WHERE pos >= n""", ("tok",))
def strip_leading_header(spark, d):
    return S.strip_leading_header(fx.tokens(spark, d)).select("score_id", "pos", "token")


@register("q06_tuplet_open", """
SELECT score_id, pos, coalesce(tuplet = 'tuplet-3-start', false) AS notes_scope,
  coalesce(beat = 'tuplet-3-start', false) AS beats_scope
FROM (SELECT score_id, pos,
  last_value(CASE WHEN token LIKE 'tuplet-3-%' THEN token END IGNORE NULLS) OVER
    (PARTITION BY score_id ORDER BY pos) AS tuplet,
  last_value(CASE WHEN token LIKE 'tuplet-3-%' THEN token END IGNORE NULLS) OVER
    (PARTITION BY score_id, voice, measure_idx ORDER BY pos) AS beat FROM mv)""", ("mv",))
def tuplet_open(spark, d):
    t = S.tuplet_open(S.assign_voice(fx.tokens(spark, d)))
    t = S.tuplet_open(t.withColumnRenamed("in_tuplet", "notes_scope"), "beats")
    return t.select("score_id", "pos", "notes_scope", F.col("in_tuplet").alias("beats_scope"))


@register("q07_measure_beats", "SELECT * FROM beats", ("beats",))
def measure_beats(spark, d):
    return S.measure_beats(fx.tokens(spark, d))


@register("q08_fix_time_signature", "SELECT * FROM timed", ("timed",))
def fix_time_signature(spark, d):
    return R.fix_time_signature(fx.tokens(spark, d))


add_cte("rm", """
SELECT m.score_id, m.measure_idx, coalesce(b.ticks, 0) AS ticks, coalesce(n_eighth, 0) AS n8,
  coalesce(n_quarter, 0) AS n4
FROM (SELECT score_id, measure_idx, max(CASE WHEN token IN (""" + EVAL + """) THEN pos END) AS bar
      FROM mv GROUP BY ALL) m
JOIN (SELECT score_id, min(pos) AS tp FROM tok WHERE token LIKE 'time-%' GROUP BY 1) t
  ON t.score_id = m.score_id AND m.bar > t.tp
JOIN grand g ON g.score_id = m.score_id
LEFT JOIN beats b ON b.score_id = m.score_id AND b.measure_idx = m.measure_idx
  AND b.voice = CASE WHEN is_grand THEN 'bass' ELSE 'treble' END""", "mv", "beats", "grand")


@register("q09_running_time_signature", """
SELECT score_id, measure_idx, CAST(maj AS BIGINT) AS majority_ticks,
  CASE WHEN maj = 96 THEN 'time-4/4' WHEN maj = 48 THEN 'time-2/4'
    WHEN maj = 72 AND n8 > n4 THEN 'time-6/8' WHEN maj = 72 THEN 'time-3/4' END AS corrected
FROM (SELECT a.score_id, a.measure_idx, a.n8, a.n4, b.ticks AS maj,
    row_number() OVER (PARTITION BY a.score_id, a.measure_idx
      ORDER BY count(*) DESC, min(b.measure_idx)) AS r
  FROM rm a JOIN rm b ON a.score_id = b.score_id AND b.measure_idx <= a.measure_idx
  GROUP BY a.score_id, a.measure_idx, a.n8, a.n4, b.ticks) WHERE r = 1""", ("rm",))
def running_time_signature(spark, d):
    return R.running_time_signature(fx.tokens(spark, d))


@register("q10_fix_accidentals", _accidental_sql("tok"), ("tok", "vocab"))
def fix_accidentals(spark, d):
    return R.fix_accidentals(fx.tokens(spark, d))


@register("q11_drop_orphan_chords", "SELECT * FROM r1", ("r1",))
def drop_orphan_chords(spark, d):
    return R.drop_orphan_chords(fx.tokens(spark, d)).select("score_id", "pos", "token")


@register("q12_drop_unmatched_spans", _span_sql("tok"), ("tok",))
def drop_unmatched_spans(spark, d):
    return R.drop_unmatched_spans(fx.tokens(spark, d))


add_cte("seg", """
SELECT score_id, voice, sum(CASE WHEN bar_bass THEN 1 ELSE 0 END) OVER
    (PARTITION BY score_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - CASE WHEN bar_bass THEN 1 ELSE 0 END AS measure_idx, pos, token, bar_bass
FROM (SELECT *, voice = 'bass' AND token IN (""" + EVAL + """) AS bar_bass FROM mv)""", "mv")
add_cte("segbeats", """
SELECT score_id, measure_idx, coalesce(sum(t) FILTER (voice = 'treble'), 0) AS treble,
    coalesce(sum(t) FILTER (voice = 'bass'), 0) AS bass
FROM (SELECT *, CASE WHEN tup = 'tuplet-3-start' THEN w * 2 // 3 ELSE w END AS t
  FROM (SELECT *, """ + ticks_sql("token") + """ AS w,
    last_value(CASE WHEN token LIKE 'tuplet-3-%' THEN token END IGNORE NULLS) OVER
      (PARTITION BY score_id, voice, measure_idx ORDER BY pos) AS tup FROM seg))
GROUP BY ALL HAVING bool_or(bar_bass)""", "seg")


@register("q13_flag_beat_mismatch", """
SELECT score_id, CAST(measure_idx AS INT) AS measure_idx, CAST(treble AS BIGINT) AS treble_ticks,
  CAST(expected AS BIGINT) AS expected_ticks
FROM segbeats JOIN (SELECT score_id, bass AS expected FROM (SELECT score_id, bass, row_number() OVER
    (PARTITION BY score_id ORDER BY count(*) DESC, min(measure_idx)) AS r FROM segbeats
    GROUP BY 1, 2) WHERE r = 1 AND bass IN (96, 72, 48)) USING (score_id)
WHERE treble <> expected""", ("segbeats",))
def flag_beat_mismatch(spark, d):
    return R.flag_beat_mismatch(fx.tokens(spark, d))


def _split_sql(n: str, use_breaks: bool) -> str:
    brk = ("coalesce({n} = 2 AND brk > 0 AND brk < total, false)".format(n=n)
           if use_breaks else "false")
    return f"""
SELECT score_id, CAST(system_idx AS INT) AS system_idx, CAST(row_number() OVER
  (PARTITION BY score_id, system_idx ORDER BY pos) - 1 AS INT) AS pos, token
FROM (
  SELECT h.score_id, p.system_idx, h.pos, h.token
  FROM hdr h
  JOIN (SELECT score_id, {n} AS n, brk, unnest(range({n})) AS system_idx FROM m) p USING (score_id)
  LEFT JOIN totals t USING (score_id)
  LEFT JOIN body b ON b.score_id = h.score_id AND b.pos = h.pos
  LEFT JOIN (SELECT score_id, count(*) AS hl FROM hdr WHERE in_header GROUP BY 1) c
    ON c.score_id = h.score_id
  WHERE n = 1 OR total IS NULL OR h.in_header
    OR (b.measure_idx >= CASE WHEN {brk.replace(n, 'n', 1) if use_breaks else brk}
          THEN CASE system_idx WHEN 0 THEN 0 ELSE brk END ELSE system_idx * total // n END
      AND b.measure_idx < CASE WHEN {brk.replace(n, 'n', 1) if use_breaks else brk}
          THEN CASE system_idx WHEN 0 THEN brk ELSE total END ELSE (system_idx + 1) * total // n END)
    OR (hl IS NULL AND system_idx * total // n = (system_idx + 1) * total // n
        AND NOT ({brk.replace(n, 'n', 1) if use_breaks else brk})))"""


SYSTEMS = "greatest(n_staves // 2, 1)"
add_cte("m", f"SELECT *, {SYSTEMS} AS n_systems FROM meta", "meta")
add_cte("systems", _split_sql("n_systems", True), "hdr", "totals", "body", "m")


def split_input(spark, d):
    meta = fx.score_meta(spark, d)
    n = F.greatest((F.col("n_staves") / 2).cast("int"), F.lit(1))
    return meta.select("score_id", n.alias("n_systems"), "breaks", "n_staves",
                       F.posexplode("tokens").alias("pos", "token"))


@register("q14_split_systems", "SELECT * FROM systems", ("systems",))
def split_systems(spark, d):
    return S.split_systems(split_input(spark, d))


@register("q15_split_rows", _split_sql("n_staves", False), ("hdr", "totals", "body", "m"))
def split_rows(spark, d):
    return S.split_rows(split_input(spark, d), "n_staves")


add_cte("vp", f"""
SELECT b.*, CASE WHEN max(CASE WHEN token = 'staff-bass' THEN 1 ELSE 0 END) OVER
    (PARTITION BY score_id, measure_idx ORDER BY pos) = 1 THEN 'bass' ELSE 'treble' END AS voice,
  token IN ({DATASET}) AS bar FROM body b""", "body")
add_cte("vpm", """
SELECT score_id, measure_idx, coalesce(max(token) FILTER (bar), 'barline-final') AS bar_token,
  coalesce(max(pos) FILTER (bar), max(pos) + 1) AS bar_pos,
  count(*) FILTER (NOT bar AND voice = 'bass' AND token <> 'staff-bass') AS n_bass
FROM vp GROUP BY 1, 2 HAVING bool_or(bar) OR bool_or(token <> 'staff-bass')""", "vp")
add_cte("vps", """
SELECT v.score_id, v.measure_idx, v.bar_token, v.bar_pos, v.n_bass, s.system_idx
FROM vpm v JOIN (SELECT score_id, max(measure_idx) + 1 AS total FROM vpm GROUP BY 1) t
  USING (score_id) JOIN (SELECT score_id, n_systems, unnest(range(n_systems)) AS system_idx FROM m) s
  ON s.score_id = v.score_id AND v.measure_idx >= system_idx * total // n_systems
  AND v.measure_idx < (system_idx + 1) * total // n_systems""", "vpm", "m")
add_cte("vpf", """
SELECT score_id, system_idx, min(measure_idx) AS first_m FROM vps WHERE n_bass > 0 GROUP BY 1, 2""",
        "vps")
add_cte("vprows", """
SELECT score_id, system_idx, voice, ord, token FROM (
  SELECT h.score_id, s.system_idx, v.voice, h.pos AS ord,
    CASE WHEN v.voice = 'bass' AND h.token = 'clef-G' THEN 'clef-F' ELSE h.token END AS token
  FROM hdr h JOIN (SELECT score_id, unnest(range(n_systems)) AS system_idx FROM m) s USING (score_id),
    (VALUES ('treble'), ('bass')) AS v(voice)
  WHERE h.in_header AND h.score_id IN (SELECT score_id FROM vpm)
  UNION ALL
  SELECT p.score_id, s.system_idx, p.voice, p.pos, p.token
  FROM vp p JOIN vps s USING (score_id, measure_idx) LEFT JOIN vpf f
    ON f.score_id = s.score_id AND f.system_idx = s.system_idx
  WHERE NOT p.bar AND p.token <> 'staff-bass' AND NOT (p.voice = 'bass' AND p.token = 'clef-F'
    AND f.first_m = p.measure_idx AND p.pos = (SELECT min(q.pos) FROM vp q WHERE
      q.score_id = p.score_id AND q.measure_idx = p.measure_idx AND q.voice = 'bass'
      AND q.token <> 'staff-bass' AND NOT q.bar))
  UNION ALL SELECT score_id, system_idx, 'treble', bar_pos, bar_token FROM vps
  UNION ALL SELECT score_id, system_idx, 'bass', bar_pos, bar_token FROM vps WHERE n_bass > 0)""",
        "hdr", "m", "vp", "vps", "vpm", "vpf")


@register("q16_split_voice_pairs", """
SELECT score_id, CAST(system_idx AS INT) AS system_idx, voice, CAST(row_number() OVER
  (PARTITION BY score_id, system_idx, voice ORDER BY ord) - 1 AS INT) AS pos, token
FROM (SELECT * FROM vprows UNION ALL
      SELECT score_id, system_idx, 'bass', -1, '<SOS>' FROM vprows WHERE voice = 'bass'
      GROUP BY 1, 2)""", ("vprows",))
def split_voice_pairs(spark, d):
    return S.split_voice_pairs(split_input(spark, d))


add_cte("dens", f"""
SELECT score_id, measure_idx, greatest(coalesce(sum(w) FILTER (voice = 'treble'), 0),
  coalesce(sum(w) FILTER (voice = 'bass'), 0)) AS weight
FROM (SELECT *, CASE WHEN token LIKE 'note-%' OR token LIKE 'rest-%' THEN 1.0::DOUBLE
  WHEN token LIKE 'chord-%' THEN 0.5 END AS w FROM ({voice_sql('tok', 'dataset')})) GROUP BY 1, 2""",
        "tok")


@register("q17_measure_density", "SELECT * FROM dens", ("dens",))
def measure_density(spark, d):
    return S.measure_density(fx.tokens(spark, d))


add_cte("fold", """
SELECT score_id, measure_idx, weight AS cum, false AS brk FROM dens WHERE measure_idx = 0
UNION ALL
SELECT n.score_id, n.measure_idx, CASE WHEN f.cum + n.weight > 12.0 THEN n.weight
  ELSE f.cum + n.weight END, f.cum + n.weight > 12.0
FROM fold f JOIN dens n ON n.score_id = f.score_id AND n.measure_idx = f.measure_idx + 1""", "dens")


@register("q18_density_breaks", """
SELECT score_id, coalesce(string_agg(measure_idx, ',' ORDER BY measure_idx) FILTER (brk), '')
  AS breaks FROM fold GROUP BY 1""", ("fold",))
def density_breaks(spark, d):
    b = S.density_breaks(S.measure_density(fx.tokens(spark, d)), cap=12.0)
    return b.select("score_id", F.array_join("breaks", ",").alias("breaks"))


@register("q19_fixed_breaks", """
SELECT score_id, coalesce(string_agg(i, ',' ORDER BY i) FILTER (i % 4 = 0), '') AS every4,
  coalesce(string_agg(i, ',' ORDER BY i) FILTER (i % CASE WHEN n <= 3 THEN n ELSE 2 END = 0), '')
    AS automatic
FROM (SELECT score_id, n, unnest(CASE WHEN n > 1 THEN range(1, n) ELSE [NULL] END) AS i
  FROM (SELECT score_id, CASE WHEN score_id % 6 = 0 THEN 3 ELSE max(measure_idx) + 1 END AS n
        FROM mv GROUP BY 1)) GROUP BY 1""", ("mv",))
def fixed_breaks(spark, d):
    n = S.measure_index(fx.tokens(spark, d)).groupBy("score_id").agg(
        F.when(F.col("score_id") % 6 == 0, 3).otherwise(F.max("measure_idx") + 1)
        .alias("n_measures"))
    a = S.fixed_breaks(n, 4).withColumnRenamed("breaks", "b4")
    return S.fixed_breaks(a).select("score_id", F.array_join("b4", ",").alias("every4"),
                                    F.array_join("breaks", ",").alias("automatic"))


@register("q20_join_systems", """
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY system_idx, pos) - 1 AS INT)
  AS pos, token
FROM (SELECT s.*, CASE WHEN system_idx = 0 THEN 0
    WHEN regexp_matches(h, '^clef-[GF] key-[^ ]* time-') THEN 3
    WHEN regexp_matches(h, '^clef-[GF] key-') THEN 2 WHEN regexp_matches(h, '^clef-[GF] ') THEN 1
    ELSE 0 END AS n
  FROM systems s JOIN (SELECT score_id, system_idx, string_agg(token, ' ' ORDER BY pos) || ' ' AS h
    FROM systems WHERE pos < 3 GROUP BY 1, 2) USING (score_id, system_idx)) WHERE pos >= n""",
          ("systems",))
def join_systems(spark, d):
    return S.join_systems(S.split_systems(split_input(spark, d)))


@register("q_repair_chain", _accidental_sql("""(
SELECT t.score_id, pos, CASE WHEN pos = f AND voted IS NOT NULL THEN voted ELSE token END AS token
FROM r2 t LEFT JOIN (SELECT score_id, min(pos) AS f FROM r2 WHERE token LIKE 'time-%' GROUP BY 1)
  USING (score_id) LEFT JOIN (
    SELECT score_id, CASE WHEN ticks = 96 THEN 'time-4/4' WHEN ticks = 48 THEN 'time-2/4'
      WHEN ticks = 72 AND n8 > n4 THEN 'time-6/8' WHEN ticks = 72 THEN 'time-3/4' END AS voted
    FROM (SELECT score_id, ticks, sum(n_eighth) AS n8, sum(n_quarter) AS n4, row_number() OVER
        (PARTITION BY score_id ORDER BY count(*) DESC, min(measure_idx)) AS r
      FROM r2beats JOIN grand USING (score_id)
      WHERE closed AND (NOT is_grand OR voice = 'bass') GROUP BY score_id, ticks) WHERE r = 1)
  USING (score_id))"""), ("r2", "r2beats", "grand", "vocab"))
def repair_chain(spark, d):
    return R.repair(fx.tokens(spark, d))


@register("e19_majority_vote", """
SELECT score_id, n AS staves, votes FROM (SELECT score_id, n, count(*) AS votes, row_number() OVER
    (PARTITION BY score_id ORDER BY (n >= 2 AND n % 2 = 0) DESC, count(*) DESC, n DESC) AS r
  FROM (SELECT CAST((event_id - event_id % 4) / 4 AS BIGINT) AS score_id,
    CAST(regexp_extract(props, '[0-9]+', 0) AS INT) % 5 AS n FROM events) GROUP BY 1, 2)
WHERE r = 1""")
def detector_consensus(spark, d):
    """Four detector candidates per image; even staff counts >= 2 win over odd ones."""
    c = fx.table(spark, d, "events").select(
        F.expr("CAST((event_id - event_id % 4) / 4 AS bigint)").alias("score_id"), "event_id",
        (F.regexp_extract("props", "[0-9]+", 0).cast("int") % 5).alias("n"))
    even = (F.col("n") >= 2) & (F.col("n") % 2 == 0)
    v = R.majority_vote(c, ["score_id"], "n", "event_id", prefer=even, tie="larger")
    return v.select("score_id", F.col("n").alias("staves"), "votes")
