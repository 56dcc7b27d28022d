"""Queries over token and pitch scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pitch as P
from ..functions import tokens as T
from ..operators import sequence as S
from ..sources import fixtures as fx
from ..sources.jobs import job_events
from .base import SHARP_SQL, midi_sql, register, ticks_sql


def _notes(spark, d):
    """Note tokens with their pitch text."""
    return (fx.tokens(spark, d).filter(T.is_note("token"))
            .select("score_id", "pos", T.suffix("token", "note-").alias("p")))


def _clef():
    return F.when(F.col("pos") % 2 == 0, "bass").otherwise("treble")


NOTES_SQL = "(SELECT score_id, pos, substr(token, 6) AS p FROM tok WHERE token LIKE 'note-%')"
CLEF_SQL = "CASE WHEN pos % 2 = 0 THEN 'bass' ELSE 'treble' END"
OCT_SQL = "CAST(right(p, 1) AS INT)"


@register("t01_explode_tokens", "SELECT score_id, pos, token FROM raw", ("raw",))
def explode_tokens(spark, d):
    return T.explode_tokens(fx.labels(spark, d, specials=True))


@register("t02_strip_specials", "SELECT score_id, pos, token FROM tok", ("tok",))
def strip_specials(spark, d):
    labels = fx.labels(spark, d, specials=True)
    return T.explode_tokens(labels.withColumn("tokens", T.strip_specials("tokens")))


@register("t03_encode", "SELECT score_id, pos, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab "
          "USING (token)", ("tok", "vocab"))
def encode(spark, d):
    return T.encode(fx.tokens(spark, d)).select("score_id", "pos", "id")


@register("t04_decode", "SELECT score_id, pos, coalesce(v.token, '<UNK>') AS token FROM "
          "(SELECT score_id, pos, coalesce(id, 3) + pos % 9 * 40 AS id FROM tok LEFT JOIN vocab "
          "USING (token)) e LEFT JOIN vocab v USING (id)", ("tok", "vocab"))
def decode(spark, d):
    ids = T.encode(fx.tokens(spark, d)).select(
        "score_id", "pos", (F.col("id") + F.col("pos") % 9 * 40).alias("id"))
    return T.decode(ids).select("score_id", "pos", "token")


@register("t05_truncate", "SELECT score_id, pos, token FROM tok WHERE pos < 150", ("tok",))
def truncate(spark, d):
    return T.truncate(fx.tokens(spark, d), 150)


@register("t06_token_category", """
SELECT score_id, pos, CASE
  WHEN regexp_matches(token, '^(note|chord|rest|dur)-') THEN 'note/rest'
  WHEN token IN ('barline','barline-final','barline-start-repeat','barline-end-repeat')
    THEN 'barline'
  WHEN token = 'staff-bass' THEN 'staff-bass'
  WHEN regexp_matches(token, '^(clef|key|time)-') THEN 'header'
  WHEN regexp_matches(token, '^(dynamic|hairpin)-') THEN 'dynamic'
  WHEN regexp_matches(token, '^(artic-|ornament-|fermata$)') THEN 'artic'
  WHEN regexp_matches(token, 'slur|tuplet|ottava') THEN 'span' ELSE 'other' END AS category
FROM tok""", ("tok",))
def token_category(spark, d):
    return fx.tokens(spark, d).select("score_id", "pos", T.token_category("token")
                                      .alias("category"))


@register("t07_is_header", "SELECT score_id, pos, regexp_matches(token, '^(clef|key|time)-') AS "
          "header, regexp_matches(token, '^(clef|key|time)-|^<(SOS|EOS|PAD|UNK)>$') AS "
          "header_or_special FROM raw", ("raw",))
def is_header(spark, d):
    raw = T.explode_tokens(fx.labels(spark, d, specials=True))
    return raw.select("score_id", "pos", T.is_header("token").alias("header"),
                      T.is_header("token", specials=True).alias("header_or_special"))


@register("t08_is_grand", "SELECT * FROM grand", ("grand",))
def is_grand(spark, d):
    return S.is_grand(fx.tokens(spark, d))


@register("t09_duration_whole", f"SELECT score_id, pos, {ticks_sql('token')} AS ticks FROM tok "
          "WHERE regexp_matches(token, '^(dur|rest)-')", ("tok",))
def duration_whole(spark, d):
    return (fx.tokens(spark, d).filter(T.starts_with_any("token", ("dur-", "rest-")))
            .select("score_id", "pos", T.duration_ticks("token").alias("ticks")))


@register("t10_duration_quarters", f"SELECT score_id, pos, coalesce({ticks_sql('token')}, 24) / "
          "24.0::DOUBLE AS quarters FROM tok WHERE regexp_matches(token, '^(dur|rest)-')", ("tok",))
def duration_quarters(spark, d):
    return (fx.tokens(spark, d).filter(T.starts_with_any("token", ("dur-", "rest-")))
            .select("score_id", "pos", (T.duration_ticks_or_quarter("token") / 24.0)
                    .alias("quarters")))


@register("t11_normalize_pitch", f"SELECT score_id, pos, {SHARP_SQL.format('p')} AS pitch "
          f"FROM {NOTES_SQL}", ("tok",))
def normalize_pitch(spark, d):
    return _notes(spark, d).select("score_id", "pos", P.normalize_pitch("p").alias("pitch"))


@register("t12_pitch_to_midi", f"SELECT score_id, pos, {midi_sql('p')} AS midi FROM {NOTES_SQL}",
          ("tok",))
def pitch_to_midi(spark, d):
    return _notes(spark, d).select("score_id", "pos", P.pitch_to_midi("p").alias("midi"))


@register("t13_midi_to_pitch", """
SELECT event_id, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][CAST(n % 12 AS INT) + 1]
  || CAST(n // 12 - 1 AS VARCHAR) AS pitch
FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) + 20 AS n FROM events)""")
def midi_to_pitch(spark, d):
    n = F.regexp_extract("props", "[0-9]+", 0).cast("int") + 20
    return fx.table(spark, d, "events").select("event_id", P.midi_to_pitch(n).alias("pitch"))


_FREQ = f"440 * pow(2, ({midi_sql('p')} - 69) / 12.0::DOUBLE)"


@register("t14_note_frequency", f"SELECT score_id, pos, round({_FREQ}, 6) AS hz FROM {NOTES_SQL}",
          ("tok",))
def note_frequency(spark, d):
    return _notes(spark, d).select("score_id", "pos", F.round(P.note_frequency("p"), 6)
                                   .alias("hz"))


@register("t15_playback_velocity", f"""
SELECT score_id, pos, CASE WHEN hz IS NOT NULL THEN CAST(least(127, floor(100.5 + 25 * least(1.0,
  greatest(0.0, (261.63 - hz) / 206.63)))) AS INT) END AS velocity
FROM (SELECT *, {_FREQ} AS hz FROM {NOTES_SQL})""", ("tok",))
def playback_velocity(spark, d):
    v = F.when(P.pitch_to_midi("p").isNotNull(), P.playback_velocity("p"))
    return _notes(spark, d).select("score_id", "pos", v.alias("velocity"))


@register("t16_diatonic_step", f"SELECT score_id, pos, CAST(7 * {OCT_SQL} + "
          f"strpos('CDEFGAB', left(p, 1)) AS INT) AS step FROM {NOTES_SQL}", ("tok",))
def diatonic_step(spark, d):
    return _notes(spark, d).select("score_id", "pos", P.diatonic_step("p").alias("step"))


@register("t17_pitch_zone", f"""
SELECT score_id, pos, CASE WHEN clef = 'bass' THEN greatest(0, least(2, 4 - o))
  ELSE greatest(0, least(2, 6 - o)) END AS zone
FROM (SELECT *, {CLEF_SQL} AS clef, {OCT_SQL} AS o FROM {NOTES_SQL})""", ("tok",))
def pitch_zone(spark, d):
    return _notes(spark, d).select("score_id", "pos", P.pitch_zone("p", _clef()).alias("zone"))


@register("t18_pitch_row", f"""
SELECT score_id, pos, CASE WHEN clef = 'bass' THEN greatest(0, least(3, 4 - o))
  ELSE greatest(0, least(3, 6 - o)) END AS "row"
FROM (SELECT *, {CLEF_SQL} AS clef, {OCT_SQL} AS o FROM {NOTES_SQL})""", ("tok",))
def pitch_row(spark, d):
    return _notes(spark, d).select("score_id", "pos", P.pitch_row("p", _clef()).alias("row"))


_LABEL = ("CASE left({0}, length({0}) - 1) WHEN 'C#' THEN '1' WHEN 'D#' THEN '2' WHEN 'F#' THEN "
          "'3' WHEN 'G#' THEN '4' WHEN 'A#' THEN '5' ELSE left({0}, length({0}) - 1) END")


@register("t19_note_label", f"""
SELECT score_id, pos, {_LABEL.format('s')} AS label, {_LABEL.format('s')} || 'G' AS chord_label
FROM (SELECT score_id, pos, {SHARP_SQL.format('p')} AS s FROM {NOTES_SQL})""", ("tok",))
def note_label(spark, d):
    s = P.normalize_pitch("p")
    return _notes(spark, d).select(
        "score_id", "pos", P.note_label(s).alias("label"),
        P.chord_label(F.array(s, F.lit("G5"))).alias("chord_label"))


@register("t21_key_accidentals", """
SELECT score_id, key, letter, CASE
  WHEN n > 0 AND strpos('FCGDAEB', letter) <= n THEN '#'
  WHEN n < 0 AND strpos('BEADGCF', letter) <= -n THEN 'b' END AS accidental
FROM (SELECT score_id, substr(token, 5) AS key,
        list_position(['Gb','Db','Ab','Eb','Bb','F','C','G','D','A','E','B','F#'],
                      substr(token, 5)) - 7 AS n FROM tok WHERE token LIKE 'key-%'),
  (SELECT unnest(['A','B','C','D','E','F','G']) AS letter)""", ("tok",))
def key_accidentals(spark, d):
    keys = (fx.tokens(spark, d).filter(F.col("token").startswith("key-"))
            .select("score_id", T.suffix("token", "key-").alias("key"),
                    F.explode(F.array(*[F.lit(c) for c in "ABCDEFG"])).alias("letter")))
    return keys.withColumn("accidental", T.key_accidental("key", "letter"))


@register("t22_snap_duration", """
SELECT event_id, arg_min(t, (d, o)) AS token, min(d) > 1e-6 AS "off"
FROM (SELECT event_id, t, o, abs(q - v) AS d
      FROM (SELECT event_id, CAST(value AS DOUBLE) / 16 AS q FROM events),
        (VALUES (4.0, 0, '1/1'), (3.0, 1, '3/4'), (2.0, 2, '1/2'), (1.5, 3, '3/8'),
           (1.0, 4, '1/4'), (0.75, 5, '3/16'), (0.5, 6, '1/8'), (0.375, 7, '3/32'),
           (0.25, 8, '1/16'), (0.125, 9, '1/32')) AS w(v, o, t)) GROUP BY 1""")
def snap_duration(spark, d):
    s = P.snap_duration(F.col("value") / 16)
    return fx.table(spark, d, "events").select("event_id", s["token"].alias("token"),
                                               s["off"].alias("off"))


@register("t23_respell_pitch", """
SELECT event_id, CASE WHEN nm IN (sh, fl) THEN nm WHEN acc = '#' THEN sh ELSE fl END
    || CAST(midi // 12 - 1 AS VARCHAR) AS pitch,
  nm NOT IN (sh, fl) AS respelled, NOT (midi BETWEEN 36 AND 95) AS out_of_range
FROM (SELECT *, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][midi % 12 + 1] AS sh,
    ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'][midi % 12 + 1] AS fl
  FROM (SELECT event_id, CAST(k + 20 AS INT) AS midi,
      CASE k % 6 WHEN 0 THEN 'C' WHEN 1 THEN 'E#' WHEN 2 THEN 'Cb' WHEN 3 THEN 'G#'
        WHEN 4 THEN 'Bb' ELSE 'F' END AS nm,
      CASE k % 6 WHEN 1 THEN '#' WHEN 3 THEN '#' WHEN 2 THEN 'b' WHEN 4 THEN 'b' END AS acc
    FROM (SELECT event_id, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k FROM events)))""")
def respell_pitch(spark, d):
    ev = fx.table(spark, d, "events").select(
        "event_id", F.regexp_extract("props", "[0-9]+", 0).cast("int").alias("k"))
    k = F.col("k") % 6
    name = (F.when(k == 0, "C").when(k == 1, "E#").when(k == 2, "Cb").when(k == 3, "G#")
            .when(k == 4, "Bb").otherwise("F"))
    acc = F.when(k.isin(1, 3), "#").when(k.isin(2, 4), "b")
    r = P.respell_pitch(F.col("k") + 20, name, acc)
    return ev.select("event_id", r["pitch"].alias("pitch"), r["respelled"].alias("respelled"),
                     r["out_of_range"].alias("out_of_range"))


@register("t24_interval_degree", f"""
SELECT score_id, pos, CAST((strpos('CDEFGAB', left(p, 1)) - strpos('CDEFGAB', 'E') + 7) % 7 + 1
  AS INT) AS degree FROM {NOTES_SQL}""", ("tok",))
def interval_degree(spark, d):
    return _notes(spark, d).select("score_id", "pos",
                                   P.interval_degree(F.lit("E4"), "p").cast("int")
                                   .alias("degree"))


@register("t25_staff_position", f"""
SELECT score_id, pos, CAST(s AS INT) AS step,
  CAST(CASE WHEN s < 0 THEN (-s) // 2 WHEN s > 8 THEN (s - 8) // 2 ELSE 0 END AS INT) AS ledgers
FROM (SELECT *, strpos('CDEFGAB', left(p, 1)) - 3 + 7 * ({OCT_SQL} - 4) AS s FROM {NOTES_SQL})""",
          ("tok",))
def staff_position(spark, d):
    return _notes(spark, d).select("score_id", "pos", P.staff_position("p").alias("step"),
                                   P.ledger_lines("p").alias("ledgers"))


@register("t26_upload_files", """
SELECT doc_id, regexp_matches(lower(f), '[.](jpg|jpeg)$') AS is_photo,
  CASE WHEN f = '' THEN '새 악보' WHEN doc_id % 5 = 3 THEN f ELSE regexp_replace(f, '[.][^.]*$', '')
  END AS stem
FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN source || '.v2.png' WHEN 1 THEN source || '.JPG'
  WHEN 2 THEN lang || '.jpeg' WHEN 3 THEN source ELSE '' END AS f FROM documents)""")
def upload_files(spark, d):
    m = F.col("doc_id") % 5
    name = (F.when(m == 0, F.concat("source", F.lit(".v2.png")))
            .when(m == 1, F.concat("source", F.lit(".JPG")))
            .when(m == 2, F.concat("lang", F.lit(".jpeg")))
            .when(m == 3, F.col("source")).otherwise(""))
    return fx.table(spark, d, "documents").select(
        "doc_id", T.is_real_photo(name).alias("is_photo"), T.upload_stem(name).alias("stem"))


@register("t27_normalize_job_status", """
SELECT job_id, event_id, CASE WHEN status IN ('FAILED', 'CANCELLED', 'TIMED_OUT') THEN 'FAILED'
  WHEN status = 'COMPLETED' AND output LIKE '%"error"%' THEN 'FAILED'
  ELSE coalesce(status, 'UNKNOWN') END AS status FROM jobs""", ("jobs",))
def normalize_job_status(spark, d):
    return job_events(spark, d).select("job_id", "event_id",
                                       T.normalize_job_status("status", "output").alias("status"))
