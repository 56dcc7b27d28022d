"""Queries over note events, layout, practice and documents (T20, Q21-Q25, N1-N10, P, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import notes as N
from ..operators import practice as PR
from ..operators import sequence as S
from ..sources import fixtures as fx
from .base import SHARP_SQL, add_cte, midi_sql, register, ticks_sql, voice_sql
from .token_queries import _LABEL

_ANY_BAR = "token LIKE 'barline%'"


def _segments_sql(src: str, layout: bool) -> str:
    """A segment starts at every note, rest or closing token."""
    closing = "token LIKE 'clef-%'" if layout else "token LIKE 'tuplet-3-%'"
    return f"""
SELECT *, sum(CASE WHEN head OR closer THEN 1 ELSE 0 END) OVER w AS seg,
  sum(CASE WHEN closer THEN 1 ELSE 0 END) OVER w AS run,
  last_value(CASE WHEN token LIKE 'tuplet-3-%' THEN token END IGNORE NULLS) OVER w AS tup
FROM (SELECT *, token LIKE 'note-%' OR token LIKE 'rest-%' AS head,
    token LIKE 'rest-%' OR token = 'staff-bass' OR {_ANY_BAR} OR {closing} AS closer FROM {src})
WINDOW w AS (PARTITION BY score_id ORDER BY pos)"""


def _events_sql(src: str) -> str:
    return f"""
SELECT *, lead(seg) OVER (PARTITION BY score_id ORDER BY seg) AS next_seg FROM (
SELECT score_id, seg, min(pos) AS pos, arg_min(token, pos) AS first_token,
  arg_min(measure_idx, pos) AS measure_idx, arg_min(voice, pos) AS voice, min(run) AS run,
  bool_or(head AND token LIKE 'rest-%') AS is_rest, bool_or(head) AS is_event,
  arg_max(token, pos) FILTER (token LIKE 'dur-%') AS dur,
  coalesce(string_agg({SHARP_SQL.format('substr(token, 7)')}, ',' ORDER BY pos)
    FILTER (token LIKE 'chord-%'), '') AS chord,
  arg_max(substr(token, 9), pos) FILTER (token LIKE 'dynamic-%') AS dyn,
  bool_or(token = 'tie') AS tie, arg_min(tup, pos) = 'tuplet-3-start' AS in_tuplet
FROM {src} GROUP BY score_id, seg)"""


def _heads_sql(src: str) -> str:
    return f"""
SELECT score_id, seg, pos, measure_idx, voice, run, is_rest,
  CASE WHEN is_rest THEN '' ELSE {SHARP_SQL.format("substr(first_token, 6)")} END AS pitch,
  coalesce(CASE WHEN is_rest THEN {ticks_sql('first_token')} ELSE {ticks_sql('dur')} END, 24) AS t,
  CASE WHEN is_rest THEN '' ELSE chord END AS chord, CASE WHEN NOT is_rest THEN dyn END AS dyn,
  NOT is_rest AND tie AS tie, coalesce(in_tuplet, false) AS in_tuplet
FROM {src} WHERE is_event"""


def _chains_sql(src: str, tied: str = "lag(tie) OVER w") -> str:
    return f"""
SELECT score_id, chain, min(pos) AS pos, any_value(measure_idx) AS measure_idx,
  any_value(voice) AS voice, any_value(is_rest) AS is_rest, any_value(pitch) AS pitch,
  CAST(sum(t) AS INT) AS raw, arg_max(chord, seg) AS chord,
  arg_max(dyn, seg) FILTER (dyn IS NOT NULL) AS dynamic, any_value(in_tuplet) AS tuplet
FROM (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY seg)
    AS chain FROM (
  SELECT *, coalesce(NOT is_rest AND NOT lag(is_rest) OVER w AND lag(run) OVER w = run
    AND lag(pitch) OVER w = pitch AND ({tied}), false) AS joined
  FROM {src} WINDOW w AS (PARTITION BY score_id ORDER BY seg)))
GROUP BY score_id, chain"""


def _notes_sql(src: str) -> str:
    return f"""
SELECT c.score_id, c.voice AS staff, CAST(row_number() OVER (PARTITION BY c.score_id, c.voice
    ORDER BY c.pos) - 1 AS INT) AS note_idx, measure_idx, pitch, ticks,
  CAST(coalesce(sum(least(4, greatest(1, round_even(ticks / 24.0, 0)))) OVER (PARTITION BY
    c.score_id, c.voice, measure_idx ORDER BY c.pos ROWS BETWEEN UNBOUNDED PRECEDING AND
    1 PRECEDING), 0) % 4 + 1 AS INT) AS beat, chord, is_rest, dynamic,
  CASE WHEN e.pos IS NOT NULL THEN 'end-repeat' WHEN s.pos IS NOT NULL THEN 'start-repeat' END
    AS repeat, tuplet
FROM (SELECT *, CAST(CASE WHEN tuplet THEN raw * 2 // 3 ELSE raw END AS INT) AS ticks FROM {src}) c
LEFT JOIN (SELECT DISTINCT score_id, (SELECT min(c.pos) FROM {src} c WHERE c.score_id = t.score_id
    AND c.pos > t.pos) AS pos FROM tok t WHERE token = 'barline-start-repeat') s
  ON s.score_id = c.score_id AND s.pos = c.pos
LEFT JOIN (SELECT DISTINCT score_id, (SELECT max(c.pos) FROM {src} c WHERE c.score_id = t.score_id
    AND c.voice = t.voice AND c.pos < t.pos) AS pos FROM nmv t
    WHERE token = 'barline-end-repeat') e ON e.score_id = c.score_id AND e.pos = c.pos"""


add_cte("nmv", voice_sql("tok", "notes"), "tok")
add_cte("nseg", _segments_sql("nmv", False), "nmv")
add_cte("nev", _events_sql("nseg"), "nseg")
add_cte("nheads", _heads_sql("nev"), "nev")
add_cte("chains", _chains_sql("nheads"), "nheads")
add_cte("notes", _notes_sql("chains"), "chains", "tok", "nmv")
# Compatible ties: loose tie marks since the previous note arm the next one.
add_cte("nloose", """
SELECT h.*, coalesce((SELECT max(b.pos) FROM nseg b WHERE b.score_id = h.score_id AND
    b.token = 'tie' AND b.pos < h.pos AND NOT EXISTS (SELECT 1 FROM nheads n WHERE
      n.score_id = b.score_id AND n.seg = b.seg AND NOT n.is_rest)), -1)
  > coalesce((SELECT max(n.pos) FROM nheads n WHERE n.score_id = h.score_id AND n.pos < h.pos
      AND NOT n.is_rest), -1) AS armed
FROM nheads h""", "nseg", "nheads")
add_cte("cchains", _chains_sql("nloose", "lag(tie) OVER w OR lag(armed) OVER w"), "nloose")
add_cte("cnotes", _notes_sql("cchains"), "cchains", "tok", "nmv")
add_cte("lmv", voice_sql("tok", "dataset"), "tok")
add_cte("lseg", _segments_sql("lmv", True), "lmv")
add_cte("lev", _events_sql("lseg"), "lseg")
add_cte("lheads", _heads_sql("lev"), "lev")
add_cte("lchains", _chains_sql("lheads"), "lheads")
add_cte("layout", """
SELECT score_id, voice AS staff, CAST(row_number() OVER w - 1 AS INT) AS note_idx, pitch,
  raw AS ticks, chord, is_rest, coalesce((SELECT arg_max(CASE WHEN token = 'clef-F' THEN 'bass'
      ELSE 'treble' END, m.pos) FROM lmv m WHERE m.score_id = c.score_id AND m.voice = c.voice
      AND m.pos < c.pos AND token IN ('clef-F', 'clef-G')), voice) AS clef,
  coalesce(lag(measure_idx) OVER w <> measure_idx, true) AS measure_start
FROM lchains c WINDOW w AS (PARTITION BY score_id, voice ORDER BY pos)""", "lchains", "lmv")
add_cte("attrs", """
SELECT s.score_id, CAST(coalesce(split_part(substr(t, 6), '/', 1), '4') AS INT) AS time_num,
  CAST(coalesce(split_part(substr(t, 6), '/', 2), '4') AS INT) AS time_den,
  CASE WHEN u = 'clef-F' THEN 'bass' ELSE 'treble' END AS clef_upper,
  CASE WHEN l IS NULL OR l = 'clef-F' THEN 'bass' ELSE 'treble' END AS clef_lower
FROM (SELECT score_id, arg_max(token, pos) FILTER (token LIKE 'time-%') AS t,
  arg_max(token, pos) FILTER (token LIKE 'clef-%' AND voice = 'treble') AS u,
  arg_max(token, pos) FILTER (token LIKE 'clef-%' AND voice = 'bass') AS l FROM nmv GROUP BY 1) s""",
        "nmv")


def _flat(df):
    return df.withColumn("chord", F.array_join("chord", ","))


def notes_of(spark, d, **kw):
    return N.tokens_to_notes(fx.tokens(spark, d), **kw)


def layout_of(spark, d):
    return N.tokens_to_layout_notes(fx.tokens(spark, d))


@register("n01_tokens_to_notes", "SELECT * FROM notes", ("notes",))
def tokens_to_notes(spark, d):
    return _flat(notes_of(spark, d))


@register("n02_note_grouping", """
SELECT score_id, staff, note_idx, pitch, ticks, is_rest FROM notes""", ("notes",))
def note_grouping(spark, d):
    return notes_of(spark, d).select("score_id", "staff", "note_idx", "pitch", "ticks", "is_rest")


@register("n03_chord_attach", """
SELECT score_id, staff, note_idx, chord, CAST(len(string_split(chord, ',')) AS INT) AS n_tones
FROM notes WHERE chord <> ''""", ("notes",))
def chord_attach(spark, d):
    n = notes_of(spark, d).filter(F.size("chord") > 0)
    return _flat(n.select("score_id", "staff", "note_idx", "chord",
                          F.size("chord").alias("n_tones")))


@register("n04_dynamics", """
SELECT n.score_id, n.staff, n.note_idx, n.dynamic AS attached, f.dynamic AS forward
FROM notes n JOIN (SELECT c.*, CAST(row_number() OVER (PARTITION BY score_id, voice ORDER BY pos) - 1
    AS INT) AS note_idx FROM (SELECT score_id, chain, min(pos) AS pos, any_value(voice) AS voice,
      arg_max(coalesce(dyn, carried), seg) FILTER (coalesce(dyn, carried) IS NOT NULL) AS dynamic
    FROM (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY seg)
        AS chain FROM (SELECT h.*, coalesce(NOT is_rest AND NOT lag(is_rest) OVER w AND
          lag(run) OVER w = run AND lag(pitch) OVER w = pitch AND lag(tie) OVER w, false) AS joined,
          CASE WHEN NOT is_rest THEN (SELECT arg_max(substr(t.token, 9), t.pos) FROM nseg t WHERE
            t.score_id = h.score_id AND t.token LIKE 'dynamic-%' AND t.pos < h.pos AND t.pos >
            coalesce((SELECT max(p.pos) FROM nheads p WHERE p.score_id = h.score_id
              AND p.pos < h.pos), -1) AND NOT EXISTS (SELECT 1 FROM nheads q WHERE
              q.score_id = t.score_id AND q.seg = t.seg AND NOT q.is_rest)) END AS carried
        FROM nheads h WINDOW w AS (PARTITION BY score_id ORDER BY seg))) GROUP BY 1, 2) c) f
  ON n.score_id = f.score_id AND n.staff = f.voice AND n.note_idx = f.note_idx
WHERE n.dynamic IS NOT NULL OR f.dynamic IS NOT NULL""", ("notes", "nseg", "nheads"))
def dynamics(spark, d):
    keys = ["score_id", "staff", "note_idx"]
    a = notes_of(spark, d).select(*keys, F.col("dynamic").alias("attached"))
    f = notes_of(spark, d, dynamics="forward").select(*keys, F.col("dynamic").alias("forward"))
    return a.join(f, keys).filter("attached IS NOT NULL OR forward IS NOT NULL")


@register("n05_tie_merge_compat", "SELECT * FROM cnotes", ("cnotes",))
def tie_merge_compat(spark, d):
    return _flat(notes_of(spark, d, compat=True))


@register("n06_tuplets", "SELECT score_id, staff, note_idx, ticks FROM notes WHERE tuplet",
          ("notes",))
def tuplets(spark, d):
    return notes_of(spark, d).filter("tuplet").select("score_id", "staff", "note_idx", "ticks")


@register("n07_repeat_marks", "SELECT score_id, staff, note_idx, repeat FROM notes WHERE repeat "
          "IS NOT NULL", ("notes",))
def repeat_marks(spark, d):
    return notes_of(spark, d).filter("repeat IS NOT NULL").select("score_id", "staff", "note_idx",
                                                                  "repeat")


@register("n08_beats", "SELECT score_id, staff, measure_idx, note_idx, beat FROM notes", ("notes",))
def beats(spark, d):
    return notes_of(spark, d).select("score_id", "staff", "measure_idx", "note_idx", "beat")


@register("n09_score_attributes", "SELECT * FROM attrs", ("attrs",))
def score_attributes(spark, d):
    return N.score_attributes(fx.tokens(spark, d))


@register("n10_layout_notes", "SELECT * FROM layout", ("layout",))
def layout_notes(spark, d):
    return _flat(layout_of(spark, d))


@register("t20_effective_clef", """
SELECT score_id, staff, min(clef) <> max(clef) AS has_mixed_clef FROM layout GROUP BY 1, 2""",
          ("layout",))
def effective_clef(spark, d):
    attrs = N.score_attributes(fx.tokens(spark, d))
    return N.mixed_clef(N.with_staff_clef(layout_of(spark, d), attrs))


@register("s12_score_document", """
SELECT n.score_id, upper, lower, time_num, time_den,
  CASE WHEN lower > 0 THEN clef_upper || ',' || clef_lower END AS staff_clefs,
  quarters AS upper_quarters
FROM (SELECT score_id, CAST(count(*) FILTER (staff = 'treble') AS INT) AS upper,
    CAST(count(*) FILTER (staff = 'bass') AS INT) AS lower,
    CAST(sum(ticks) FILTER (staff = 'treble') AS BIGINT) AS quarters FROM notes GROUP BY 1) n
JOIN attrs USING (score_id)""", ("notes", "attrs"))
def score_document(spark, d):
    """Writes the documents as JSON text and reads the facts back out of the text."""
    t = fx.tokens(spark, d)
    docs = N.to_score_document(N.tokens_to_notes(t), N.score_attributes(t))
    schema = ("id string, tempo int, timeSignature array<int>, notes array<struct<pitch:string,"
              "duration:double,beat:int>>, staves array<struct<clef:string,"
              "notes:array<struct<pitch:string,duration:double>>>>")
    j = F.from_json("document", schema)
    return docs.withColumn("j", j).select(
        "score_id", F.size("j.notes").alias("upper"),
        F.when(F.col("j.staves").isNull(), 0).otherwise(F.size(F.get("j.staves", F.lit(1))["notes"]))
        .alias("lower"),
        F.get("j.timeSignature", F.lit(0)).alias("time_num"),
        F.get("j.timeSignature", F.lit(1)).alias("time_den"),
        F.array_join(F.col("j.staves.clef"), ",").alias("staff_clefs"),
        F.round(F.aggregate("j.notes", F.lit(0.0), lambda a, n: a + n["duration"]) * 24, 0)
        .cast("bigint").alias("upper_quarters"))


def stored_documents(spark, d):
    """Every score as the text of its document, with a title and a creation time."""
    t = fx.tokens(spark, d)
    meta = fx.labels(spark, d).filter(F.size("tokens") > 0).select(
        "score_id", F.concat(F.lit('Étude "'), F.col("score_id").cast("string"), F.lit('"')).alias("title"),
        (F.col("score_id") * 1000 + 7).alias("created_at"))
    return N.to_score_document(N.tokens_to_notes(t), N.score_attributes(t), meta)


@register("s15_read_documents", """
SELECT CAST(n.score_id AS VARCHAR) AS id, 'Étude "' || n.score_id || '"' AS title, n.score_id * 1000 + 7 AS
  created_at, time_num, time_den, staff, CASE WHEN NOT is_grand THEN 'treble' WHEN staff = 'bass' THEN clef_lower
  ELSE clef_upper END AS staff_clef, note_idx, pitch, ticks, beat, chord, is_rest, dynamic, repeat, tuplet
FROM notes n JOIN attrs USING (score_id) JOIN (SELECT score_id, bool_or(staff = 'bass') AS is_grand FROM notes
  GROUP BY 1) g USING (score_id)""", ("notes", "attrs"))
def read_documents(spark, d):
    """Writes every score as a document and reads its notes back."""
    return _flat(N.read_score_documents(stored_documents(spark, d)).drop("tempo"))


# -- layout ------------------------------------------------------------------------------------

add_cte("bm", """
SELECT *, CAST(sum(CASE WHEN beat = 1 AND note_idx > 0 THEN 1 ELSE 0 END) OVER
  (PARTITION BY score_id, staff ORDER BY note_idx) AS INT) AS beat_measure FROM notes""", "notes")


@register("q21_split_measures_by_beat", "SELECT score_id, staff, note_idx, beat_measure FROM bm",
          ("bm",))
def split_measures_by_beat(spark, d):
    return S.split_measures_by_beat(notes_of(spark, d)).select("score_id", "staff", "note_idx",
                                                               "beat_measure")


@register("q22_first_measure", """
SELECT n.score_id, n.staff, note_idx, pitch FROM notes n LEFT JOIN (
  SELECT score_id, staff, list_sort(list(note_idx))[2] AS cut FROM notes WHERE beat = 1 GROUP BY 1, 2)
  c ON c.score_id = n.score_id AND c.staff = n.staff WHERE cut IS NULL OR note_idx < cut""",
          ("notes",))
def first_measure(spark, d):
    return S.first_measure(notes_of(spark, d)).select("score_id", "staff", "note_idx", "pitch")


add_cte("lay", """
SELECT *, greatest(ticks * 80 / 24.0::DOUBLE, 44) AS w,
  CAST(greatest(sum(CASE WHEN measure_start THEN 1 ELSE 0 END) OVER (PARTITION BY score_id, staff
    ORDER BY note_idx), 1) - 1 AS INT) AS layout_measure FROM layout""", "layout")


@register("q23_clef_runs", """
SELECT score_id, staff, layout_measure, CAST(run_idx AS BIGINT) AS run_idx, any_value(clef) AS clef,
  round(min(x), 6) AS x, round(sum(w), 6) AS width
FROM (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER p AS run_idx, 20 + sum(w) OVER p - w AS x
  FROM (SELECT *, coalesce(lag(clef) OVER (PARTITION BY score_id, staff, layout_measure
      ORDER BY note_idx) <> clef, false) AS new FROM lay)
  WINDOW p AS (PARTITION BY score_id, staff, layout_measure ORDER BY note_idx))
GROUP BY 1, 2, 3, 4""", ("lay",))
def clef_runs(spark, d):
    return (S.clef_runs(layout_of(spark, d)).withColumn("x", F.round("x", 6))
            .withColumn("width", F.round("width", 6)))


@register("q24_cell_layout", f"""
SELECT n.score_id, n.staff, n.note_idx,
  round(72 + (sum(ticks) OVER w - ticks) * 80 / 24.0::DOUBLE, 6) AS x,
  round(ticks * 80 / 24.0::DOUBLE - 4, 6) AS w,
  CASE WHEN is_rest THEN 1 WHEN c = 'bass' THEN greatest(0, least(2, 4 - o))
    ELSE greatest(0, least(2, 6 - o)) END AS zone, label
FROM (SELECT *, CASE WHEN staff = 'bass' THEN clef_lower ELSE clef_upper END AS c,
        TRY_CAST(right(pitch, 1) AS INT) AS o FROM notes JOIN attrs USING (score_id)) n
LEFT JOIN (SELECT score_id, staff, note_idx, string_agg({_LABEL.format('p')} ||
      CASE WHEN right(p, 1) <> ref THEN right(p, 1) ELSE '' END, '/'
      ORDER BY -{midi_sql('p')} NULLS FIRST, p) AS label
    FROM (SELECT score_id, staff, note_idx, right(pitch, 1) AS ref, unnest(string_split(pitch ||
        CASE WHEN chord = '' THEN '' ELSE ',' || chord END, ',')) AS p FROM notes
      WHERE NOT is_rest) GROUP BY 1, 2, 3) l
  ON l.score_id = n.score_id AND l.staff = n.staff AND l.note_idx = n.note_idx
WINDOW w AS (PARTITION BY n.score_id, n.staff ORDER BY n.note_idx)""", ("notes", "attrs"))
def cell_layout(spark, d):
    t = fx.tokens(spark, d)
    n = N.with_staff_clef(N.tokens_to_notes(t), N.score_attributes(t))
    return (S.cell_layout(n).withColumn("x", F.round("x", 6)).withColumn("w", F.round("w", 6)))


@register("q24_cell_layout_min_width", """
SELECT score_id, staff, note_idx, round(20 + sum(w) OVER (PARTITION BY score_id, staff
  ORDER BY note_idx) - w, 3) AS x, round(w - 4, 6) AS w FROM lay""", ("lay",))
def cell_layout_min_width(spark, d):
    n = layout_of(spark, d).withColumn("staff_clef", F.col("clef"))
    return S.cell_layout(n, min_width=True).select(
        "score_id", "staff", "note_idx", F.round("x", 3).alias("x"), F.round("w", 6).alias("w"))


@register("q25_measure_widths", """
SELECT score_id, beat_measure, CAST(46 + 42 * max(c) + CASE WHEN beat_measure = 0 THEN 60 ELSE 0 END
  AS BIGINT) AS width
FROM (SELECT score_id, beat_measure, staff, count(*) AS c FROM bm GROUP BY 1, 2, 3) GROUP BY 1, 2""",
          ("bm",))
def measure_widths(spark, d):
    return S.measure_widths(S.split_measures_by_beat(notes_of(spark, d)))


# -- playback and practice ---------------------------------------------------------------------

add_cte("sched", """
SELECT score_id, staff, note_idx, onset AS onset_ticks, ticks, CAST(unnest(range(len(ps))) AS INT)
  AS tone, unnest(ps) AS pitch
FROM (SELECT *, sum(ticks) OVER (PARTITION BY score_id, staff ORDER BY note_idx) - ticks AS onset,
    string_split(pitch || CASE WHEN chord = '' THEN '' ELSE ',' || chord END, ',') AS ps FROM notes)
WHERE NOT is_rest""", "notes")
_SCHED = """SELECT score_id, staff, note_idx, CAST(onset_ticks - base AS BIGINT) AS onset_ticks,
  round((onset_ticks - base) * 60.0 / (24 * {tempo}), 6) AS onset_sec,
  round(ticks * 60.0 / (24 * {tempo}) * 0.9, 6) AS sounding_sec, tone, pitch FROM ({src})"""


def _sched_types(df):
    return (df.withColumn("onset_sec", F.round("onset_sec", 6))
            .withColumn("sounding_sec", F.round("sounding_sec", 6)))


@register("p01_merged_schedule", _SCHED.format(tempo=96, src="SELECT *, 0 AS base FROM sched"),
          ("sched",))
def merged_schedule(spark, d):
    return _sched_types(PR.merged_schedule(notes_of(spark, d), 96))


@register("p02_part_schedule", _SCHED.format(tempo=120, src="""
SELECT s.*, base FROM sched s JOIN (SELECT score_id, sum(ticks) FILTER (note_idx < 5) AS base
  FROM notes WHERE staff = 'bass' GROUP BY 1) b USING (score_id)
WHERE staff = 'bass' AND note_idx >= 5"""), ("sched", "notes"))
def part_schedule(spark, d):
    return _sched_types(PR.part_schedule(notes_of(spark, d), "bass", 5, 120))


@register("p03_wait_timeline", """
SELECT score_id, staff, note_idx, CAST(sum(ticks) OVER (PARTITION BY score_id, staff ORDER BY
    note_idx) - ticks AS BIGINT) AS at_ticks,
  (SELECT min(m.note_idx) FROM notes m WHERE m.score_id = n.score_id AND m.staff = n.staff AND
    m.note_idx > n.note_idx AND NOT m.is_rest) AS next_idx,
  CASE WHEN NOT is_rest THEN pitch END AS expected,
  CASE WHEN is_rest THEN round(ticks * 60.0 / (24 * 80), 6) END AS skip_sec
FROM notes n""", ("notes",))
def wait_timeline(spark, d):
    return PR.wait_timeline(notes_of(spark, d), 80).withColumn("skip_sec", F.round("skip_sec", 6))


add_cte("steps", """
SELECT score_id, staff, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY beat_measure) - 1
  AS INT) AS measure, note_idx, beat, pitch || CASE WHEN chord = '' THEN '' ELSE ',' || chord END
  AS pitches FROM bm WHERE NOT is_rest""", "bm")


@register("p04_performance_steps", """
SELECT s.score_id, staff, measure, CAST(row_number() OVER (PARTITION BY s.score_id, staff, measure
    ORDER BY note_idx) - 1 AS INT) AS step, beat, pitches,
  CASE WHEN bool_or(staff = 'bass') OVER (PARTITION BY s.score_id) THEN 150 ELSE 100 END AS max_score
FROM steps s""", ("steps",))
def performance_steps(spark, d):
    return (PR.performance_steps(notes_of(spark, d))
            .withColumn("pitches", F.array_join("pitches", ",")))


@register("p04_performance_steps_compat", """
SELECT score_id, staff, measure, CAST(row_number() OVER (PARTITION BY score_id, staff, measure
    ORDER BY note_idx) - 1 AS INT) AS step, beat, pitches, 100 AS max_score
FROM (SELECT score_id, staff, note_idx, beat, pitch || CASE WHEN chord = '' THEN '' ELSE ',' || chord
    END AS pitches, CAST(sum(CASE WHEN beat = 1 AND r > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY
      score_id ORDER BY note_idx) AS INT) AS measure
  FROM (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY note_idx) AS r FROM notes
        WHERE staff = 'treble' AND NOT is_rest))""", ("notes",))
def performance_steps_compat(spark, d):
    return (PR.performance_steps(notes_of(spark, d), hand="both", midi_confirmed=False, compat=True)
            .withColumn("pitches", F.array_join("pitches", ",")))


@register("p05_final_score", """
SELECT o_orderkey AS session_id, CASE WHEN ranked THEN CASE WHEN hint THEN
    greatest(0.0, floor((base - 10) * 10 + 0.5) / 10) ELSE base END END AS score
FROM (SELECT *, CASE WHEN correct + wrong > 0 THEN floor(correct / (correct + wrong) * mx * 10 + 0.5)
    / 10 ELSE 0.0::DOUBLE END AS base
  FROM (SELECT o_orderkey, o_custkey % 50 AS correct, o_orderkey % 13 AS wrong,
      CASE WHEN o_orderkey % 2 = 0 THEN 150 ELSE 100 END AS mx,
      o_orderpriority = '1-URGENT' AS hint, o_orderstatus <> 'P' AS ranked FROM orders))""")
def final_score(spark, d):
    o = fx.table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("session_id"), PR.final_score(
        F.col("o_custkey") % 50, F.col("o_orderkey") % 13,
        F.when(F.col("o_orderkey") % 2 == 0, 150).otherwise(100),
        F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") != "P").alias("score"))


def leaderboard(spark, d):
    """Entries: song = priority, nickname = customer (a third play without a name)."""
    return fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("song"),
        F.when(F.col("o_custkey") % 3 == 0, "익명").otherwise(
            F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("nickname"),
        F.when(F.col("o_orderkey") % 11 != 0,
               F.floor(F.col("o_totalprice")) % 1500 / 10.0).alias("score"),
        F.col("o_orderdate").alias("created_at"))


add_cte("lb", """
SELECT o_orderkey AS entry_id, o_orderpriority AS song, CASE WHEN o_custkey % 3 = 0 THEN '익명'
  ELSE 'p' || o_custkey END AS nickname, CASE WHEN o_orderkey % 11 <> 0 THEN
  floor(o_totalprice)::BIGINT % 1500 / 10.0::DOUBLE END AS score, o_orderdate AS created_at
FROM orders""")


@register("k01_leaderboard_topk", """
SELECT song, nickname, score, entry_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY song ORDER BY coalesce(score, 0) DESC, created_at, entry_id) AS rank FROM lb)
WHERE rank <= 3""", ("lb",))
def leaderboard_topk(spark, d):
    return PR.leaderboard_topk(leaderboard(spark, d), 3).select("song", "nickname", "score",
                                                                "entry_id", "rank")


@register("k02_time_merge", """
SELECT score_id, CAST(onset_ticks AS BIGINT) AS onset_ticks, staff, note_idx, pitch FROM sched
ORDER BY score_id, onset_ticks, staff DESC, note_idx, tone""", ("sched",))
def time_merge(spark, d):
    """Both staves of a score on one clock; a score's tones lie together in one partition, in order."""
    return (PR.merged_schedule(notes_of(spark, d))
            .sortWithinPartitions("score_id", "onset_ticks", F.desc("staff"), "note_idx", "tone")
            .select("score_id", "onset_ticks", "staff", "note_idx", "pitch"))


@register("k03_first_pairs", "SELECT doc_id, source || '_' || doc_id AS stem FROM documents JOIN "
          "labels USING (doc_id) ORDER BY stem LIMIT 200")
def first_pairs(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", F.concat_ws("_", "source", "doc_id")
                                                  .alias("stem"))
    return PR.first_pairs(docs.join(fx.table(spark, d, "labels").select("doc_id"), "doc_id"), 200)


@register("k04_chord_top", f"""
SELECT score_id, staff, note_idx, arg_max(p, (coalesce({midi_sql('p')}, -1), p)) AS top
FROM (SELECT score_id, staff, note_idx, unnest(string_split(pitch || CASE WHEN chord = '' THEN ''
  ELSE ',' || chord END, ',')) AS p FROM notes WHERE NOT is_rest) GROUP BY 1, 2, 3""", ("notes",))
def chord_top(spark, d):
    return PR.chord_top(notes_of(spark, d))


@register("k05_stem_sets", """
SELECT coalesce(a, b) AS stem, CASE WHEN a IS NULL THEN 'label_only' WHEN b IS NULL THEN 'image_only'
  ELSE 'both' END AS side
FROM (SELECT DISTINCT source || '_' || doc_id AS a FROM documents WHERE lang <> 'de') x FULL JOIN
  (SELECT DISTINCT d.source || '_' || d.doc_id AS b FROM documents d JOIN labels USING (doc_id)) y
  ON a = b""")
def stem_sets(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", F.concat_ws("_", "source", "doc_id")
                                                  .alias("stem"))
    labelled = docs.join(fx.table(spark, d, "labels").select("doc_id"), "doc_id")
    return PR.stem_sets(docs.filter("lang <> 'de'"), labelled)


@register("k06_shared_result", "SELECT doc_id AS id, source AS title FROM documents WHERE doc_id = 17")
def shared_result(spark, d):
    docs = fx.table(spark, d, "documents").select(F.col("doc_id").alias("id"),
                                                  F.col("source").alias("title"))
    return PR.shared_result(docs, 17)
