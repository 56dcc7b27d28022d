"""Queries over sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.tokens import normalize_job_status
from ..functions.vocab import load_vocab, vocab_dim
from ..operators import library as L
from ..operators import practice as PR
from ..operators import stats as ST
from ..sources import fixtures as fx
from ..sources import labels as LB
from ..sources import midi as MD
from ..sources import performances as PF
from ..sources.jobs import JOBS_SQL, job_events
from ..sources.raw_midi import RawMidi
from ..sources.storage import new_path
from ..streaming import folds as FO
from ..streaming import sessions as SS
from .base import add_cte, midi_sql, register
from .dataset_queries import epoch_log
from .evaluate_queries import _round
from .note_queries import leaderboard

add_cte("midi", MD.MIDI_SQL.format(events="events"))
add_cte("presses", """
SELECT session_id, seq, t_ms, kind, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][d1 % 12 + 1]
  || CAST(d1 // 12 - 1 AS VARCHAR) AS pitch, d2 AS velocity
FROM (SELECT *, CASE WHEN status & 240 = 144 AND d2 > 0 THEN 'on' WHEN status & 240 = 128 OR
  (status & 240 = 144 AND d2 = 0) THEN 'off' END AS kind FROM midi) WHERE kind IS NOT NULL""", "midi")
add_cte("jobst", """
SELECT job_id, event_id, event_id * 100000 AS t_ms, CASE WHEN status IN ('FAILED', 'CANCELLED',
  'TIMED_OUT') OR (status = 'COMPLETED' AND output LIKE '%"error"%') THEN 'FAILED'
  ELSE coalesce(status, 'UNKNOWN') END AS status FROM jobs""", "jobs")


# -- files -------------------------------------------------------------------------------------

@register("s01_read_labels", "SELECT score_id, CAST(count(*) AS INT) AS n_tokens, CAST(NULL AS VARCHAR) "
          "AS skipped FROM tok GROUP BY 1", ("tok",))
def read_labels(spark, d):
    """Writes the whole corpus as label files and reads it back."""
    path = new_path(spark, "labels")
    LB.write_labels(fx.labels(spark, d, specials=True).select(
        "score_id", F.posexplode("tokens").alias("pos", "token")), path)
    r = LB.read_labels(spark, path)
    return r.select(F.col("score_id").cast("bigint").alias("score_id"),
                    F.size("tokens").alias("n_tokens"), "skipped")


def _metrics(spark, rows, count, name: str):
    """The metrics of writing ``rows``, as a row."""
    seen = Observation(name)
    count(rows, seen).write.parquet(new_path(spark, name))
    got = seen.get
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} bigint" for k in got))


@register("s01_label_counts", "SELECT count(DISTINCT score_id) AS rows, count(DISTINCT score_id) FILTER (score_id % 4 <> "
          "1) AS read, CAST(0 AS BIGINT) AS unreadable, count(DISTINCT score_id) FILTER (score_id % 4 = 1) AS empty "
          "FROM tok", ("tok",))
def label_counts(spark, d):
    """Every fourth label is empty; counted while the labels are read."""
    path = new_path(spark, "labels")
    LB.write_labels(fx.tokens(spark, d).withColumn("token", F.when(F.col("score_id") % 4 == 1, "<PAD>").otherwise(
        F.col("token"))), path)
    return _metrics(spark, LB.read_labels(spark, path).drop("system_breaks"), LB.counted_labels, "label-counts")


@register("s03_pair_counts", """
SELECT count(*) AS rows, count(*) FILTER (i.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS pair,
  count(*) FILTER (l.doc_id IS NULL) AS image_only, count(*) FILTER (i.doc_id IS NULL) AS label_only
FROM (SELECT doc_id FROM documents WHERE doc_id % 5 <> 1) i FULL JOIN (SELECT doc_id FROM labels) l USING (doc_id)""")
def pair_counts(spark, d):
    return _metrics(spark, LB.pair_manifest(*manifest_files(spark, d)), LB.counted_pairs, "pair-counts")


@register("s02_write_labels", "SELECT score_id, string_agg(token, ' ' ORDER BY pos) AS toks, CASE WHEN "
          "score_id % 2 = 0 THEN '1' END AS breaks FROM tok GROUP BY 1", ("tok",))
def write_labels(spark, d):
    path = new_path(spark, "labels")
    meta = fx.score_meta(spark, d).filter(F.col("score_id") % 2 == 0)
    LB.write_labels(fx.tokens(spark, d), path,
                    meta.select("score_id", F.col("breaks").alias("system_breaks")))
    r = LB.usable_labels(LB.read_labels(spark, path))
    return r.select(F.col("score_id").cast("bigint").alias("score_id"),
                    F.array_join("tokens", " ").alias("toks"),
                    F.array_join("system_breaks", ",").alias("breaks"))


def manifest_files(spark, d):
    """Image and label paths named after documents."""
    docs = fx.table(spark, d, "documents")
    ext = F.when(F.col("doc_id") % 5 == 0, ".JPG").when(F.col("doc_id") % 5 == 1, ".gif").otherwise(".png")
    images = docs.select(F.concat(F.lit("/img/"), "source", F.lit("_"), F.col("doc_id").cast("string"), ext)
                         .alias("path"), F.col("n_chars").alias("length"))
    lab = fx.table(spark, d, "labels").select("doc_id").join(docs.select("doc_id", "source"), "doc_id")
    labels = lab.select(F.concat(F.lit("/lab/"), "source", F.lit("_"), F.col("doc_id").cast("string"),
                                 F.lit(".json")).alias("path"))
    return images, labels


@register("s03_pair_manifest", """
SELECT coalesce(i.stem, l.stem) AS stem, CASE WHEN l.stem IS NULL THEN 'image_only' WHEN i.stem IS NULL
  THEN 'label_only' ELSE 'pair' END AS status
FROM (SELECT source || '_' || doc_id AS stem FROM documents WHERE doc_id % 5 <> 1) i
FULL JOIN (SELECT source || '_' || doc_id AS stem FROM documents JOIN labels USING (doc_id)) l
  ON i.stem = l.stem""")
def pair_manifest(spark, d):
    return LB.pair_manifest(*manifest_files(spark, d)).select("stem", "status")


@register("j01_image_label_orphans", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'image_only' WHEN i.doc_id IS
  NULL THEN 'label_only' ELSE 'pair' END AS status FROM (SELECT doc_id FROM documents
  WHERE doc_id % 5 <> 1) i FULL JOIN (SELECT doc_id FROM labels) l USING (doc_id)) GROUP BY 1""")
def image_label_orphans(spark, d):
    return LB.pair_manifest(*manifest_files(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


@register("s04_load_vocab", "SELECT t.token, v.id, count(*) AS n FROM tok t JOIN vocab v USING (token) "
          "GROUP BY 1, 2", ("tok", "vocab"))
def load_vocabulary(spark, d):
    """The vocabulary file, joined to the tokens it covers."""
    path = new_path(spark, "vocab")
    entry = F.map_from_entries(F.collect_list(F.struct("token", "id")))
    vocab_dim(spark).agg(F.to_json(entry).alias("value")).write.text(path)
    v = load_vocab(spark, path)
    return fx.tokens(spark, d).groupBy("token").agg(F.count("*").alias("n")).join(
        v, "token").select("token", "id", "n")


@register("s05_markov_file", "SELECT interval, round(prob, 6) AS prob, 14 AS max_interval FROM markov",
          ("markov",))
def markov_file(spark, d):
    path = new_path(spark, "markov")
    LB.write_markov(ST.markov_transitions(fx.tokens(spark, d)), path)
    return _round(LB.read_markov(spark, path), "prob")


@register("s06_training_log", """
SELECT epoch, count(*) AS n, round(avg(val_ter), 6) AS ter FROM elog GROUP BY 1""", ("elog",))
def training_log(spark, d):
    """Two appends of the log rows, read back as one log."""
    path = new_path(spark, "log")
    log = epoch_log(spark, d).select(
        "run_id", "epoch", F.lit(1).alias("phase"), (F.col("val_ter") * 2).alias("train_loss"), "val_ter",
        ((1 - F.col("val_ter")) * 100).alias("val_acc"), F.lit(0.001).alias("lr"))
    LB.append_training_log(log.filter("run_id % 2 = 0"), path)
    LB.append_training_log(log.filter("run_id % 2 = 1"), path)
    return LB.read_training_log(spark, path).groupBy("epoch").agg(
        F.count("*").alias("n"), F.round(F.avg("val_ter"), 6).alias("ter"))


@register("s07_append_leaderboard", "SELECT song, count(*) AS n, CAST(max(entry_id) AS BIGINT) AS last_entry "
          "FROM lb GROUP BY 1", ("lb",))
def append_leaderboard(spark, d):
    path = new_path(spark, "board")
    lb = leaderboard(spark, d)
    L.append_leaderboard(lb.filter("score IS NOT NULL"), path)
    L.append_leaderboard(lb.filter("score IS NULL"), path)
    return spark.read.schema(lb.schema).parquet(path).groupBy("song").agg(
        F.count("*").alias("n"), F.max("entry_id").alias("last_entry"))


@register("s13_valid_uploads", "SELECT source || '_' || doc_id AS stem FROM documents WHERE "
          "n_chars * 4096 <= 10485760")
def valid_uploads(spark, d):
    images, _ = manifest_files(spark, d)
    ok = LB.valid_uploads(images.withColumn("length", F.col("length") * 4096))
    return ok.select(LB.file_stem(F.col("path")).alias("stem"))


@register("s14_midi_stream", "SELECT session_id, seq, t_ms, status, d1, d2 FROM midi", ("midi",))
def midi_stream(spark, d):
    return SS.run_available(MD.midi_stream(spark, d), "midi")


def raw_files(spark, d) -> str:
    """The messages as raw bytes in the shared folder; the path."""
    spark.dataSource.register(RawMidi)
    path = new_path(spark, "raw")
    MD.midi_messages(spark, d).select("session_id", "t_ms", "status", "d1", "d2").write.format("raw_midi").mode(
        "append").save(path)
    return path


_RAW = "SELECT session_id, t_ms, status, d1, d2 FROM midi"


@register("s14_raw_bytes", _RAW, ("midi",))
def raw_bytes(spark, d):
    """Written as raw bytes and read back in ranges."""
    return spark.read.format("raw_midi").option("rangeBytes", 1 << 20).load(raw_files(spark, d)).drop("file", "at")


@register("s14_raw_bytes_stream", _RAW, ("midi",))
def raw_bytes_stream(spark, d):
    raw = raw_files(spark, d)
    return SS.run_available(spark.readStream.format("raw_midi").load(raw), "raw").drop("file", "at")


# -- keyed state -------------------------------------------------------------------------------

def presses(spark, d):
    return MD.decode_midi(MD.midi_messages(spark, d))


@register("r01_decode_midi", "SELECT * FROM presses", ("presses",))
def decode_midi(spark, d):
    return presses(spark, d)


_HELD = """
SELECT session_id, pitch, t_ms AS from_ms, next_ms AS to_ms FROM (
  SELECT *, lead(t_ms) OVER (PARTITION BY session_id, pitch ORDER BY seq) AS next_ms FROM (
    SELECT *, lag(kind) OVER (PARTITION BY session_id, pitch ORDER BY seq) AS p FROM presses)
  WHERE coalesce(p, 'off') <> kind) WHERE kind = 'on'"""


@register("r02_held_notes", _HELD, ("presses",))
def held_notes(spark, d):
    return SS.held_notes(presses(spark, d))


@register("r02_held_notes_stream", _HELD + " AND next_ms IS NOT NULL", ("presses",))
def held_notes_stream(spark, d):
    """Holds that have ended; open ones stay in the state."""
    return SS.run_available(SS.held_notes_stream(MD.decode_midi(MD.midi_stream(spark, d))), "held")


def _stored_stream(spark, rows, name):
    """A message table in the shared folder, read back as a file stream."""
    path = new_path(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


add_cte("psteps", """
SELECT score_id AS session_id, staff, measure, row_number() OVER (PARTITION BY score_id, staff, measure ORDER BY
  note_idx) - 1 AS step, beat, string_split(pitches, ',') AS tones FROM steps
WHERE score_id % 4 <> 3 OR staff = 'treble'""", "steps")
add_cte("ptones", """
SELECT *, (measure * 31 + step * 7 + tone * 3 + session_id) % 37 AS code FROM (SELECT session_id, staff, measure,
  step, unnest(tones) AS pitch, unnest(range(len(tones))) AS tone FROM psteps)""", "psteps")
add_cte("pmsg", """
SELECT session_id, 1 + row_number() OVER (PARTITION BY session_id ORDER BY measure, step, phase, staff DESC, tone)
  AS seq, kind, pitch
FROM (SELECT session_id, measure, step, staff, tone, phase, CASE WHEN phase % 2 = 0 THEN 'on' ELSE 'off' END AS
    kind, CASE WHEN phase < 2 THEN 'C1' ELSE pitch END AS pitch
  FROM ptones, (VALUES (0), (1), (2), (3)) AS v(phase)
  WHERE NOT (session_id % 5 = 4 AND code = 3) AND (phase >= 2 OR code = 5))""", "ptones")
add_cte("phands", f"""
SELECT session_id, staff, i, measure, beat, list(DISTINCT p) AS tones, arg_max(p, {midi_sql('p')}) AS high
FROM (SELECT session_id, staff, measure, beat, unnest(tones) AS p, row_number() OVER (PARTITION BY session_id, staff
    ORDER BY measure, step) - 1 AS i FROM psteps) GROUP BY 1, 2, 3, 4, 5""", "psteps")
add_cte("pcount", """
SELECT session_id, count(*) FILTER (staff = 'treble') AS nr, count(*) FILTER (staff = 'bass') AS nl FROM phands
GROUP BY 1""", "phands")
# The rules over rows: one row per message, with what it did.
add_cte("perffold", """
SELECT session_id, CAST(1 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS r, CAST(0 AS BIGINT) AS l, CAST([] AS VARCHAR[])
  AS held, CAST(0 AS BIGINT) AS correct, CAST(0 AS BIGINT) AS wrong, CAST('' AS VARCHAR) AS mark, CAST('' AS VARCHAR)
  AS pitch FROM pcount
UNION ALL
SELECT session_id, seq, r + CASE WHEN hit AND side <> 'l' THEN 1 ELSE 0 END,
  l + CASE WHEN hit AND side IN ('l', 'both') THEN 1 ELSE 0 END, held, correct + CASE WHEN hit THEN len(want) ELSE 0 END,
  wrong + CASE WHEN live AND NOT hit AND NOT has THEN 1 ELSE 0 END,
  CASE WHEN NOT live THEN '' WHEN hit THEN 'hit' WHEN has THEN 'wait' ELSE 'wrong' END, pitch
FROM (SELECT *, list_contains(want, pitch) AS has, live AND list_contains(want, pitch) AND CASE
    WHEN side <> 'both' AND session_id % 4 = 3 AND len(want) > 1 THEN pitch = high
    ELSE list_has_all(held, want) END AS hit
  FROM (SELECT session_id, seq, r, l, correct, wrong, pitch, kind = 'on' AND NOT over_ AS live, high, side,
      CASE WHEN kind = 'off' THEN list_filter(held, lambda h: h <> pitch) WHEN over_ THEN held
        ELSE list_append(list_filter(held, lambda h: h <> pitch), pitch) END AS held,
      CASE side WHEN 'both' THEN list_concat(mine, other) WHEN 'r' THEN mine WHEN 'l' THEN other ELSE [] END AS want
    FROM (SELECT *, CASE WHEN side_ = 'both' THEN 'both' WHEN list_contains(mine, pitch) THEN 'r'
        WHEN list_contains(other, pitch) THEN 'l' ELSE 'none' END AS side,
        CASE WHEN list_contains(mine, pitch) THEN ah ELSE bh END AS high
      FROM (SELECT f.session_id, k.seq, f.r, f.l, f.held, f.correct, f.wrong, k.kind, k.pitch, a.high AS ah,
          b.high AS bh, f.r >= c.nr AND f.l >= c.nl AS over_,
          CASE WHEN a.measure = b.measure AND a.beat = b.beat THEN 'both' ELSE '' END AS side_,
          CASE WHEN a.measure <= coalesce(b.measure, a.measure) THEN a.tones ELSE [] END AS mine,
          CASE WHEN b.measure <= coalesce(a.measure, b.measure) THEN b.tones ELSE [] END AS other
        FROM perffold f JOIN pmsg k ON k.session_id = f.session_id AND k.seq = f.seq + 1
        JOIN pcount c ON c.session_id = f.session_id
        LEFT JOIN phands a ON a.session_id = f.session_id AND a.staff = 'treble' AND a.i = f.r
        LEFT JOIN phands b ON b.session_id = f.session_id AND b.staff = 'bass' AND b.i = f.l))))""",
        "pmsg", "pcount", "phands")
add_cte("pgrades", """
SELECT f.session_id, f.seq AS seen, correct, wrong, r >= nr AND l >= nl AS done FROM perffold f
JOIN pcount c ON c.session_id = f.session_id
JOIN (SELECT session_id, max(seq) AS m FROM pmsg GROUP BY 1) k ON k.session_id = f.session_id AND k.m = f.seq""",
        "perffold", "pcount", "pmsg")


@register("r03_grade_performance", "SELECT * FROM pgrades", ("pgrades",))
def grade_performance(spark, d):
    return FO.grades(PF.performance_messages(spark, d), "performance")


def _graded_stream(spark, messages, mode):
    stream = _stored_stream(spark, messages, "messages")
    return FO.latest_results(SS.run_available(FO.grades(stream, mode), "graded", "update"))


@register("r03_grade_performance_stream", "SELECT * FROM pgrades", ("pgrades",))
def grade_performance_stream(spark, d):
    return _graded_stream(spark, PF.performance_messages(spark, d), "performance")


# Wait mode as a fold over presses.
add_cte("wnotes", """
SELECT score_id AS session_id, row_number() OVER (PARTITION BY score_id ORDER BY note_idx) - 1 AS i, note_idx,
  pitch FROM notes WHERE staff = 'treble' AND NOT is_rest""", "notes")
add_cte("wkeys", """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY note_idx, j) AS seq, p AS pitch FROM (
  SELECT session_id, note_idx, 1 AS j, pitch AS p FROM wnotes UNION ALL
  SELECT session_id, note_idx, 0, 'C1' FROM wnotes WHERE (note_idx * 7 + session_id) % 11 = 4)""", "wnotes")
add_cte("waitfold", """
SELECT session_id, CAST(0 AS BIGINT) AS seq, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS correct,
  CAST(0 AS BIGINT) AS wrong FROM wnotes GROUP BY 1
UNION ALL
SELECT f.session_id, k.seq, f.i + CASE WHEN k.pitch = n.pitch THEN 1 ELSE 0 END,
  f.correct + CASE WHEN k.pitch = n.pitch THEN 1 ELSE 0 END,
  f.wrong + CASE WHEN k.pitch <> n.pitch THEN 1 ELSE 0 END
FROM waitfold f JOIN wkeys k ON k.session_id = f.session_id AND k.seq = f.seq + 1
LEFT JOIN wnotes n ON n.session_id = f.session_id AND n.i = f.i""", "wnotes", "wkeys")


_WAIT = """
SELECT f.session_id, f.seq + 1 AS seen, correct, wrong, i >= n AS done FROM waitfold f
JOIN (SELECT session_id, max(seq) AS m FROM wkeys GROUP BY 1) k ON k.session_id = f.session_id AND k.m = f.seq
JOIN (SELECT session_id, count(*) AS n FROM wnotes GROUP BY 1) c ON c.session_id = f.session_id"""


@register("r04_wait_mode_grade", _WAIT, ("waitfold", "wkeys", "wnotes"))
def wait_mode_grade(spark, d):
    return FO.grades(PF.wait_messages(spark, d), "wait")


@register("r04_wait_mode_grade_stream", _WAIT, ("waitfold", "wkeys", "wnotes"))
def wait_mode_grade_stream(spark, d):
    return _graded_stream(spark, PF.wait_messages(spark, d), "wait")


add_cte("qnotes", "SELECT session_id * 10000 + i // 3 AS session_id, note_idx, pitch FROM wnotes", "wnotes")
add_cte("qplan", """
SELECT session_id, CASE session_id % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'chord' ELSE 'sequence' END AS mode,
  list(pitch ORDER BY note_idx) AS ns FROM qnotes GROUP BY 1""", "qnotes")
add_cte("qkeys", """
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY note_idx, j) AS seq, p AS pitch FROM (
  SELECT session_id, note_idx, 1 AS j, pitch AS p FROM qnotes UNION ALL
  SELECT session_id, note_idx, 0, 'C1' FROM qnotes WHERE (note_idx * 7 + session_id) % 11 = 4)""", "qnotes")
add_cte("quizfold", """
SELECT session_id, CAST(0 AS BIGINT) AS seq, 0 AS i, CAST([] AS VARCHAR[]) AS pressed, 0 AS correct, 0 AS wrong,
  false AS done FROM qplan
UNION ALL
SELECT session_id, seq, i + h, pr, correct + h, wrong + w, done OR (h = 1 AND CASE mode WHEN 'note' THEN true
  WHEN 'chord' THEN list_has_all(pr, ns) ELSE i + h >= len(ns) END)
FROM (SELECT *, CASE WHEN done THEN pressed WHEN h = 1 AND mode = 'chord' THEN list_append(pressed, pitch)
      WHEN h = 1 THEN pressed ELSE [] END AS pr, CASE WHEN done OR h = 1 THEN 0 ELSE 1 END AS w
  FROM (SELECT f.session_id, k.seq, f.i, f.pressed, f.correct, f.wrong, f.done, p.mode, p.ns, k.pitch,
      CASE WHEN NOT f.done AND CASE p.mode WHEN 'note' THEN k.pitch = p.ns[1] WHEN 'chord' THEN
        list_contains(p.ns, k.pitch) ELSE k.pitch = p.ns[f.i + 1] END THEN 1 ELSE 0 END AS h
    FROM quizfold f JOIN qkeys k ON k.session_id = f.session_id AND k.seq = f.seq + 1
    JOIN qplan p ON p.session_id = f.session_id))""", "qplan", "qkeys")


_QUIZ = """
SELECT f.session_id, f.seq + 1 AS seen, CAST(correct AS BIGINT) AS correct, CAST(wrong AS BIGINT) AS wrong, done
FROM quizfold f JOIN (SELECT session_id, max(seq) AS m FROM qkeys GROUP BY 1) k
  ON k.session_id = f.session_id AND k.m = f.seq"""


@register("r05_quiz_grade", _QUIZ, ("quizfold", "qkeys"))
def quiz_grade(spark, d):
    return FO.grades(PF.quiz_messages(spark, d), "quiz")


@register("r05_quiz_grade_stream", _QUIZ, ("quizfold", "qkeys"))
def quiz_grade_stream(spark, d):
    return _graded_stream(spark, PF.quiz_messages(spark, d), "quiz")


@register("p05_performance_scores", """
SELECT session_id, correct, wrong, CASE WHEN session_id % 7 <> 0 THEN CASE WHEN session_id % 5 = 0 THEN
  greatest(0.0, floor((base - 10) * 10 + 0.5) / 10.0) ELSE base END END AS score
FROM (SELECT *, CASE WHEN correct + wrong > 0 THEN floor(correct / (correct + wrong) * CASE WHEN session_id % 3 = 0
  THEN 100 ELSE 150 END * 10 + 0.5) / 10.0 ELSE 0.0 END AS base FROM pgrades)""", ("pgrades",))
def performance_scores(spark, d):
    """Grades, final scores (P5) and the song they rank under."""
    g = FO.grades(PF.performance_messages(spark, d), "performance")
    score = PR.final_score(F.col("correct"), F.col("wrong"),
                           F.when(F.col("session_id") % 3 == 0, 100).otherwise(150),
                           F.col("session_id") % 5 == 0, F.col("session_id") % 7 != 0)
    return g.select("session_id", "correct", "wrong", score.alias("score"))


# -- checks, jobs, boards, windows -------------------------------------------------------------

def checks(rows):
    """One connection check per session, a little after its first message."""
    return rows.filter(F.col("seq") % 128 == 0).select(
        "session_id", (F.col("t_ms") + 1000).alias("check_ms"),
        F.when(F.col("session_id") % 2 == 0, "C3").otherwise("G3").alias("target"))


add_cte("checks", "SELECT session_id, t_ms + 1000 AS check_ms, CASE WHEN session_id % 2 = 0 THEN 'C3' ELSE "
        "'G3' END AS target FROM midi WHERE seq % 128 = 0", "midi")


_CHECKED = """
SELECT c.session_id, check_ms, target, coalesce(bool_or(pitch = target), false) AS ok,
  count(pitch) AS n_heard
FROM checks c LEFT JOIN presses p ON p.session_id = c.session_id AND kind = 'on' AND t_ms BETWEEN check_ms
  AND check_ms + 6000 GROUP BY 1, 2, 3"""


@register("r06_connection_check", _CHECKED, ("checks", "presses"))
def connection_check(spark, d):
    return SS.connection_check(checks(MD.midi_messages(spark, d)), presses(spark, d))


#: Far beyond any event time here.
END_MS = 4_102_444_800_000
END = {"session_id": -1, "seq": 0, "t_ms": END_MS, "status": 0x90, "d1": 0, "d2": 1}


def closed_midi(spark, d, closing):
    """The keyboard stream, and the row that closes it."""
    raw = MD.midi_stream(spark, d)
    return raw.unionByName(closing.select(*raw.columns))


@register("r06_connection_check_stream", _CHECKED, ("checks", "presses"))
def connection_check_stream(spark, d):
    def make(closing):
        c = checks(closed_midi(spark, d, closing)).withColumn("ts", F.timestamp_millis("check_ms"))
        return SS.connection_check_stream(c, SS.with_ts(MD.decode_midi(closed_midi(spark, d, closing))))
    heard = SS.run_to_end(make, spark, MD.MIDI_SCHEMA, END, "checks")
    return SS.check_results(heard.filter("session_id >= 0"))


def job_rows(rows):
    """Normalised status with a clock of 100 s per event."""
    return rows.select("job_id", "event_id", (F.col("event_id") * 100000).alias("t_ms"),
                       normalize_job_status("status", "output").alias("status"))


_JOBS = """
SELECT job_id, coalesce(e, 'FAILED') AS status, e IS NULL AS timed_out FROM (
  SELECT job_id, arg_min(status, (t_ms, event_id)) FILTER (status IN ('COMPLETED', 'FAILED') AND
    t_ms <= s + 300000) AS e
  FROM (SELECT *, min(t_ms) OVER (PARTITION BY job_id) AS s FROM jobst) GROUP BY 1)"""


@register("r07_job_tracker", _JOBS, ("jobst",))
def job_tracker(spark, d):
    return SS.job_tracker(job_rows(job_events(spark, d)))


@register("r07_job_tracker_stream", _JOBS, ("jobst",))
def job_tracker_stream(spark, d):
    def make(closing):
        ev = spark.sql(JOBS_SQL, events=MD.file_stream(spark, d, "events", MD.EVENT_SCHEMA))
        rows = SS.with_ts(job_rows(ev))
        return SS.job_tracker_stream(rows.unionByName(SS.with_ts(closing.select(
            *[c for c in rows.columns if c != "ts"]))))
    out = SS.run_to_end(make, spark, "job_id bigint, event_id bigint, t_ms bigint, status string",
                        {"job_id": -1, "event_id": -1, "t_ms": END_MS, "status": "UNKNOWN"}, "jobs")
    return out.filter("job_id >= 0")


ORDER_SCHEMA = ("o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
                "o_orderdate timestamp_ntz, o_orderpriority string")


@register("r08_live_leaderboard", """
WITH e AS (SELECT o_orderpriority AS song, CASE WHEN o_custkey % 11 = 0 THEN '익명' ELSE 'p' || o_custkey END AS
    nickname, floor(o_totalprice)::BIGINT % 1500 / 10.0::DOUBLE AS score, o_orderkey AS entry_id, o_orderdate
  FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY song, nickname ORDER BY o_orderdate, entry_id) AS nth FROM e)
SELECT song, nickname, score, entry_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (
    PARTITION BY song ORDER BY score DESC, o_orderdate, entry_id) AS rank FROM f WHERE nth = 1 OR nickname = '익명')
WHERE rank <= 3""")
def live_leaderboard(spark, d):
    o = MD.file_stream(spark, d, "orders", ORDER_SCHEMA)
    entries = o.select(
        F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("song"),
        F.when(F.col("o_custkey") % 11 == 0, L.ANONYMOUS).otherwise(
            F.concat(F.lit("p"), F.col("o_custkey").cast("string"))).alias("nickname"),
        (F.floor("o_totalprice") % 1500 / 10.0).alias("score"), F.col("o_orderdate").alias("created_at"))
    return SS.live_leaderboard(entries).select("song", "nickname", "score", "entry_id", "rank")


@register("r09_press_windows", """
SELECT t_ms - t_ms % 60000 AS from_ms, t_ms - t_ms % 60000 + 60000 AS to_ms, count(*) AS n
FROM presses WHERE kind = 'on' GROUP BY 1, 2""", ("presses",))
def press_windows(spark, d):
    return SS.press_windows(SS.with_ts(presses(spark, d)))


@register("r09_press_windows_stream", """
SELECT t_ms - t_ms % 60000 AS from_ms, t_ms - t_ms % 60000 + 60000 AS to_ms, count(*) AS n
FROM presses WHERE kind = 'on' GROUP BY 1, 2""", ("presses",))
def press_windows_stream(spark, d):
    w = SS.press_windows(SS.with_ts(MD.decode_midi(MD.midi_stream(spark, d))))
    updates = SS.run_available(w, "windows", "update")
    return updates.groupBy("from_ms", "to_ms").agg(F.max("n").alias("n"))


_BURSTS = """
SELECT session_id, min(t_ms) AS from_ms, max(t_ms) + 5000 AS to_ms, count(*) AS n
FROM (SELECT *, sum(CASE WHEN t_ms - p < 5000 THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY t_ms)
    AS burst
  FROM (SELECT *, lag(t_ms) OVER (PARTITION BY session_id ORDER BY t_ms) AS p FROM presses
        WHERE kind = 'on')) GROUP BY session_id, burst"""


@register("r09_press_sessions", _BURSTS, ("presses",))
def press_sessions(spark, d):
    return SS.press_sessions(SS.with_ts(presses(spark, d)))


@register("r09_press_sessions_stream", _BURSTS, ("presses",))
def press_sessions_stream(spark, d):
    def make(closing):
        return SS.press_sessions(SS.with_ts(MD.decode_midi(closed_midi(spark, d, closing))))
    return SS.run_to_end(make, spark, MD.MIDI_SCHEMA, END, "bursts").filter("session_id >= 0")


@register("j08_expected_step_presses", "SELECT session_id, seq, pitch, mark FROM perffold WHERE mark <> ''",
          ("perffold",))
def expected_step_presses(spark, d):
    """Every press against the step expected at that moment."""
    return FO.press_marks(PF.performance_messages(spark, d))


@register("j09_target_heard", """
SELECT c.session_id, min(t_ms) - check_ms AS after_ms FROM checks c JOIN presses p ON
  p.session_id = c.session_id AND p.pitch = c.target AND kind = 'on' AND t_ms BETWEEN check_ms AND
  check_ms + 6000 GROUP BY c.session_id, check_ms""", ("checks", "presses"))
def target_heard(spark, d):
    return SS.target_heard(checks(MD.midi_messages(spark, d)), presses(spark, d)).select("session_id", "after_ms")
