"""Queries over note-to-token conversion and the library."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode as E
from ..operators import library as L
from ..sources import elements as el
from ..sources import fixtures as fx
from ..sources.storage import new_path
from ..sources.versioned import VersionedTable, merge_stream
from .base import add_cte, register
from .note_queries import leaderboard, notes_of

add_cte("el", el.ELEMENTS_SQL.format(events="events"))
add_cte("elg", """
SELECT *, triplet AND rn < len - len % 3 AS whole,
  CASE WHEN triplet AND rn < len - len % 3 THEN rn % 3 END AS group_pos
FROM (SELECT *, row_number() OVER (PARTITION BY score_id, part, measure_idx, triplet, island
      ORDER BY offset_q, el_idx) - 1 AS rn,
    count(*) OVER (PARTITION BY score_id, part, measure_idx, triplet, island) AS len
  FROM (SELECT *, row_number() OVER (PARTITION BY score_id, part, measure_idx
        ORDER BY offset_q, el_idx) - row_number() OVER (PARTITION BY score_id, part, measure_idx,
        triplet ORDER BY offset_q, el_idx) AS island FROM el))""", "el")
add_cte("elp", """
SELECT el_idx, m, i, CASE WHEN nm IN (sh, fl) THEN nm WHEN a = '#' THEN sh ELSE fl END ||
  CAST(m // 12 - 1 AS VARCHAR) AS p, row_number() OVER (PARTITION BY el_idx ORDER BY m, i) AS r
FROM (SELECT *, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][m % 12 + 1] AS sh,
    ['C','Db','D','Eb','E','F','Gb','G','Ab','A','Bb','B'][m % 12 + 1] AS fl FROM (
  SELECT el_idx, midi AS m, name AS nm, acc AS a, 0 AS i FROM el
  UNION ALL SELECT el_idx, midi + 4, 'X', NULL, 1 FROM el WHERE n_extra = 2
  UNION ALL SELECT el_idx, midi - 3, 'X', '#', 2 FROM el WHERE n_extra >= 1))""", "el")
add_cte("elsuf", """
SELECT el_idx, concat_ws(' ', CASE artic WHEN 'Staccato' THEN 'artic-staccato' WHEN 'StrongAccent'
    THEN 'artic-marcato' END, CASE expr WHEN 'Fermata' THEN 'fermata' WHEN 'InvertedMordent' THEN
    'ornament-mordent' END, CASE WHEN tie IN ('start', 'continue') THEN 'tie' END) AS suf FROM el""",
        "el")
add_cte("eltok", """
SELECT score_id, part, measure_idx, offset_q, g.el_idx, concat_ws(' ',
  CASE WHEN group_pos = 0 THEN 'tuplet-3-start' END,
  CASE WHEN is_rest THEN 'rest-' || d ELSE concat_ws(' ', 'note-' || c.low, 'dur-' || d, c.upper,
    nullif(s.suf, '')) END, CASE WHEN group_pos = 2 THEN 'tuplet-3-end' END) AS t
FROM (SELECT *, CASE WHEN whole THEN '1/8' WHEN quarters = 0.4 THEN '3/32' WHEN quarters = 0.5 THEN
    '1/8' WHEN quarters = 1.0 THEN '1/4' ELSE '3/8' END AS d FROM elg) g
JOIN (SELECT el_idx, max(p) FILTER (r = 1) AS low, string_agg('chord-' || p, ' ' ORDER BY r)
    FILTER (r > 1) AS upper FROM elp GROUP BY 1) c USING (el_idx) JOIN elsuf s USING (el_idx)""",
        "elg", "elp", "elsuf")
add_cte("eldyn", """
SELECT score_id, part, measure_idx, string_agg('dynamic-' || CASE dyn WHEN 'fz' THEN 'f' ELSE dyn END,
  ' ' ORDER BY o DESC, el_idx DESC) AS dyn
FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 0.0 ELSE offset_q END AS o FROM el
      WHERE dyn IS NOT NULL AND offset_q < 2) WHERE o <= 1e-6 GROUP BY 1, 2, 3""", "el")
add_cte("elm", """
SELECT score_id, part, measure_idx, arg_max(coalesce(right_bar, '-'), el_idx) AS rb,
  arg_min(starts_repeat, el_idx) AS sr FROM el GROUP BY 1, 2, 3
HAVING NOT (part = 'bass' AND score_id % 4 = 1 AND measure_idx >= 7)""", "el")
add_cte("elmt", """
SELECT score_id, part, measure_idx, concat_ws(' ', dyn, body) AS t
FROM (SELECT score_id, part, measure_idx, string_agg(t, ' ' ORDER BY offset_q, el_idx) AS body
      FROM eltok GROUP BY 1, 2, 3) LEFT JOIN eldyn USING (score_id, part, measure_idx)""",
        "eltok", "eldyn")
_BAR = """CASE WHEN {last} THEN 'barline-final' WHEN rb = 'repeat' THEN 'barline-end-repeat'
  WHEN rb = 'light-light' THEN 'barline-double' WHEN rb = 'light-heavy' THEN 'barline-final'
  ELSE 'barline' END"""
_HEAD = """'<SOS> clef-G key-' || ['Gb','Db','Ab','Eb','Bb','F','C','G','D','A','E','B','F#','C','C']
  [CASE WHEN score_id % 15 - 7 BETWEEN -6 AND 6 THEN score_id % 15 ELSE 14 END] || ' time-' ||
  CASE score_id % 4 WHEN 0 THEN '3/4' WHEN 1 THEN '7/8' ELSE '4/4' END"""
add_cte("eltwo", f"""
SELECT score_id, {_HEAD} || ' ' || string_agg(t, ' ' ORDER BY measure_idx) || ' <EOS>' AS toks,
  score_id % 4 = 1 AS odd_time, bool_or(n1 <> n2) AS unequal_parts
FROM (SELECT u.score_id, u.measure_idx, n1, n2, concat_ws(' ',
    CASE WHEN u.sr THEN 'barline-start-repeat' END, a.t, 'staff-bass',
    CASE WHEN u.measure_idx = 0 THEN CASE WHEN u.score_id % 5 <> 4 THEN 'clef-F' ELSE 'clef-G' END END,
    b.t, {_BAR.format(last="u.measure_idx = least(n1, n2) - 1").replace("rb", "u.rb")}) AS t
  FROM elm u JOIN elm l ON l.score_id = u.score_id AND l.measure_idx = u.measure_idx
    AND l.part = 'bass'
  JOIN (SELECT score_id, count(*) FILTER (part = 'treble') AS n1, count(*) FILTER (part = 'bass')
    AS n2 FROM elm GROUP BY 1) n ON n.score_id = u.score_id
  LEFT JOIN elmt a ON a.score_id = u.score_id AND a.measure_idx = u.measure_idx AND a.part = 'treble'
  LEFT JOIN elmt b ON b.score_id = u.score_id AND b.measure_idx = u.measure_idx AND b.part = 'bass'
  WHERE u.part = 'treble') GROUP BY score_id""", "elm", "elmt")
add_cte("elone", f"""
SELECT score_id, {_HEAD} || ' ' || string_agg(t, ' ' ORDER BY measure_idx) || ' <EOS>' AS toks
FROM (SELECT u.score_id, u.measure_idx, concat_ws(' ', CASE WHEN u.sr THEN 'barline-start-repeat' END,
    a.t, {_BAR.format(last="u.measure_idx = mx")}) AS t
  FROM elm u JOIN (SELECT score_id, max(measure_idx) AS mx FROM elm WHERE part = 'treble' GROUP BY 1)
    USING (score_id) LEFT JOIN elmt a ON a.score_id = u.score_id AND a.measure_idx = u.measure_idx
    AND a.part = 'treble' WHERE u.part = 'treble') GROUP BY score_id""", "elm", "elmt")
_NO_LOWER = "score_id NOT IN (SELECT score_id FROM elm WHERE part = 'bass')"


def _inputs(spark, d):
    return (el.elements(spark, d), el.dynamics(spark, d), el.measures(spark, d),
            el.headers(spark, d))


@register("n11_notes_to_tokens", f"""
SELECT score_id, CAST(unnest(range(len(l))) AS INT) AS pos, unnest(l) AS token
FROM (SELECT score_id, string_split(toks, ' ') AS l FROM (SELECT score_id, toks FROM eltwo UNION ALL
  SELECT score_id, toks FROM elone WHERE {_NO_LOWER}))""", ("eltwo", "elone", "elm"))
def notes_to_tokens(spark, d):
    return E.notes_to_tokens(*_inputs(spark, d)).select(
        "score_id", F.posexplode("tokens").alias("pos", "token"))


@register("n12_chord_order", "SELECT el_idx, string_agg(m, ',' ORDER BY r) AS midis FROM elp GROUP BY 1",
          ("elp",))
def chord_order(spark, d):
    c = F.transform(E.sorted_chord(F.col("pitches")), lambda p: p["midi"])
    return el.elements(spark, d).select("el_idx", F.array_join(c, ",").alias("midis"))


@register("n13_triplet_groups", "SELECT score_id, el_idx, CAST(group_pos AS INT) AS group_pos, "
          "triplet AND NOT whole AS broken FROM elg", ("elg",))
def triplet_groups(spark, d):
    return E.triplet_groups(el.elements(spark, d)).select("score_id", "el_idx", "group_pos",
                                                          "broken")


@register("n14_suffix_tokens", "SELECT el_idx, suf AS suffixes FROM elsuf", ("elsuf",))
def suffix_tokens(spark, d):
    s = E.suffix_tokens(F.col("artics"), F.col("exprs"), F.col("tie"))
    return el.elements(spark, d).select("el_idx", F.array_join(s, " ").alias("suffixes"))


@register("n15_measure_dynamics", "SELECT * FROM eldyn", ("eldyn",))
def measure_dynamics(spark, d):
    return (E.measure_dynamics(el.dynamics(spark, d))
            .withColumn("dyn", F.array_join("dyn", " ")))


@register("n16_barline_tokens", f"""
SELECT score_id, part, measure_idx, {_BAR.format(last="measure_idx = mx")} AS bar
FROM elm JOIN (SELECT score_id, part, max(measure_idx) AS mx FROM elm GROUP BY 1, 2)
  USING (score_id, part)""", ("elm",))
def barline_tokens(spark, d):
    from pyspark.sql import Window
    last = F.max("measure_idx").over(Window.partitionBy("score_id", "part"))
    m = el.measures(spark, d).withColumn("_l", F.col("measure_idx") == last)
    return m.select("score_id", "part", "measure_idx",
                    E.barline_token(F.col("right_bar"), F.col("_l")).alias("bar"))


@register("n17_interleave_parts", "SELECT * FROM eltwo", ("eltwo",))
def interleave_parts(spark, d):
    e, dyn, m, h = _inputs(spark, d)
    return E.interleave_parts(m, E.measure_tokens(e, dyn), h).select(
        "score_id", F.array_join("tokens", " ").alias("toks"), "odd_time", "unequal_parts")


@register("n18_single_part", "SELECT * FROM elone", ("elone",))
def single_part(spark, d):
    e, dyn, m, h = _inputs(spark, d)
    return E.single_part(m, E.measure_tokens(e, dyn), h).select(
        "score_id", F.array_join("tokens", " ").alias("toks"))


# -- note-level library ------------------------------------------------------------------------

@register("n19_append_scores", """
SELECT score_id, staff, note_idx, pitch, ticks FROM notes WHERE score_id % 2 = 0
UNION ALL
SELECT x.score_id - 1, x.staff, CAST(x.note_idx + coalesce(n, 0) AS INT), x.pitch, x.ticks
FROM notes x LEFT JOIN (SELECT score_id, staff, count(*) AS n FROM notes GROUP BY 1, 2) t
  ON t.score_id = x.score_id - 1 AND t.staff = x.staff
WHERE x.score_id % 2 = 1 AND (x.staff = 'treble' OR n IS NOT NULL)""", ("notes",))
def append_scores(spark, d):
    n = notes_of(spark, d)
    ids = fx.labels(spark, d).select("score_id")
    pairs = ids.filter(F.col("score_id") % 2 == 1).select(
        (F.col("score_id") - 1).alias("target_id"), F.col("score_id").alias("extra_id"))
    # Even scores without a successor stay as they are.
    alone = n.filter(F.col("score_id") % 2 == 0).join(
        pairs.select(F.col("target_id").alias("score_id")), "score_id", "left_anti")
    cols = ["score_id", "staff", "note_idx", "pitch", "ticks"]
    return L.append_scores(n, pairs).select(*cols).unionByName(alone.select(*cols))


@register("n20_score_summary", "SELECT score_id, count(*) AS n_notes, CAST(count(DISTINCT CASE WHEN "
          "staff = 'bass' THEN 2 ELSE 1 END) AS INT) AS n_staves, 100 AS tempo FROM notes GROUP BY 1",
          ("notes",))
def score_summary(spark, d):
    return L.score_summary(notes_of(spark, d))


@register("n21_library_preview", "SELECT score_id, note_idx, beat, ticks * 10 / 24.0::DOUBLE AS width "
          "FROM notes WHERE staff = 'treble' AND note_idx < 14", ("notes",))
def library_preview(spark, d):
    return L.library_preview(notes_of(spark, d))


# -- score library -----------------------------------------------------------------------------

def library(spark, d):
    """Local scores: one per document, in document order."""
    return fx.table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"),
        (F.col("doc_id") % 3).alias("user_id"),
        F.when(F.col("doc_id") % 10 != 0, F.col("n_chars") * 1000 + F.col("doc_id"))
        .alias("created_at"), F.lit(0).cast("bigint").alias("updated_at"),
        F.col("doc_id").alias("list_pos"))


def cloud(spark, d):
    """Cloud copies of every third score under a new title, and scores the device lacks."""
    c = fx.table(spark, d, "documents").filter(F.col("doc_id") % 3 == 0)
    return c.select(
        F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(F.col("doc_id") + 10_000_000)
        .alias("id"), F.concat("source", F.lit("-cloud")).alias("title"),
        (F.col("doc_id") % 3).alias("user_id"), F.lit(1).cast("bigint").alias("created_at"),
        (F.col("doc_id") + 1).alias("updated_at"))


add_cte("lib", "SELECT doc_id AS id, source AS title, doc_id % 3 AS user_id, CASE WHEN doc_id % 10 <> 0 "
        "THEN n_chars * 1000 + doc_id END AS created_at, doc_id AS list_pos FROM documents")
add_cte("cld", "SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 10000000 END AS id, "
        "source || '-cloud' AS title, doc_id + 1 AS updated_at FROM documents WHERE doc_id % 3 = 0")
_SYNC = """SELECT coalesce(l.id, c.id) AS id, coalesce(c.title, l.title) AS title,
  coalesce(l.list_pos, -c.updated_at) AS list_pos FROM lib l FULL JOIN {new} c ON l.id = c.id"""


@register("s08_upsert_scores", _SYNC.format(new="""(SELECT id, arg_max(title, updated_at) AS title,
  max(updated_at) AS updated_at FROM (SELECT * FROM cld UNION ALL SELECT id, 'second', updated_at + 5
  FROM cld WHERE id % 5 = 0) GROUP BY 1)"""), ("lib", "cld"))
def upsert_scores(spark, d):
    c = cloud(spark, d)
    again = c.filter(F.col("id") % 5 == 0).withColumn("title", F.lit("second")).withColumn(
        "updated_at", F.col("updated_at") + 5)
    return L.upsert_scores(library(spark, d), c.unionByName(again)).select("id", "title", "list_pos")


def saves(spark, d, name: str):
    """Saves as a stream of several micro-batches: new titles, then a second save of some."""
    c = cloud(spark, d)
    again = c.filter(F.col("id") % 5 == 0).withColumn("title", F.lit("second")).withColumn(
        "updated_at", F.col("updated_at") + 5)
    path = new_path(spark, name)
    for rows in (c.filter("id % 4 < 2"), c.filter("id % 4 >= 2"), again):
        rows.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(path)


def saved_library(spark, d, name: str, stream) -> VersionedTable:
    lib = library(spark, d)
    table = VersionedTable(spark, new_path(spark, name), lib.schema, ["id"]).create(lib)
    merge_stream(stream, table, new_path(spark, name + "-cp"), L.merge_saves)
    return table


@register("s08_upsert_stream", """
SELECT coalesce(l.id, c.id) AS id, coalesce(c.title, l.title) AS title, coalesce(l.list_pos, -c.first_at) AS list_pos
FROM lib l FULL JOIN (SELECT id, arg_max(title, updated_at) AS title, min(updated_at) AS first_at FROM (
    SELECT * FROM cld UNION ALL SELECT id, 'second', updated_at + 5 FROM cld WHERE id % 5 = 0) GROUP BY 1) c
  ON l.id = c.id""", ("lib", "cld"))
def upsert_stream(spark, d):
    """Saves merged batch by batch into a table that others read meanwhile."""
    return saved_library(spark, d, "library", saves(spark, d, "saves")).read().select("id", "title", "list_pos")


@register("s09_delete_score", "SELECT id, title FROM lib WHERE id NOT IN (SELECT id FROM cld)",
          ("lib", "cld"))
def delete_score(spark, d):
    return L.delete_score(library(spark, d), cloud(spark, d)).select("id", "title")


@register("s10_list_scores", "SELECT id, title, created_at FROM lib WHERE user_id = 1 "
          "ORDER BY coalesce(created_at, 0) DESC, id", ("lib",))
def list_scores(spark, d):
    return L.list_scores(library(spark, d), 1).select("id", "title", "created_at")


@register("s11_sync_library", _SYNC.format(new="cld"), ("lib", "cld"))
def sync_library(spark, d):
    return L.sync_library(library(spark, d), cloud(spark, d)).select("id", "title", "list_pos")


@register("s11_sync_stream", _SYNC.format(new="cld"), ("lib", "cld"))
def sync_stream(spark, d):
    """The cloud's scores arrive as a stream; the cloud wins by id."""
    path = new_path(spark, "cloud")
    rows = cloud(spark, d)
    rows.write.parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    return saved_library(spark, d, "synced", stream).read().select("id", "title", "list_pos")


@register("j07_nickname_taken", """
SELECT o_orderkey AS request_id, r.song, r.nickname, r.nickname <> '익명' AND EXISTS (SELECT 1 FROM lb l
  WHERE l.song = r.song AND l.nickname = r.nickname) AS taken
FROM (SELECT o_orderkey, o_orderpriority AS song, CASE WHEN o_custkey % 4 = 0 THEN '익명' ELSE 'p' ||
  (o_custkey + 1) END AS nickname FROM orders) r""", ("lb",))
def nickname_taken(spark, d):
    requests = fx.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("request_id"), F.col("o_orderpriority").alias("song"),
        F.when(F.col("o_custkey") % 4 == 0, L.ANONYMOUS).otherwise(
            F.concat(F.lit("p"), (F.col("o_custkey") + 1).cast("string"))).alias("nickname"))
    return L.nickname_taken(requests, leaderboard(spark, d)).select("request_id", "song",
                                                                    "nickname", "taken")
