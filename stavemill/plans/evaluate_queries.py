"""Queries over evaluation (E1-E9, J4, J5). The check SQL codes tokens per score in ASCII."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate as EV
from ..sources import fixtures as fx
from ..sources import labels as LB
from ..sources.storage import new_path
from .base import add_cte, register, sql_list
from .sequence_queries import _orphan_sql, _span_sql
from ..functions.tokens import BARLINE_SETS

EVAL = sql_list(BARLINE_SETS["eval"])
add_cte("sides", """
SELECT score_id, pos, token, 'g' AS side FROM tok WHERE score_id IN (SELECT score_id FROM pred)
UNION ALL SELECT score_id, pos, token, 'p' FROM pred""", "tok", "pred")


def coded_sql(src: str, unk: bool) -> str:
    tok = ("CASE WHEN token IN (SELECT token FROM vocab) THEN token ELSE '<UNK>' END"
           if unk else "token")
    return (f"SELECT *, chr(CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY t2) AS INT)) AS sym "
            f"FROM (SELECT *, {tok} AS t2 FROM {src})")


def measured_sql(src: str, keys: str = "") -> str:
    return (f"SELECT *, CAST(coalesce(sum(CASE WHEN token IN ({EVAL}) THEN 1 ELSE 0 END) OVER "
            f"(PARTITION BY score_id, side{keys} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
            f"PRECEDING), 0) AS INT) AS measure_idx FROM {src}")


def dist_sql(src: str, keys: str) -> str:
    return f"""
SELECT {keys}, levenshtein(p, g) AS dist, length(g) AS gt_len, length(p) AS pred_len
FROM (SELECT {keys}, coalesce(string_agg(sym, '' ORDER BY pos) FILTER (side = 'p'), '') AS p,
    coalesce(string_agg(sym, '' ORDER BY pos) FILTER (side = 'g'), '') AS g FROM {src} GROUP BY ALL)"""


RATE = ("CASE WHEN gt_len = 0 THEN CASE WHEN pred_len = 0 THEN 0.0 ELSE 1.0 END "
        "ELSE dist / gt_len::DOUBLE END")


def note_err_sql(src: str, keys: str) -> str:
    """Scores without note tokens on either side get 0."""
    return f"""
SELECT {keys}, {RATE} AS note_err FROM ({dist_sql(f'''(SELECT * REPLACE (CASE WHEN
  regexp_matches(token, '^(note|chord|rest|dur)-') THEN sym ELSE '' END AS sym) FROM {src})''', keys)})"""


def first_sql(src: str, keys: str) -> str:
    on = " AND ".join(f"g.{k} = p.{k}" for k in keys.split(", "))
    sel = ", ".join(f"coalesce(g.{k}, p.{k}) AS {k}" for k in keys.split(", "))
    return f"""
SELECT {keys}, CAST(pos AS INT) AS error_pos, gt_token, pred_token FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS r FROM (
    SELECT {sel}, coalesce(g.pos, p.pos) AS pos, coalesce(g.token, '<없음>') AS gt_token,
      coalesce(p.token, '<누락>') AS pred_token
    FROM (SELECT * FROM {src} WHERE side = 'g') g FULL JOIN (SELECT * FROM {src} WHERE side = 'p') p
      ON {on} AND g.pos = p.pos WHERE g.token IS DISTINCT FROM p.token)) WHERE r = 1"""


def recall_sql(src: str) -> str:
    return f"""
SELECT score_id, CASE WHEN regexp_matches(token, '^(note|chord|rest|dur)-') THEN 'note/rest'
    WHEN token IN ({EVAL}) THEN 'barline' WHEN token = 'staff-bass' THEN 'staff-bass'
    WHEN regexp_matches(token, '^(clef|key|time)-') THEN 'header'
    WHEN regexp_matches(token, '^(dynamic|hairpin)-') THEN 'dynamic'
    WHEN regexp_matches(token, '^(artic-|ornament-|fermata$)') THEN 'artic'
    WHEN regexp_matches(token, 'slur|tuplet|ottava') THEN 'span' ELSE 'other' END AS category,
  CAST(sum(least(g, p)) AS BIGINT) AS matched, CAST(sum(g) AS BIGINT) AS total
FROM (SELECT score_id, token, count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p
      FROM {src} GROUP BY 1, 2) WHERE g > 0 GROUP BY 1, 2"""


add_cte("codes", coded_sql("sides", True), "sides", "vocab")
add_cte("mdist", dist_sql(f"({measured_sql('codes')})", "score_id, measure_idx"), "codes")
add_cte("mter", f"""
SELECT *, {RATE} AS ter FROM (SELECT score_id, CAST(sum(dist) AS BIGINT) AS dist,
  CAST(sum(gt_len) AS BIGINT) AS gt_len, CAST(sum(pred_len) AS BIGINT) AS pred_len FROM mdist
  GROUP BY 1)""", "mdist")
add_cte("rawcodes", coded_sql("sides", False), "sides")
add_cte("noteerr", note_err_sql("rawcodes", "score_id"), "rawcodes")
add_cte("firsterr", first_sql("sides", "score_id"), "sides")
add_cte("recall", recall_sql("sides"), "sides")
add_cte("vsides", f"""
SELECT score_id, side, voice, token, row_number() OVER (PARTITION BY score_id, side, voice ORDER BY pos)
  - 1 AS pos
FROM (SELECT *, CASE WHEN max(CASE WHEN token = 'staff-bass' THEN 1 ELSE 0 END) OVER (PARTITION BY
    score_id, side, measure_idx ORDER BY pos) = 1 THEN 'bass' ELSE 'treble' END AS voice
  FROM ({measured_sql('sides')}))
WHERE token <> 'staff-bass' AND score_id IN (SELECT score_id FROM tok WHERE token = 'staff-bass')""",
        "sides", "tok")
add_cte("vraw", coded_sql("vsides", False), "vsides")
add_cte("verr", note_err_sql("vraw", "score_id, voice"), "vraw")
add_cte("vfirst", first_sql("vsides", "score_id, voice"), "vsides")
add_cte("vcodes", coded_sql("(SELECT * FROM vsides WHERE voice = 'bass')", True), "vsides", "vocab")
add_cte("bter", f"""
SELECT score_id, {RATE} AS bass_ter FROM (SELECT score_id, sum(dist) AS dist, sum(gt_len) AS gt_len,
  sum(pred_len) AS pred_len FROM ({dist_sql(f"({measured_sql('vcodes')})", "score_id, measure_idx")})
  GROUP BY 1)""", "vcodes")
add_cte("analysis", """
SELECT m.score_id, m.gt_len, m.pred_len, m.ter AS overall_ter, is_grand, note_err, error_pos,
  gt_token, pred_token, t.note_err_t AS treble_note_err, b.note_err_b AS bass_note_err, bass_ter,
  ft.error_pos_t AS treble_first, fb.error_pos_b AS bass_first, treble_gt_token, treble_pred_token,
  bass_gt_token, bass_pred_token
FROM mter m JOIN grand USING (score_id) JOIN noteerr USING (score_id)
LEFT JOIN firsterr USING (score_id)
LEFT JOIN (SELECT score_id, note_err AS note_err_t FROM verr WHERE voice = 'treble') t USING (score_id)
LEFT JOIN (SELECT score_id, note_err AS note_err_b FROM verr WHERE voice = 'bass') b USING (score_id)
LEFT JOIN bter USING (score_id)
LEFT JOIN (SELECT score_id, error_pos AS error_pos_t, gt_token AS treble_gt_token, pred_token AS
    treble_pred_token FROM vfirst WHERE voice = 'treble') ft
  USING (score_id)
LEFT JOIN (SELECT score_id, error_pos AS error_pos_b, gt_token AS bass_gt_token, pred_token AS
    bass_pred_token FROM vfirst WHERE voice = 'bass') fb
  USING (score_id)""", "mter", "grand", "noteerr", "firsterr", "verr", "vfirst", "bter")


def sides(spark, d):
    return EV.stack(fx.predictions(spark, d), fx.tokens(spark, d))


def _round(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.round(c, 6))
    return df


add_cte("wdist", dist_sql("codes", "score_id"), "codes")


@register("e01_levenshtein", "SELECT score_id, CAST(dist AS INT) AS dist, CAST(gt_len AS INT) AS gt_len, "
          "CAST(pred_len AS INT) AS pred_len FROM wdist", ("wdist",))
def levenshtein(spark, d):
    return EV.token_distance(fx.predictions(spark, d), fx.tokens(spark, d)).drop("ter")


@register("e02_token_error_rate", f"SELECT score_id, round({RATE}, 6) AS ter FROM wdist", ("wdist",))
def token_error_rate(spark, d):
    df = EV.token_distance(fx.predictions(spark, d), fx.tokens(spark, d))
    return _round(df.select("score_id", "ter"), "ter")


@register("e03_measure_ter", "SELECT score_id, dist, gt_len, pred_len, round(ter, 6) AS ter FROM mter",
          ("mter",))
def measure_ter(spark, d):
    return _round(EV.measure_ter(sides(spark, d)), "ter")


def stored(spark, rows, name: str, buckets: int):
    """A token table as a bucketed table in the shared folder."""
    labels = rows.groupBy("score_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))),
                                                      lambda x: x["token"]).alias("tokens"))
    path = new_path(spark, name)
    return LB.store_labels(labels, path.rsplit("/", 1)[1].replace("-", "_"), path, buckets)


@register("e03_stored_measure_ter", "SELECT score_id, dist, gt_len, pred_len, round(ter, 6) AS ter FROM mter",
          ("mter",))
def stored_measure_ter(spark, d):
    """Predictions and truth in tables with the same buckets."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    both = EV.stack_labels(stored(spark, fx.predictions(spark, d), "predictions", n),
                           stored(spark, fx.tokens(spark, d), "truth", n))
    return _round(EV.measure_ter(both), "ter")


@register("e04_note_error_rate", "SELECT score_id, round(note_err, 6) AS note_err FROM noteerr",
          ("noteerr",))
def note_error_rate(spark, d):
    return _round(EV.note_error_rate(sides(spark, d)), "note_err")


@register("e05_category_recall", "SELECT * FROM recall", ("recall",))
def category_recall(spark, d):
    return EV.category_recall(sides(spark, d))


@register("e06_first_error", "SELECT * FROM firsterr", ("firsterr",))
def first_error(spark, d):
    return EV.first_error(sides(spark, d))


_ANALYSIS_ROUNDED = ("overall_ter", "note_err", "treble_note_err", "bass_note_err", "bass_ter")


@register("e07_analyze_scores", "SELECT * REPLACE (" + ", ".join(
    f"round({c}, 6) AS {c}" for c in _ANALYSIS_ROUNDED) + ") FROM analysis", ("analysis",))
def analyze_scores(spark, d):
    return _round(EV.analyze_scores(fx.predictions(spark, d), fx.tokens(spark, d)),
                  *_ANALYSIS_ROUNDED)


_REPORT = """SELECT {level} AS level, count(*) AS n, {failed} AS n_failed, round(avg(overall_ter), 6) AS ter,
  round(1 - avg(overall_ter), 6) AS accuracy, round(avg(note_err), 6) AS note_err,
  round(avg(CASE WHEN overall_ter = 0 THEN 1 ELSE 0 END), 6) AS pass_rate, {staff}
FROM analysis {tail}"""
_STAFF = ", ".join(f"round(avg({c}), 6) AS {c}" for c in
                   ("treble_note_err", "bass_note_err", "bass_ter"))
_NONE = ", ".join(f"NULL::DOUBLE AS {c}" for c in ("treble_note_err", "bass_note_err", "bass_ter"))


@register("e08_evaluation_report", " UNION ALL ".join((
    _REPORT.format(level="'all'", failed="(SELECT count(DISTINCT score_id) FROM tok) - count(*)",
                   staff=_STAFF, tail=""),
    _REPORT.format(level="'grand'", failed="NULL::BIGINT", staff=_STAFF, tail="WHERE is_grand"),
    _REPORT.format(level="'single'", failed="NULL::BIGINT", staff=_NONE, tail="WHERE NOT is_grand"))),
          ("analysis", "tok"))
def evaluation_report(spark, d):
    truth = fx.tokens(spark, d)
    pairs = fx.labels(spark, d).select("score_id")
    r = EV.evaluation_report(EV.analyze_scores(fx.predictions(spark, d), truth), pairs)
    return _round(r, "ter", "accuracy", "note_err", "pass_rate", "treble_note_err", "bass_note_err",
                  "bass_ter")


@register("e08_micro_recall", "SELECT category, CAST(sum(matched) AS BIGINT) AS matched, "
          "CAST(sum(total) AS BIGINT) AS total, round(sum(matched) / sum(total), 6) AS recall "
          "FROM recall GROUP BY 1", ("recall",))
def micro_recall(spark, d):
    return _round(EV.micro_recall(sides(spark, d)), "recall")


add_cte("vp1", _orphan_sql("pred"), "pred")
add_cte("vp2", _span_sql("vp1"), "vp1")
add_cte("vall", """
SELECT score_id, pos, token, 'g' AS side FROM tok WHERE score_id IN (SELECT score_id FROM vp2)
UNION ALL SELECT score_id, pos, token, 'p' FROM vp2 WHERE score_id IN (SELECT score_id FROM tok)""", "tok", "vp2")
add_cte("vallc", coded_sql("vall", True), "vall", "vocab")


@register("e07_category_recalls", f"""
SELECT score_id, 'all' AS scope, category, matched, total FROM recall
UNION ALL SELECT score_id, voice, category, matched, total FROM ({recall_sql('vsides').replace(
    'score_id,', 'score_id, voice,').replace('GROUP BY 1, 2', 'GROUP BY ALL')})""", ("recall", "vsides"))
def category_recalls(spark, d):
    return EV.scope_recall(fx.predictions(spark, d), fx.tokens(spark, d))


@register("e08_grand_recall", "SELECT category, CAST(sum(matched) AS BIGINT) AS matched, "
          "CAST(sum(total) AS BIGINT) AS total, round(sum(matched) / sum(total), 6) AS recall "
          "FROM recall JOIN grand USING (score_id) WHERE is_grand GROUP BY 1", ("recall", "grand"))
def grand_recall(spark, d):
    return _round(EV.grand_recall(sides(spark, d)), "recall")


@register("e09_validation_summary", f"""
SELECT count(*) AS n_val, round(avg({RATE}), 6) AS val_ter,
  round(greatest(0.0, 1 - avg({RATE})) * 100, 6) AS val_acc
FROM (SELECT score_id, sum(dist) AS dist, sum(gt_len) AS gt_len, sum(pred_len) AS pred_len
  FROM ({dist_sql(f"({measured_sql('vallc')})", "score_id, measure_idx")}) GROUP BY 1)""", ("vallc",))
def validation_summary(spark, d):
    return _round(EV.validation_summary(fx.predictions(spark, d), fx.tokens(spark, d)), "val_ter",
                  "val_acc")


@register("j04_measure_alignment", "SELECT score_id, measure_idx, CAST(dist AS INT) AS dist, "
          "CAST(gt_len AS INT) AS gt_len, CAST(pred_len AS INT) AS pred_len FROM mdist", ("mdist",))
def measure_alignment(spark, d):
    return EV.measure_distance(sides(spark, d))


@register("j05_multiset_intersection", """
SELECT score_id, token, least(g, p) AS matched, g AS total FROM (SELECT score_id, token,
  count(*) FILTER (side = 'g') AS g, count(*) FILTER (side = 'p') AS p FROM sides GROUP BY 1, 2)
WHERE g > 0""", ("sides",))
def multiset_intersection(spark, d):
    c = sides(spark, d).groupBy("score_id", "token").agg(
        F.count_if(F.col("side") == "g").alias("total"), F.count_if(F.col("side") == "p").alias("p"))
    return c.filter("total > 0").select("score_id", "token", F.least("total", "p").alias("matched"),
                                        "total")
