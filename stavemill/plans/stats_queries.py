"""Queries over corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import normalize_job_status
from ..functions.vocab import values_sql
from ..operators import stats as ST
from ..sources import fixtures as fx
from ..sources.jobs import job_events
from ..sources.storage import new_path
from .base import SHARP_SQL, add_cte, midi_sql, register
from .evaluate_queries import _round

add_cte("iv", """
SELECT score_id, pos, voice, CAST(greatest(-14, least(14, step - prev)) AS INT) AS interval
FROM (SELECT *, lag(step) OVER (PARTITION BY score_id, voice ORDER BY pos) AS prev
  FROM (SELECT *, CASE WHEN token LIKE 'note-%' THEN 7 * CAST(right(token, 1) AS INT) +
      strpos('CDEFGAB', substr(token, 6, 1)) END AS step FROM mv
    WHERE token LIKE 'note-%' OR token LIKE 'rest-%')) WHERE token LIKE 'note-%'""", "mv")
add_cte("markov", """
SELECT interval, n, n / (SELECT sum(n) FROM (SELECT count(*) AS n FROM iv WHERE interval IS NOT NULL))
  AS prob FROM (SELECT interval, count(*) AS n FROM iv WHERE interval IS NOT NULL GROUP BY 1)""", "iv")
add_cte("lp", "SELECT iv.*, CASE WHEN iv.interval IS NOT NULL THEN ln(coalesce(prob, (SELECT min(prob) "
        "FROM markov))) END AS log_prob FROM iv LEFT JOIN markov ON iv.interval = markov.interval",
        "iv", "markov")
# Raw events before tie merging, with the spelled chord tones.
add_cte("evx", """
SELECT h.*, e.first_token AS head, x.tones FROM nheads h JOIN nev e USING (score_id, seg)
LEFT JOIN (SELECT score_id, seg, string_agg(substr(token, 7), ',' ORDER BY pos) AS tones FROM nseg
  WHERE token LIKE 'chord-%' GROUP BY 1, 2) x USING (score_id, seg)""", "nheads", "nev", "nseg")
add_cte("keyed", """
SELECT t.*, substr(k, 5) AS key FROM mv t LEFT JOIN (SELECT score_id, arg_min(token, pos) AS k FROM tok
  WHERE token LIKE 'key-%' GROUP BY 1) USING (score_id)""", "mv", "tok")


def _tokens(spark, d):
    return fx.tokens(spark, d)


@register("e10_markov_transitions", "SELECT interval, n, round(prob, 6) AS prob FROM markov",
          ("markov",))
def markov_transitions(spark, d):
    return _round(ST.markov_transitions(_tokens(spark, d)), "prob")


@register("e11_markov_log_prob", "SELECT score_id, pos, interval, round(log_prob, 6) AS log_prob FROM lp",
          ("lp",))
def markov_log_prob(spark, d):
    t = _tokens(spark, d)
    return _round(ST.markov_log_prob(t, ST.markov_transitions(t)).select(
        "score_id", "pos", "interval", "log_prob"), "log_prob")


@register("e11_score_plausibility", "SELECT score_id, round(coalesce(sum(log_prob), 0), 5) AS log_prob, "
          "count(log_prob) AS n_scored FROM lp GROUP BY 1", ("lp",))
def score_plausibility(spark, d):
    t = _tokens(spark, d)
    p = ST.score_plausibility(ST.markov_log_prob(t, ST.markov_transitions(t)))
    return p.withColumn("log_prob", F.round("log_prob", 5))


def _audit_sql(kind: str) -> str:
    return f"""
SELECT '{kind}' AS kind, value, n, round(n / sum(n) OVER (), 6) AS share, target,
  round(abs(n / sum(n) OVER () - target), 6) AS gap
FROM (SELECT coalesce(s.value, w.value) AS value, coalesce(n, 0) AS n,
    CAST(coalesce(target, 0) AS DOUBLE) AS target
  FROM (SELECT substr(token, {len(kind) + 2}) AS value, count(*) AS n FROM tok
        WHERE token LIKE '{kind}-%' GROUP BY 1) s
  FULL JOIN ({values_sql(['value', 'target'], list(ST.TARGETS[kind].items()))}) w
    ON s.value = w.value)"""


@register("e12_distribution_audit", " UNION ALL ".join(_audit_sql(k) for k in ST.TARGETS), ("tok",))
def distribution_audit(spark, d):
    t = _tokens(spark, d)
    out = None
    for kind in ST.TARGETS:
        a = ST.distribution_audit(t, kind)
        out = a if out is None else out.unionByName(a)
    return _round(out, "share", "gap")


@register("e13_interval_cap_audit", f"""
SELECT score_id, pos, voice, leap, cap FROM (SELECT score_id, pos, voice, abs(m - pm) AS leap,
  CASE WHEN NOT pr AND pt <= 12 AND t <= 12 THEN 11 ELSE 12 END AS cap
FROM (SELECT *, last_value(m IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS pm, lag(is_rest) OVER w AS pr, lag(t) OVER w AS pt
  FROM (SELECT *, CASE WHEN NOT is_rest THEN {midi_sql('pitch')} END AS m FROM evx)
  WINDOW w AS (PARTITION BY score_id, voice ORDER BY seg))) WHERE leap > cap""", ("evx",))
def interval_cap_audit(spark, d):
    return ST.interval_cap_audit(_tokens(spark, d))


add_cte("tones", f"""
SELECT score_id, pos, p, {midi_sql("sp")} AS m FROM (SELECT score_id, pos, p,
  {SHARP_SQL.format('p')} AS sp FROM (SELECT score_id, pos, unnest(string_split(substr(head, 6) || ',' ||
    tones, ',')) AS p FROM evx WHERE NOT is_rest AND tones IS NOT NULL))""", "evx")


@register("e14_chord_audit", """
SELECT score_id, pos, CAST(count(*) AS INT) AS size, max(m) - min(m) AS span,
  count(DISTINCT m) = count(m) AS distinct_ok, max(m) - min(m) <= 12 AS span_ok,
  count(*) BETWEEN 2 AND 3 AS size_ok FROM tones GROUP BY 1, 2""", ("tones",))
def chord_audit(spark, d):
    return ST.chord_audit(_tokens(spark, d))


@register("e14_chord_degrees", """
SELECT CAST((strpos('CDEFGAB', left(t, 1)) - strpos('CDEFGAB', substr(head, 6, 1)) + 7) % 7 + 1 AS INT)
  AS degree, count(*) AS n FROM (SELECT head, unnest(string_split(tones, ',')) AS t FROM evx
  WHERE NOT is_rest AND tones IS NOT NULL) GROUP BY 1""", ("evx",))
def chord_degrees(spark, d):
    return ST.chord_degrees(_tokens(spark, d))


@register("e15_diatonic_share", """
SELECT key, count(*) AS n_notes, round(avg(CASE WHEN name = letter || CASE
    WHEN f > 0 AND strpos('FCGDAEB', letter) <= f THEN '#'
    WHEN f < 0 AND strpos('BEADGCF', letter) <= -f THEN 'b' ELSE '' END THEN 1 ELSE 0 END), 6) AS share
FROM (SELECT key, substr(token, 6, length(token) - 6) AS name, substr(token, 6, 1) AS letter,
    list_position(['Gb','Db','Ab','Eb','Bb','F','C','G','D','A','E','B','F#'], key) - 7 AS f
  FROM keyed WHERE token LIKE 'note-%' AND key IS NOT NULL) GROUP BY 1""", ("keyed",))
def diatonic_share(spark, d):
    return _round(ST.diatonic_share(_tokens(spark, d)), "share")


@register("e16_run_audit", """
SELECT score_id, voice, measure_idx, min(pos) AS start_pos, any_value(kind) AS ticks,
  count(*) AS length
FROM (SELECT *, row_number() OVER (PARTITION BY score_id, voice, measure_idx ORDER BY seg)
    - row_number() OVER (PARTITION BY score_id, voice, measure_idx, kind ORDER BY seg) AS island
  FROM (SELECT *, CASE WHEN NOT is_rest AND t IN (12, 6) THEN t END AS kind FROM evx))
WHERE kind IS NOT NULL GROUP BY score_id, voice, measure_idx, kind, island HAVING count(*) >= 4""",
          ("evx",))
def run_audit(spark, d):
    return ST.run_audit(_tokens(spark, d))


_WEIGHTS = values_sql(["degree", "next_degree", "weight"],
                      [(a, b, w) for a, r in ST.DEGREE_TRANSITIONS.items() for b, w in r.items()])


@register("e17_degree_transitions", f"""
SELECT m.degree, m.next_degree, n, CAST(coalesce(weight, 0) AS DOUBLE) AS weight
FROM (SELECT degree, next_degree, count(*) AS n FROM (SELECT CAST(deg AS INT) AS degree, CAST(lead(deg)
    OVER (PARTITION BY score_id ORDER BY measure_idx) AS INT) AS next_degree
  FROM (SELECT score_id, measure_idx, (strpos('CDEFGAB', substr(arg_min(token, pos), 6, 1)) -
      strpos('CDEFGAB', left(any_value(key), 1)) + 7) % 7 + 1 AS deg FROM keyed
    WHERE token LIKE 'note-%' AND voice = 'treble' AND key IS NOT NULL GROUP BY 1, 2))
  WHERE next_degree IS NOT NULL GROUP BY 1, 2) m
LEFT JOIN ({_WEIGHTS}) w ON w.degree = m.degree AND w.next_degree = m.next_degree""", ("keyed",))
def degree_transitions(spark, d):
    return ST.degree_transitions(_tokens(spark, d))


@register("e18_token_frequency", """
SELECT token, count(*) AS n, CASE WHEN regexp_matches(token, '^(ottava-8v[ab]|hairpin-(cresc|dim))-')
  THEN 4.0 ELSE 1.0 END AS weight FROM tok GROUP BY 1""", ("tok",))
def token_frequency(spark, d):
    return ST.token_frequency(_tokens(spark, d), 4.0)


@register("e20_length_profile", """
SELECT n, round(mean_len, 6) AS mean_len, round(long_share, 6) AS long_share,
  round(over_300, 6) AS over_300, round(over_max, 6) AS over_max, p50, p90, p99, longest
FROM (SELECT count(*) AS n, avg(len) AS mean_len, avg((len > 150)::INT) AS long_share,
    avg((len > 300)::INT) AS over_300, avg((len > 608)::INT) AS over_max, max(len) AS longest,
    list_sort(list(len))[CAST(ceil(count(*) * 0.5) AS INT)] AS p50,
    list_sort(list(len))[CAST(ceil(count(*) * 0.9) AS INT)] AS p90,
    list_sort(list(len))[CAST(ceil(count(*) * 0.99) AS INT)] AS p99
  FROM (SELECT score_id, CAST(count(*) AS INT) AS len FROM tok GROUP BY 1))""", ("tok",))
def length_profile(spark, d):
    return _round(ST.length_profile(fx.labels(spark, d)), "mean_len", "long_share", "over_300",
                  "over_max")


_PROBS = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


def _sketched(spark, values, value: str, part: str):
    """Sketches stored part by part, merged, and their ranks against the exact ones."""
    path = new_path(spark, "sketches")
    ST.quantile_sketches(values, value, part).write.parquet(path)
    merged = ST.merged_quantiles(spark.read.parquet(path), _PROBS)
    return ST.rank_errors(values, value, merged, _PROBS).select(
        "name", "p", (F.col("error") <= ST.KLL_ERROR).alias("within"))


_WITHIN = "SELECT * FROM (VALUES ('p10', 0.1::DOUBLE, true), ('p50', 0.5, true), ('p90', 0.9, true), " \
          "('p99', 0.99, true)) AS t(name, p, within) WHERE EXISTS (SELECT * FROM events)"


@register("e20_length_sketches", _WITHIN)
def length_sketches(spark, d):
    lens = fx.labels(spark, d).select((F.col("score_id") % 8).alias("part"), F.size("tokens").alias("len"))
    return _sketched(spark, lens, "len", "part")


@register("e22_delay_sketches", _WITHIN)
def delay_sketches(spark, d):
    return _sketched(spark, _last_status(spark, d), "delay_ms", "status")


@register("e21_vocab_coverage", """
SELECT score_id, count(*) AS n_tokens, count(*) FILTER (v.token IS NULL) AS n_unknown,
  round(count(*) FILTER (v.token IS NULL) / count(*), 6) AS unknown_share,
  coalesce(string_agg(DISTINCT t.token, ',' ORDER BY t.token) FILTER (v.token IS NULL), '') AS unknown
FROM tok t LEFT JOIN vocab v USING (token) GROUP BY 1""", ("tok", "vocab"))
def vocab_coverage(spark, d):
    c = ST.vocab_coverage(_tokens(spark, d)).withColumn("unknown", F.array_join("unknown", ","))
    return _round(c, "unknown_share")


add_cte("jlast", """
SELECT job_id, CASE WHEN status IN ('FAILED', 'CANCELLED', 'TIMED_OUT') OR (status = 'COMPLETED' AND
  output LIKE '%"error"%') THEN 'FAILED' ELSE coalesce(status, 'UNKNOWN') END AS status, delay_ms, exec_ms
FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS r FROM jobs)
WHERE r = 1""", "jobs")


def _last_status(spark, d):
    return ST.job_last_status(job_events(spark, d), normalize_job_status("status", "output"))


@register("e22_job_last_status", "SELECT * FROM jlast", ("jlast",))
def job_last_status(spark, d):
    return _last_status(spark, d)


@register("e22_job_stats", """
SELECT count(*) AS n_jobs, round(avg((status = 'FAILED')::INT), 6) AS failure_share,
  list_sort(list(delay_ms))[CAST(ceil(count(*) * 0.5) AS INT)] AS delay_p50,
  list_sort(list(delay_ms))[CAST(ceil(count(*) * 0.95) AS INT)] AS delay_p95,
  list_sort(list(exec_ms))[CAST(ceil(count(*) * 0.5) AS INT)] AS exec_p50,
  list_sort(list(exec_ms))[CAST(ceil(count(*) * 0.95) AS INT)] AS exec_p95 FROM jlast""", ("jlast",))
def job_stats(spark, d):
    return _round(ST.job_stats(_last_status(spark, d)), "failure_share")
