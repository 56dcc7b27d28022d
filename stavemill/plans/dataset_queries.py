"""Queries over dataset assembly, vocabulary joins and training logs (D1-D8, J, L1-L6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tokens import encode, is_real_photo
from ..operators import datasets as DS
from ..operators import sequence as S
from ..operators import stats as ST
from ..operators import trainlog as TL
from ..sources import fixtures as fx
from .base import add_cte, register
from .sequence_queries import _split_sql, split_input

_M = DS.MODULUS


def _mixed_sql(x: str) -> str:
    for shift, factor in DS.ROUNDS:
        x = f"((xor({x}, {x} >> {shift}) * {factor}) & {DS.HALF})"
    return f"xor({x}, {x} >> {DS.LAST_SHIFT})"


def hash_sql(key: str, seed: int) -> str:
    key = f"({key})::BIGINT"
    # The upper half of the keys here is zero, so its mix is a constant.
    high = seed
    for shift, factor in DS.ROUNDS:
        high = ((high ^ (high >> shift)) * factor) & DS.HALF
    high ^= high >> DS.LAST_SHIFT
    return f"({_mixed_sql(f'xor({key} & {DS.HALF}, {high}::BIGINT)')})"


def uniform_sql(key: str, seed: int) -> str:
    return f"({hash_sql(key, seed)} / {_M}.0::DOUBLE)"


add_cte("msys", """
SELECT score_id, n_staves, CASE WHEN is_grand AND n_staves >= 2 AND n_staves % 2 = 0 THEN n_staves // 2
  ELSE n_staves END AS n_systems, CASE WHEN is_grand AND n_staves >= 2 AND n_staves % 2 = 0 THEN brk END
  AS brk FROM meta JOIN grand USING (score_id) WHERE n_staves > 0""", "meta", "grand")


_SAMPLES = ("SELECT score_id, system_idx AS sample_idx, pos, token FROM ("
            + _split_sql("n_systems", True).replace("FROM m)", "FROM msys)") + ")")


@register("d01_explode_samples", _SAMPLES, ("hdr", "body", "totals", "msys"))
def explode_samples(spark, d):
    return DS.explode_samples(fx.score_meta(spark, d))


@register("d01_overlong_samples", f"SELECT score_id, sample_idx, count(*) AS n_tokens FROM ({_SAMPLES}) "
          "GROUP BY 1, 2 HAVING count(*) > 300", ("hdr", "body", "totals", "msys"))
def overlong_samples(spark, d):
    return DS.overlong_samples(DS.explode_samples(fx.score_meta(spark, d)), 300)


@register("d02_replay_sample", f"""
SELECT doc_id, false AS replayed FROM documents WHERE lang = 'en' UNION ALL
SELECT doc_id, true FROM (SELECT doc_id FROM documents WHERE lang <> 'en'
  ORDER BY {hash_sql('doc_id', 7)}, doc_id LIMIT 150)""")
def replay_sample(spark, d):
    docs = fx.table(spark, d, "documents").select("doc_id", "lang")
    return DS.replay_sample(docs.filter("lang = 'en'").select("doc_id"),
                            docs.filter("lang <> 'en'").select("doc_id"), "doc_id", 150, 7)


@register("d03_split_dataset", f"""
SELECT event_id, CASE WHEN r <= greatest(1, floor(n * 0.1)) THEN 'val' ELSE 'train' END AS split
FROM (SELECT event_id, row_number() OVER (ORDER BY {hash_sql('event_id', 42)}, event_id) AS r,
  count(*) OVER () AS n FROM events)""")
def split_dataset(spark, d):
    return DS.split_dataset(fx.table(spark, d, "events").select("event_id"), "event_id")


def _id_arrays(spark, d):
    ids = encode(fx.tokens(spark, d)).groupBy("score_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    return ids.withColumn("batch_id", F.floor(F.col("score_id") / 8))


add_cte("ids", "SELECT score_id, pos, coalesce(id, 3) AS id FROM tok LEFT JOIN vocab USING (token)",
        "tok", "vocab")
add_cte("idl", "SELECT score_id, list(id ORDER BY pos) AS ids FROM ids GROUP BY 1", "ids")
add_cte("shift", "SELECT score_id, score_id // 8 AS batch_id, [1] || ids AS tin, ids || [2] AS tout "
        "FROM idl", "idl")


@register("d04_shift_targets", "SELECT score_id, array_to_string(tin, ' ') AS tgt_in, "
          "array_to_string(tout, ' ') AS tgt_out FROM shift", ("shift",))
def shift_targets(spark, d):
    s = DS.shift_targets(_id_arrays(spark, d))
    return s.select("score_id", F.array_join("tgt_in", " ").alias("tgt_in"),
                    F.array_join("tgt_out", " ").alias("tgt_out"))


@register("d05_pad_batch", """
SELECT score_id, batch_id, array_to_string(list_resize(tin, m, 0), ' ') AS tgt_in,
  array_to_string(list_resize(tout, m, 0), ' ') AS tgt_out, CAST(m - len(tin) AS INT) AS n_masked
FROM (SELECT *, max(len(tin)) OVER (PARTITION BY batch_id) AS m FROM shift)""", ("shift",))
def pad_batch(spark, d):
    p = DS.pad_batch(DS.shift_targets(_id_arrays(spark, d)))
    return p.select("score_id", "batch_id", F.array_join("tgt_in", " ").alias("tgt_in"),
                    F.array_join("tgt_out", " ").alias("tgt_out"),
                    F.size(F.filter("mask", lambda x: x)).alias("n_masked"))


@register("d06_augment_policy", f"""
SELECT doc_id, NOT photo AS augmented, CASE WHEN NOT photo THEN CASE WHEN u < 0.65 THEN 3 ELSE 2 END END
  AS level
FROM (SELECT doc_id, doc_id % 4 = 1 AS photo, CASE WHEN n_chars % 10 = 0 THEN
    {uniform_sql('doc_id', 42)} ELSE {uniform_sql('doc_id * 1009 + 5', 42)} END AS u FROM documents)""")
def augment_policy(spark, d):
    name = F.when(F.col("doc_id") % 4 == 1, "scan.JPG").otherwise("page.png")
    docs = fx.table(spark, d, "documents").select(
        "doc_id", is_real_photo(name).alias("is_photo"), (F.col("n_chars") % 10 == 0).alias("is_val"))
    return DS.augment_policy(docs, "doc_id", 2, 3, 0.65, epoch=5).select("doc_id", "augmented",
                                                                         "level")


def _pick_sql(weights: dict, seed: int) -> str:
    cum, total, parts = 0.0, sum(weights.values()), []
    items = list(weights.items())
    for v, w in items[:-1]:
        cum += w
        parts.append(f"WHEN u < {cum / total!r} THEN '{v}'")
    return f"CASE {' '.join(parts)} ELSE '{items[-1][0]}' END"


@register("d07_weighted_pick", f"SELECT event_id, {_pick_sql(ST.DURATION_WEIGHTS, 3)} AS dur FROM "
          f"(SELECT event_id, {uniform_sql('event_id', 3)} AS u FROM events)")
def weighted_pick(spark, d):
    ev = fx.table(spark, d, "events").select("event_id")
    return DS.weighted_pick(ev, "event_id", ST.DURATION_WEIGHTS, "dur", 3)


@register("d07_source_pick", f"""
SELECT doc_id, source, picked FROM (SELECT doc_id, source, {hash_sql('doc_id', 3)} AS h FROM documents) d
JOIN (SELECT source AS g, lang AS picked, floor((upto - w) / total * 4294967296) AS lo,
    floor(upto / total * 4294967296) AS hi
  FROM (SELECT *, CAST(sum(w) OVER (PARTITION BY source ORDER BY lang) AS DOUBLE) AS upto,
      CAST(sum(w) OVER (PARTITION BY source) AS DOUBLE) AS total
    FROM (SELECT source, lang, sum(n_chars) AS w FROM documents GROUP BY 1, 2))) c
  ON g = source AND h >= lo AND h < hi""")
def source_pick(spark, d):
    """A language for every document, drawn by the characters of each language in its source."""
    docs = fx.table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    weights = docs.groupBy("source", F.col("lang").alias("picked")).agg(F.sum("n_chars").alias("weight"))
    return DS.weighted_pick_by(docs.select("doc_id", "source"), "doc_id", "source", weights, "picked", 3)


def vocabularies(spark, d):
    """Two vocabularies: all words of English, German and Spanish documents, and of English, French and
    Spanish ones."""
    docs = fx.table(spark, d, "documents").select("doc_id", "lang", F.explode(F.split("text", " ")).alias(
        "token")).groupBy("token", "lang").agg(F.min("doc_id").alias("id"))
    by = lambda langs: docs.filter(F.col("lang").isin(*langs)).groupBy("token").agg(
        F.min("id").alias("id"))
    emb = fx.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"),
                                                  F.col("embedding").alias("vector"))
    old = by(("en", "de", "es")).join(emb, "id", "left")
    return old, by(("en", "fr", "es"))


add_cte("docwords", "SELECT DISTINCT doc_id, lang, unnest(string_split(text, ' ')) AS token FROM documents")
add_cte("voc", """
SELECT o.token AS ot, n.token AS nt, o.id AS oid, n.id AS nid
FROM (SELECT token, min(doc_id) AS id FROM docwords WHERE lang IN ('en', 'de', 'es') GROUP BY 1) o
FULL JOIN (SELECT token, min(doc_id) AS id FROM docwords WHERE lang IN ('en', 'fr', 'es') GROUP BY 1) n
  ON o.token = n.token""", "docwords")


@register("j03_vocab_remap", """
SELECT nt AS token, nid AS id, oid AS old_id, oid IS NOT NULL AS matched,
  round(embedding[1]::DOUBLE, 5) AS v0
FROM voc LEFT JOIN embeddings ON vec_id = oid WHERE nt IS NOT NULL""", ("voc",))
def vocab_remap(spark, d):
    r = DS.vocab_remap(*vocabularies(spark, d))
    v0 = F.round(F.get("vector", F.lit(0)).cast("double"), 5)
    return r.select("token", "id", "old_id", "matched", v0.alias("v0"))


@register("j03_vocab_dropped", "SELECT ot AS token, oid AS id FROM voc WHERE nt IS NULL", ("voc",))
def vocab_dropped(spark, d):
    return DS.vocab_dropped(*vocabularies(spark, d)).select("token", "id")


@register("d08_remap_report", "SELECT count(*) FILTER (ot IS NOT NULL AND nt IS NOT NULL) AS matched, "
          "count(nt) AS new_total, count(ot) AS old_total FROM voc", ("voc",))
def remap_report(spark, d):
    return DS.remap_report(*vocabularies(spark, d))


@register("j02_token_vocabulary", "SELECT token, id, count(*) AS n FROM tok LEFT JOIN vocab USING (token) "
          "GROUP BY 1, 2", ("tok", "vocab"))
def token_vocabulary(spark, d):
    from ..functions.vocab import vocab_dim
    dim = vocab_dim(spark).select("token", "id")
    return fx.tokens(spark, d).join(F.broadcast(dim), "token", "left").groupBy("token", "id").agg(
        F.count("*").alias("n"))


@register("j06_treble_bass_by_measure", """
SELECT t.score_id, t.measure_idx, t.ticks AS treble, b.ticks AS bass FROM beats t JOIN beats b
  ON t.score_id = b.score_id AND t.measure_idx = b.measure_idx AND b.voice = 'bass'
WHERE t.voice = 'treble'""", ("beats",))
def treble_bass_by_measure(spark, d):
    """The inner join of the two parts, as one conditional aggregation of the same rows."""
    b = S.measure_beats(fx.tokens(spark, d))
    pick = lambda v: F.max(F.when(F.col("voice") == v, F.col("ticks")))
    return b.groupBy("score_id", "measure_idx").agg(
        pick("treble").alias("treble"), pick("bass").alias("bass")).filter(
        "treble IS NOT NULL AND bass IS NOT NULL")


@register("j10_measure_systems", """
SELECT DISTINCT b.score_id, b.measure_idx, CAST(s AS INT) AS system_idx
FROM body b JOIN totals USING (score_id) JOIN (SELECT score_id, n_staves, unnest(range(n_staves)) AS s
  FROM m) p ON p.score_id = b.score_id AND b.measure_idx >= s * total // n_staves
  AND b.measure_idx < (s + 1) * total // n_staves""", ("body", "totals", "m"))
def measure_systems(spark, d):
    """Range join of measures and system bounds; even bounds have a closed form, so no join."""
    df = S._body_measures(split_input(spark, d)).filter(~F.col("in_header"))
    s = F.floor(((F.col("measure_idx") + 1) * F.col("n_staves") - 1) / F.col("total")).cast("int")
    return df.select("score_id", "measure_idx", s.alias("system_idx")).distinct()


def _bound_sql(s: str) -> str:
    """Where system ``s`` starts."""
    return (f"CASE WHEN brk > 0 AND brk < total AND n_systems = 2 THEN CASE {s} WHEN 0 THEN 0 WHEN 1 THEN brk "
            f"ELSE total END ELSE {s} * total // n_systems END")


@register("j10_system_ranges", f"""
SELECT DISTINCT b.score_id, b.measure_idx, CAST(s AS INT) AS system_idx
FROM body b JOIN totals USING (score_id) JOIN (SELECT score_id, n_systems, brk, unnest(range(n_systems)) AS s
  FROM m) p ON p.score_id = b.score_id AND b.measure_idx >= {_bound_sql('s')}
  AND b.measure_idx < {_bound_sql('(s + 1)')}""",
          ("body", "totals", "m"))
def system_ranges(spark, d):
    """Measures in the systems of the score, explicit line breaks first."""
    body = S._body_measures(split_input(spark, d)).filter(~F.col("in_header"))
    scores = body.groupBy("score_id").agg(F.max("total").alias("total"), F.max("n_systems").alias("n_systems"),
                                          F.max("breaks").alias("breaks"))
    return S.measure_systems(body.select("score_id", "measure_idx").distinct(), scores)


# -- training logs -----------------------------------------------------------------------------

def epoch_log(spark, d):
    """One run per 40 consecutive order keys; the error falls with the epoch, plus noise."""
    o = fx.table(spark, d, "orders")
    cents = F.floor(F.col("o_totalprice") * 100 + 0.5).cast("bigint")
    ep = F.col("o_orderkey") % 40 + 1
    ter = F.greatest(F.lit(5), 700 - ep * 14 + cents % 240) / 1000.0
    return o.select(((F.col("o_orderkey") - F.col("o_orderkey") % 40) / 40).cast("bigint")
                    .alias("run_id"), ep.cast("int").alias("epoch"), ter.alias("val_ter"))


add_cte("elog", """
SELECT (o_orderkey - o_orderkey % 40) // 40 AS run_id, CAST(o_orderkey % 40 + 1 AS INT) AS epoch,
  greatest(5, 700 - (o_orderkey % 40 + 1) * 14 + floor(o_totalprice * 100 + 0.5)::BIGINT % 240)
    / 1000.0::DOUBLE AS val_ter FROM orders""")
add_cte("elb", """
SELECT *, coalesce(val_ter < min(val_ter) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)
  AS is_best, min(val_ter) OVER w AS best_ter, greatest(0.0, 1 - val_ter) * 100 AS acc
FROM elog WINDOW w AS (PARTITION BY run_id ORDER BY epoch)""", "elog")
add_cte("elp2", """
SELECT *, CAST(epoch - max(CASE WHEN is_best THEN epoch END) OVER w AS INT) AS since_best,
  CASE WHEN acc BETWEEN 55 AND 80 THEN CAST(epoch - coalesce(max(CASE WHEN acc NOT BETWEEN 55 AND 80
    THEN epoch END) OVER w, 0) AS BIGINT) ELSE 0 END AS streak
FROM elb WINDOW w AS (PARTITION BY run_id ORDER BY epoch)""", "elb")


@register("l01_best_so_far", "SELECT run_id, epoch, is_best, best_ter FROM elb", ("elb",))
def best_so_far(spark, d):
    return TL.best_so_far(epoch_log(spark, d)).select("run_id", "epoch", "is_best", "best_ter")


@register("l02_patience_stop", "SELECT run_id, epoch, since_best, since_best >= 5 AS patience_stop "
          "FROM elp2", ("elp2",))
def patience_stop(spark, d):
    return TL.patience_stop(epoch_log(spark, d), 5).select("run_id", "epoch", "since_best",
                                                           "patience_stop")


@register("l03_target_stop", "SELECT run_id, epoch, epoch = 20 AND greatest(0.0, 1 - best_ter) * 100 < "
          "58 AS target_stop FROM elb", ("elb",))
def target_stop(spark, d):
    return TL.target_stop(epoch_log(spark, d), 58.0, 40).select("run_id", "epoch", "target_stop")


@register("l04_plateau_stop", "SELECT run_id, epoch, streak, streak >= 4 AND epoch >= 8 AS plateau_stop "
          "FROM elp2", ("elp2",))
def plateau_stop(spark, d):
    return TL.plateau_stop(epoch_log(spark, d), 55.0, 80.0, 4, 8).select(
        "run_id", "epoch", "streak", "plateau_stop")


@register("l05_teacher_forcing_ratio", """
SELECT run_id, epoch, round(CASE WHEN epoch > 5 THEN greatest(0.1, 1.0 - 0.9 / 20 * (epoch - 6))
  ELSE 1.0 END, 6)::DOUBLE AS tf FROM elog""", ("elog",))
def teacher_forcing_ratio(spark, d):
    tf = TL.teacher_forcing_ratio(F.col("epoch"), 1.0, 0.1, 20, 5)
    return epoch_log(spark, d).select("run_id", "epoch", F.round(tf, 6).alias("tf"))


@register("l06_stop_epoch", """
SELECT run_id, coalesce(min(epoch) FILTER (why < 3), max(epoch)) AS stop_epoch,
  CASE arg_min(why, epoch) FILTER (why < 3) WHEN 0 THEN 'target' WHEN 1 THEN 'patience'
    WHEN 2 THEN 'plateau' END AS reason
FROM (SELECT *, CASE WHEN epoch = 20 AND greatest(0.0, 1 - best_ter) * 100 < 58 THEN 0
    WHEN since_best >= 9 THEN 1 WHEN streak >= 6 AND epoch >= 8 THEN 2 ELSE 3 END AS why FROM elp2)
GROUP BY 1""", ("elp2",))
def stop_epoch(spark, d):
    return TL.stop_epoch(epoch_log(spark, d), 40, 58.0, 9, (55.0, 80.0), 6, 8)
