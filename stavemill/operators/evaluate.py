"""Predictions against ground truth.

Both sides are stacked and keyed by ``score_id``; every comparison is an aggregation by score
(and measure, position or token), so sides with missing measures or tokens need no outer join.
Edit distances run in the JVM: each token is one character of a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tokens import is_note_token, token_category
from ..functions.vocab import SYMBOL_BASE, UNK_ID, vocab_dim
from .repair import drop_orphan_chords, drop_unmatched_spans
from .sequence import assign_voice, flag, measure_index

MISSING, EXTRA = "<누락>", "<없음>"  # fixed values: first-error markers
SIDE = ("score_id", "side")
VOCAB_SIZE = 259


def stack(pred: DataFrame, truth: DataFrame, evaluated: DataFrame | None = None) -> DataFrame:
    """``(score_id, pos, token, side)``, side 'p' or 'g', of the evaluated scores.

    By default these are the scores with rows on both sides; a score without a prediction counts
    as failed. ``evaluated`` (score ids) keeps scores whose prediction or truth is empty.
    """
    rows = truth.select("score_id", "pos", "token", F.lit("g").alias("side")).unionByName(
        pred.select("score_id", "pos", "token", F.lit("p").alias("side")))
    if evaluated is not None:
        return rows.join(evaluated.select("score_id").distinct(), "score_id", "left_semi")
    w = Window.partitionBy("score_id")
    both = rows.withColumn("_lo", F.min("side").over(w)).withColumn("_hi", F.max("side").over(w))
    return both.filter("_lo = 'g' AND _hi = 'p'").drop("_lo", "_hi")


def stack_labels(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``stack`` of two label tables ``(score_id, tokens)``: the arrays meet before they become rows, so tables
    with the same buckets need no exchange."""
    both = truth.select("score_id", F.col("tokens").alias("g")).join(
        pred.select("score_id", F.col("tokens").alias("p")), "score_id")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("tokens")) for s in ("g", "p")])
    return both.where((F.size("g") > 0) & (F.size("p") > 0)).select("score_id", F.inline(sides)).select(
        "score_id", "side", F.posexplode("tokens").alias("pos", "token")).select("score_id", "pos", "token", "side")


def _symbols(rows: DataFrame, exact: bool = False) -> DataFrame:
    """Adds ``sym``, one character per token; tokens outside the vocabulary share the unknown one.
    ``exact`` adds ``code``, where they stay distinct: each takes the character of its place among
    the score's unknown tokens (a window without an order, hence without an extra sort)."""
    dim = vocab_dim(rows.sparkSession).select("token", F.col("sym").alias("_v"))
    df = rows.join(F.broadcast(dim), "token", "left")
    if exact:
        unknown = F.array_sort(F.collect_set(F.when(F.col("_v").isNull(), F.col("token"))).over(
            Window.partitionBy("score_id")))
        df = df.withColumn("_u", unknown).withColumn("code", F.coalesce(
            "_v", code_char(F.array_position("_u", F.col("token")) + VOCAB_SIZE))).drop("_u")
    return df.withColumn("sym", F.coalesce("_v", F.lit(chr(SYMBOL_BASE + UNK_ID)))).drop("_v")


def code_char(code: Column) -> Column:
    """One character per small integer; an error where no single character is left."""
    code = code + SYMBOL_BASE
    code = F.when(code < 0xD800, code).otherwise(F.raise_error(F.lit(
        "a score has too many distinct unknown tokens")).cast("bigint"))
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _text(side: str, c: str = "sym", when: Column | None = None) -> Column:
    keep = F.col("side") == side
    if when is not None:
        keep = keep & when
    listed = F.array_sort(F.collect_list(F.when(keep, F.struct("pos", c))))
    return F.array_join(F.transform(listed, lambda x: x[c]), "")


def error_rate(dist: Column, gt_len: Column, pred_len: Column) -> Column:
    """An empty truth scores 0 against an empty prediction and 1 otherwise."""
    return F.when(gt_len == 0, F.when(pred_len == 0, 0.0).otherwise(1.0)).otherwise(dist / gt_len)


def token_distance(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """``(score_id, dist, gt_len, pred_len, ter)`` over whole scores."""
    per = _symbols(stack(pred, truth)).groupBy("score_id").agg(_text("p").alias("p"),
                                                               _text("g").alias("g"))
    return per.select("score_id", F.levenshtein("p", "g").alias("dist"),
                      F.length("g").alias("gt_len"), F.length("p").alias("pred_len")) \
        .withColumn("ter", error_rate(F.col("dist"), F.col("gt_len"), F.col("pred_len")))


def measure_distance(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Distance per measure ordinal; a side without that measure is the empty string."""
    df = measure_index(_symbols(rows), "eval", ("score_id", *keys, "side"))
    per = df.groupBy("score_id", *keys, "measure_idx").agg(_text("p").alias("p"),
                                                           _text("g").alias("g"))
    return per.select("score_id", *keys, "measure_idx", F.levenshtein("p", "g").alias("dist"),
                      F.length("g").alias("gt_len"), F.length("p").alias("pred_len"))


def measure_ter(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Errors cannot spread across measures."""
    per = measure_distance(rows, keys).groupBy("score_id", *keys).agg(
        F.sum("dist").alias("dist"), F.sum("gt_len").alias("gt_len"),
        F.sum("pred_len").alias("pred_len"))
    return per.withColumn("ter", error_rate(F.col("dist"), F.col("gt_len"), F.col("pred_len")))


def note_error_rate(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Note, chord, rest and duration tokens only, compared as written.

    Spellings outside the vocabulary stay distinct.
    """
    note = is_note_token("token")
    per = _symbols(rows, exact=True).groupBy("score_id", *keys).agg(
        _text("p", "code", note).alias("p"), _text("g", "code", note).alias("g"))
    return per.select("score_id", *keys, error_rate(F.levenshtein("p", "g"), F.length("g"),
                                                    F.length("p")).alias("note_err"))


def category_recall(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Multiset matches and truth totals per category of the truth."""
    per_token = rows.groupBy("score_id", *keys, "token").agg(
        F.sum(flag(F.col("side") == "g")).alias("g"), F.sum(flag(F.col("side") == "p")).alias("p"))
    return per_token.filter("g > 0").groupBy(
        "score_id", *keys, token_category("token").alias("category")).agg(
        F.sum(F.least("g", "p")).alias("matched"), F.sum("g").alias("total"))


def first_error(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """First differing position with both tokens; equal sequences yield no row."""
    at = rows.groupBy("score_id", *keys, "pos").agg(
        F.max(F.when(F.col("side") == "g", F.col("token"))).alias("g"),
        F.max(F.when(F.col("side") == "p", F.col("token"))).alias("p"))
    first = at.filter(~F.col("g").eqNullSafe(F.col("p"))).groupBy("score_id", *keys).agg(
        F.min(F.struct("pos", "g", "p")).alias("e"))
    return first.select("score_id", *keys, F.col("e.pos").alias("error_pos"),
                        F.coalesce("e.g", F.lit(EXTRA)).alias("gt_token"),
                        F.coalesce("e.p", F.lit(MISSING)).alias("pred_token"))


def scoped_rows(rows: DataFrame) -> DataFrame:
    """Repeats the rows of grand scores per staff: adds ``scope`` (all / treble / bass)."""
    grand = F.max(flag((F.col("side") == "g") & (F.col("token") == "staff-bass"))).over(
        Window.partitionBy("score_id"))
    df = assign_voice(rows, "eval", SIDE).withColumn("is_grand", grand == 1)
    staff = F.when(F.col("is_grand") & (F.col("token") != "staff-bass"), F.array("voice")).otherwise(
        F.array().cast("array<string>"))
    return df.select("score_id", "side", "pos", "token", "is_grand",
                     F.explode(F.concat(F.array(F.lit("all")), staff)).alias("scope"))


def compare_scopes(rows: DataFrame) -> DataFrame:
    """Measure TER, note error rate and first error per (score, scope) in one pass: measures are
    reduced to strings first, scores to the joined strings of their measures. No joins, and every
    step is clustered by ``score_id``."""
    df = _symbols(rows, exact=True).withColumn(
        "code", F.when(is_note_token("token"), F.col("code")).otherwise(""))
    df = measure_index(df, "eval", ("score_id", "scope", "side"))
    listed = lambda side: F.array_sort(F.collect_list(
        F.when(F.col("side") == side, F.struct("pos", "sym", "code", "token"))))
    joined = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), "")
    per_measure = df.groupBy("score_id", "scope", "is_grand", "measure_idx").agg(
        listed("p").alias("lp"), listed("g").alias("lg")).select(
        "score_id", "scope", "is_grand", "measure_idx",
        joined("lp", "sym").alias("p"), joined("lg", "sym").alias("g"),
        joined("lp", "code").alias("pn"), joined("lg", "code").alias("gn"),
        F.col("lp.token").alias("pt"), F.col("lg.token").alias("gt"))
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("measure_idx", c))),
                                     lambda x: x[c])
    per = per_measure.groupBy("score_id", "scope", "is_grand").agg(
        F.sum(F.levenshtein("p", "g")).alias("dist"), F.sum(F.length("g")).alias("gt_len"),
        F.sum(F.length("p")).alias("pred_len"),
        F.array_join(in_order("pn"), "").alias("pn"), F.array_join(in_order("gn"), "").alias("gn"),
        F.flatten(in_order("pt")).alias("pt"), F.flatten(in_order("gt")).alias("gt"))
    same = F.zip_with("gt", "pt", lambda g, p: g.eqNullSafe(p))
    at = F.nullif(F.array_position(same, False).cast("int"), F.lit(0)) - 1
    df = per.withColumn("error_pos", at)
    token = lambda c, missing: F.when(F.col("error_pos").isNotNull(),
                                      F.coalesce(F.get(c, F.col("error_pos")), F.lit(missing)))
    return df.select(
        "score_id", "scope", "is_grand", "gt_len", "pred_len",
        error_rate(F.col("dist"), F.col("gt_len"), F.col("pred_len")).alias("ter"),
        error_rate(F.levenshtein("pn", "gn"), F.length("gn"), F.length("pn")).alias("note_err"),
        "error_pos", token("gt", EXTRA).alias("gt_token"), token("pt", MISSING).alias("pred_token"))


def analyze_scores(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per score; staff columns only for grand scores."""
    per = compare_scopes(scoped_rows(stack(pred, truth)))
    pick = lambda scope, c: F.max(F.when(F.col("scope") == scope, F.col(c)))
    return per.groupBy("score_id").agg(
        F.bool_or("is_grand").alias("is_grand"),
        pick("all", "gt_len").alias("gt_len"), pick("all", "pred_len").alias("pred_len"),
        pick("all", "ter").alias("overall_ter"), pick("all", "note_err").alias("note_err"),
        pick("all", "error_pos").alias("error_pos"), pick("all", "gt_token").alias("gt_token"),
        pick("all", "pred_token").alias("pred_token"),
        pick("treble", "note_err").alias("treble_note_err"),
        pick("bass", "note_err").alias("bass_note_err"), pick("bass", "ter").alias("bass_ter"),
        pick("treble", "error_pos").alias("treble_first"),
        pick("bass", "error_pos").alias("bass_first"),
        pick("treble", "gt_token").alias("treble_gt_token"),
        pick("treble", "pred_token").alias("treble_pred_token"),
        pick("bass", "gt_token").alias("bass_gt_token"),
        pick("bass", "pred_token").alias("bass_pred_token"))


def scope_recall(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Category recall of whole scores and, for grand scores, of each staff."""
    return category_recall(scoped_rows(stack(pred, truth)), ("scope",))


def evaluation_report(analysis: DataFrame, pairs: DataFrame, compat: bool = False) -> DataFrame:
    """Overall and per staff layout. ``pairs(score_id)`` lists every score; means divide by the
    evaluated ones and the rest is reported as failed. ``compat`` divides the overall means by all
    pairs, so failures look like perfect scores in the errors."""
    rows = pairs.select("score_id").join(analysis, "score_id", "left")
    rolled = rows.rollup("is_grand").agg(
        F.grouping("is_grand").alias("_all"), F.count("*").alias("n_pairs"),
        F.count("overall_ter").alias("n"),
        F.avg("overall_ter").alias("ter"), F.avg("note_err").alias("note_err"),
        F.avg((F.col("overall_ter") == 0.0).cast("int")).alias("pass_rate"),
        F.avg("treble_note_err").alias("treble_note_err"),
        F.avg("bass_note_err").alias("bass_note_err"), F.avg("bass_ter").alias("bass_ter"))
    rolled = rolled.filter((F.col("_all") == 1) | F.col("is_grand").isNotNull())
    level = F.when(F.col("_all") == 1, "all").when(F.col("is_grand"), "grand").otherwise("single")
    if compat:
        share = F.when(F.col("_all") == 1, F.col("n") / F.col("n_pairs")).otherwise(1.0)
        for c in ("ter", "note_err", "pass_rate"):
            rolled = rolled.withColumn(c, F.col(c) * share)
    return rolled.select(
        level.alias("level"), "n",
        F.when(F.col("_all") == 1, F.col("n_pairs") - F.col("n")).alias("n_failed"),
        "ter", (1 - F.col("ter")).alias("accuracy"), "note_err", "pass_rate",
        F.when(level != "single", F.col("treble_note_err")).alias("treble_note_err"),
        F.when(level != "single", F.col("bass_note_err")).alias("bass_note_err"),
        F.when(level != "single", F.col("bass_ter")).alias("bass_ter"))


def micro_recall(rows: DataFrame) -> DataFrame:
    """Category recall over all scores."""
    return category_recall(rows).groupBy("category").agg(
        F.sum("matched").alias("matched"), F.sum("total").alias("total")).withColumn(
        "recall", F.col("matched") / F.col("total"))


def grand_recall(rows: DataFrame) -> DataFrame:
    """Category recall over all grand scores (truth with a lower staff)."""
    grand = F.max(flag((F.col("side") == "g") & (F.col("token") == "staff-bass"))).over(
        Window.partitionBy("score_id"))
    return micro_recall(rows.withColumn("_g", grand).filter("_g = 1").drop("_g"))


def validation_summary(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean measure TER of all scores after the span and chord repairs."""
    fixed = drop_unmatched_spans(drop_orphan_chords(pred))
    ter = measure_ter(stack(fixed, truth)).agg(F.count("*").alias("n_val"), F.avg("ter").alias("val_ter"))
    return ter.withColumn("val_acc", F.greatest(F.lit(0.0), 1 - F.col("val_ter")) * 100)
