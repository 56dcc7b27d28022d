"""Hard negatives by Fagin's threshold algorithm.

For every anchor: its positives are the best ``k`` other rows of its label; for every positive, the negatives
are the best ``k`` rows of other labels whose score lies in the window ``[80 %, 100 %]`` of the positive's.

Rows are dealt by hash into blocks of about ``BLOCK_ROWS``, anchors into parts of at most about ``PART_ROWS``;
every pair of an anchor part and a block is one group of a cogroup, so that neither side is ever whole in one
task, and a hot label is spread like any other. A group keeps one list of its candidates for each dimension,
sorted by component. An anchor reads all lists from the end that its own component's sign makes best, in steps
of doubling depth. A row seen for the first time is scored at once by its integer inner product (random
access). The threshold, the anchor's product with the components at the depth reached, bounds every row not
yet seen. Reading stops when it lies strictly below the ``k``-th score of every window, or below a window's
lower end while the window is not full: a row with an equal score could win by its id. The windows of all
blocks are merged by rank. Results are exact.

Two passes, as the windows depend on the positives of all blocks: positives read lists of the anchor's label,
negatives lists of all others.

Scores are integers; numpy computes them in floating point only where their bound shows that this is exact.

Defined cases: rows with a null label, a null vector or a component that is null or not finite take no part;
the quantised component is held within ``+-LIMIT`` so that scores fit a long; a vector shorter than the longest
ends in zeros; rows repeated in id, label and vector count once; rows that share an id with unlike vectors or
labels all take part, but no row serves an anchor of its own id; null ids are candidates after all others and
never anchors; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import register, small_batches, staged, table

K = 5
SCALE = 256
#: Bound of a quantised component: scores of 2,048 components fit a long.
LIMIT = 1 << 26
#: Candidates of one group, all labels together, and anchors of one group.
BLOCK_ROWS, PART_ROWS = 16_384, 65_536
#: First depth of sorted access.
DEPTH = 16
#: Window in percent of the positive's score.
LOW, HIGH = 80, 100


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(
        F.lit(float(SCALE)) * x.cast("double")))).cast("int"))


def usable(rows: DataFrame) -> DataFrame:
    """The rows of ``(vec_id, label, vector)`` that take part as ``(vec_id, label, q)``, repeats once."""
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (rows.where(F.col("label").isNotNull() & F.col("vector").isNotNull() & good)
            .select("vec_id", "label", quantised(F.col("vector")).alias("q")).dropDuplicates())


class Lists:
    """Candidates of one group with a sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        self.ids, self.labels, self.matrix = ids, labels, matrix
        self.order = np.argsort(matrix, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(matrix, self.order.T, axis=0).T

    def search(self, anchor: np.ndarray, own: int, other_than: int | None, low: np.ndarray,
               high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window ``[low, high]`` of scores the best ``k`` candidates of other ids, if asked for of
        other labels too, as (row numbers, scores). ``self.ids`` ascend, so row numbers break ties."""
        n = len(self.ids)
        dims = np.flatnonzero(anchor)
        weights = anchor[dims]
        up = weights > 0
        rises, falls = dims[up], dims[~up]
        fresh = np.ones(n, bool)
        rows, scores = np.empty(0, np.int64), np.empty(0, anchor.dtype)
        floor, done, depth = low.copy(), 0, DEPTH
        while True:
            depth = min(depth, n)
            if len(dims) == 0:  # every score is zero: one access reads all
                depth = n
            near = np.zeros(n, bool)
            near[self.order[rises, n - depth:n - done].ravel()] = True
            near[self.order[falls, done:depth].ravel()] = True
            new = np.flatnonzero(near & fresh if depth < n else fresh)
            fresh[new] = False
            found = self.matrix[new] @ anchor
            # Only rows within some window can be returned.
            keep = (found >= floor.min()) & (found <= high.max()) & (self.ids[new] != own)
            if other_than is not None:
                keep &= self.labels[new] != other_than
            rows, scores = np.concatenate([rows, new[keep]]), np.concatenate([scores, found[keep]])
            best = []
            for w in range(len(low)):
                inside = np.flatnonzero((scores >= low[w]) & (scores <= high[w]))
                if len(inside) > k:  # ties with the k-th stay until ids decide
                    kth = np.partition(scores[inside], len(inside) - k)[len(inside) - k]
                    inside = inside[scores[inside] >= kth]
                inside = inside[np.lexsort((rows[inside], -scores[inside]))][:k]
                floor[w] = scores[inside[-1]] if len(inside) == k else low[w]
                best.append((rows[inside], scores[inside]))
            done, depth = depth, depth * 2
            if done == n:
                return best
            edge = (self.sorted[rises, n - done] * weights[up]).sum() + (self.sorted[falls, done - 1]
                                                                         * weights[~up]).sum()
            if (edge < floor).all():
                return best


def _matrix(q: pd.Series, width: int, dtype: type) -> np.ndarray:
    out = np.zeros((len(q), width), dtype)
    for i, v in enumerate(q):
        out[i, :len(v)] = v
    return out


def _exact(candidates: pd.DataFrame, anchors: pd.DataFrame) -> tuple[int, type]:
    """Common width of the vectors and the type in which all their products are exact."""
    width = max(max(map(len, candidates["q"])), max(map(len, anchors["q"])), 1)
    top = [max((int(np.abs(v).max()) for v in t["q"] if len(v)), default=0) for t in (candidates, anchors)]
    bound = width * top[0] * top[1]
    return width, np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64


#: Stands for a null id among the ids of a group: after all others.
NO_ID = np.iinfo(np.int64).max


def _search_group(candidates: pd.DataFrame, anchors: pd.DataFrame, same: bool, k: int) -> pd.DataFrame:
    out: list[tuple] = []
    if len(candidates) and len(anchors):
        width, dtype = _exact(candidates, anchors)
        ids = candidates["vec_id"].astype("Int64")
        candidates = candidates.assign(id=ids.fillna(NO_ID).astype("int64"), none=ids.isna())
        candidates = candidates.sort_values(["none", "id"], kind="stable")
        labels = candidates["label"].to_numpy()
        matrix = _matrix(candidates["q"], width, dtype)
        ids, none = candidates["id"].to_numpy(), candidates["none"].to_numpy()
        vectors = _matrix(anchors["q"], width, dtype)
        lists = None if same else Lists(ids, labels, matrix)
        for label, of in anchors.groupby("label").indices.items():
            if same:
                mine = labels == label
                lists = Lists(ids[mine], labels[mine], matrix[mine])
            if not len(lists.ids):
                continue
            gone = none[mine] if same else none
            for i in of:
                row = anchors.iloc[i]
                low, high = np.asarray(row["low"], dtype), np.asarray(row["high"], dtype)
                best = lists.search(vectors[i], row["vec_id"], None if same else label, low, high, k)
                for w, (at, scores) in enumerate(best):
                    out += [(row["anchor"], w, None if gone[r] else int(lists.ids[r]), int(x))
                            for r, x in zip(at, scores)]
    return pd.DataFrame(out, columns=["anchor", "window", "vec_id", "score"]).astype({"vec_id": "Int64"})


def search(candidates: DataFrame, anchors: DataFrame, same: bool, n_blocks: int, n_parts: int, k: int
           ) -> DataFrame:
    """``(anchor, window, vec_id, score, rank)``: for each window of each anchor the best ``k`` candidates of
    its label (``same``) or of all others. ``anchors`` are ``(anchor, vec_id, label, q, low, high)``, one pair
    of bounds in ``low`` and ``high`` for each window."""
    part = F.pmod(F.xxhash64("anchor"), F.lit(n_parts)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(n_blocks)).cast("int")
    left = candidates.select("*", block.alias("block"), F.explode(
        F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"))
    right = anchors.select("*", part.alias("part"), F.explode(
        F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"))

    def run(c: pd.DataFrame, a: pd.DataFrame) -> pd.DataFrame:
        return _search_group(c, a, same, k)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(
        run, "anchor long, window int, vec_id long, score long")
    best = Window.partitionBy("anchor", "window").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, k: int = K, low: int = LOW, high: int = HIGH,
                   block_rows: int = BLOCK_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over
    ``rows(vec_id, label, vector)``."""
    small_batches(rows.sparkSession)
    rows = staged(usable(rows), "vectors")
    anchors = staged(rows.where(is_anchor).select(F.monotonically_increasing_id().alias("anchor"), "*"), "anchors")
    n_blocks, n_parts = -(-max(rows.count(), 1) // block_rows), -(-max(anchors.count(), 1) // part_rows)
    end = F.lit((1 << 62)).cast("long")
    everything = anchors.select("*", F.array(-end).alias("low"), F.array(end).alias("high"))
    positives = staged(search(rows, everything, True, n_blocks, n_parts, k), "positives")
    # Equal scores of an anchor's positives are one window; at most k of them.
    windows = positives.groupBy("anchor").agg(F.sort_array(F.collect_set("score")).alias("scores"))
    hundred = F.lit(100).cast("long")
    bounds = anchors.join(windows, "anchor").select(
        "*", F.transform("scores", lambda s: F.ceil(s * F.lit(low).cast("decimal(20)") / hundred).cast("long")
                         ).alias("low"),
        F.transform("scores", lambda s: F.floor(s * F.lit(high).cast("decimal(20)") / hundred).cast("long")
                    ).alias("high")).drop("scores")
    negatives = search(rows, bounds, False, n_blocks, n_parts, k).withColumnRenamed("score", "negative_score")
    chosen = windows.select("anchor", F.posexplode("scores").alias("window", "positive_score"))
    pairs = positives.select("anchor", F.col("vec_id").alias("positive_id"),
                             F.col("score").alias("positive_score")).join(chosen, ["anchor", "positive_score"])
    return (pairs.join(negatives.withColumnRenamed("vec_id", "negative_id"), ["anchor", "window"])
            .join(anchors.select("anchor", F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id",
                    "positive_score", "negative_score"))


OP12_SQL = """
WITH q AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         list_dot_product(a.q, r.q)::BIGINT AS score
  FROM q a JOIN q r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, p.positive_id
                          ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
       n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
 AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY rank <= 5
"""


@register("op12_hard_negatives", OP12_SQL)
def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"),
                                                     F.col("embedding").alias("vector"))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
