"""Score library (S7-S11, J7) and note-level library operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANONYMOUS = "익명"  # fixed value: the shared default nickname


def _latest(rows: DataFrame, rank: Column) -> DataFrame:
    """One row per id by an aggregate (combined map-side), not by a sort of each id's rows."""
    cols = [c for c in rows.columns if c != "id"]
    return rows.groupBy("id").agg(F.max_by(F.struct(*cols), rank).alias("r")).select("id", "r.*")


def upsert_scores(library: DataFrame, new: DataFrame) -> DataFrame:
    """``(id, ..., list_pos, updated_at)``; a known id is replaced where it stands, an unknown
    one goes to the front (before every stored position, latest first)."""
    cols = [c for c in new.columns if c not in ("id", "updated_at")]
    latest = _latest(new, F.struct("updated_at", F.xxhash64(*cols)))  # equal times: always the same one
    front = latest.join(library.select("id"), "id", "left_anti").withColumn(
        "list_pos", -F.col("updated_at"))
    old = library.alias("o").join(latest.alias("n"), "id", "left")
    cols = [c for c in library.columns if c not in ("id", "list_pos")]
    hit = F.col("n.updated_at").isNotNull()
    kept = old.select("id", *[F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
                              for c in cols], F.col("o.list_pos").alias("list_pos"))
    return kept.unionByName(front.select(*kept.columns))


def merge_saves(library: DataFrame, new: DataFrame) -> DataFrame:
    """S8 for saves that come in batches: the same library whatever the batches and their order. The latest
    save of an id counts; an unknown id goes to the front at its first save and keeps that place."""
    cols = [c for c in new.columns if c not in ("id", "list_pos")]
    saves = new.select("id", *cols, F.lit(None).cast("long").alias("stored"),
                       (-F.col("updated_at")).alias("at"), F.lit(True).alias("new"))
    # Stored places are not negative; a place in front is minus the time of the first save.
    stored = library.select("id", *cols, F.when(F.col("list_pos") >= 0, F.col("list_pos")).alias("stored"),
                            F.when(F.col("list_pos") < 0, F.col("list_pos")).alias("at"), F.lit(False).alias("new"))
    best = F.max_by(F.struct(*cols), F.struct("updated_at", "new", F.xxhash64(*cols)))
    return stored.unionByName(saves).groupBy("id").agg(
        best.alias("r"), F.coalesce(F.max("stored"), F.max("at")).alias("list_pos")).select(
        "id", *[f"r.{c}" for c in cols], "list_pos")


def delete_score(library: DataFrame, ids: DataFrame) -> DataFrame:
    """S9."""
    return library.join(ids.select("id"), "id", "left_anti")


def get_by_id(library: DataFrame, key) -> DataFrame:
    """S9 / K6."""
    return library.filter(F.col("id") == key)


def list_scores(library: DataFrame, user) -> DataFrame:
    """One user's scores, newest first; a missing creation time counts 0."""
    return (library.filter(F.col("user_id") == user)
            .orderBy(F.coalesce("created_at", F.lit(0)).desc(), "id"))


def sync_library(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """Every cloud score is upserted, so the cloud wins by id."""
    return upsert_scores(local, cloud)


def nickname_taken(requests: DataFrame, leaderboard: DataFrame) -> DataFrame:
    """Adds ``taken``; checked per song only, and the anonymous name is always free.

    The anonymous entries are removed before the exchange and the rest reduced to distinct pairs
    map-side, so neither a hot song nor a hot name concentrates rows.
    """
    used = (leaderboard.filter(F.col("nickname") != ANONYMOUS).select("song", "nickname")
            .distinct().withColumn("taken", F.lit(True)))
    named = requests.filter(F.col("nickname") != ANONYMOUS).join(used, ["song", "nickname"], "left")
    free = requests.filter(F.col("nickname") == ANONYMOUS).withColumn("taken", F.lit(False))
    return named.withColumn("taken", F.coalesce("taken", F.lit(False))).unionByName(
        free.select(*named.columns))


def append_leaderboard(entries: DataFrame, path: str) -> None:
    """Insert only; nothing is updated or deleted."""
    entries.write.mode("append").parquet(path)


def append_scores(notes: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs(target_id, extra_id)``, one extra per target; the extra score's notes follow
    the target's, staff by staff. The lower staff grows only when both scores have one.

    Every note meets its roles in one join; a window over the target's staff supplies the shift.
    """
    own = pairs.select(F.col("target_id").alias("score_id"), "target_id", F.lit(False).alias("extra"))
    other = pairs.select(F.col("extra_id").alias("score_id"), "target_id", F.lit(True).alias("extra"))
    cols = [c for c in notes.columns if c not in ("score_id", "note_idx")]
    rows = notes.join(own.unionByName(other), "score_id")
    n = F.sum(F.when(F.col("extra"), 0).otherwise(1)).over(Window.partitionBy("target_id", "staff"))
    rows = rows.withColumn("_n", n).filter(
        ~F.col("extra") | (F.col("staff") == "treble") | (F.col("_n") > 0))
    idx = F.col("note_idx") + F.when(F.col("extra"), F.col("_n")).otherwise(0)
    return rows.select(F.col("target_id").alias("score_id"), idx.cast("int").alias("note_idx"), *cols)


def score_summary(notes: DataFrame, tempo: int = 100) -> DataFrame:
    """Note count over all staves, staff count, tempo."""
    return notes.groupBy("score_id").agg(
        F.count("*").alias("n_notes"),
        (1 + F.max(F.when(F.col("staff") == "bass", 1).otherwise(0))).alias("n_staves"),
        F.lit(tempo).alias("tempo"))


def library_preview(notes: DataFrame, n: int = 14) -> DataFrame:
    """Beat and bar width (10 px per quarter) of the first notes of the upper staff."""
    return notes.filter((F.col("staff") == "treble") & (F.col("note_idx") < n)).select(
        "score_id", "note_idx", "beat", (F.col("ticks") * 10 / 24.0).alias("width"))
