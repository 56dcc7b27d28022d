"""Label files, image manifests, tables of transition shares and training logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


LABEL_SCHEMA = "id string, tokens array<string>, system_breaks array<int>, _corrupt_record string"
LOG_SCHEMA = "epoch int, phase int, train_loss double, val_ter double, val_acc double, lr double"
# File endings of the media types image/*.
ANY_IMAGE_PATTERN = (r"(?i)\.(apng|avif|bmp|gif|heic|heif|ico|jfif|jpeg|jpg|jxl|pjp|pjpeg|png|svg|svgz|tif|tiff|"
                     r"webp)$")
IMAGE_PATTERN = r"(?i)\.(png|jpg|jpeg)$"
MAX_UPLOAD = 10 * 1024 * 1024  # fixed value: ten mebibytes


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_labels(spark: SparkSession, path: str, one_per_file: bool = False, stream: bool = False) -> DataFrame:
    """``(score_id, tokens, system_breaks, skipped)``. ``one_per_file`` reads whole JSON files
    named after the score; otherwise every line is a label carrying its id. Unreadable or empty
    labels stay as rows with a ``skipped`` reason."""
    raw = ((spark.readStream if stream else spark.read).schema(LABEL_SCHEMA).option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .option("multiLine", one_per_file).json(path))
    key = file_stem(F.col("_metadata.file_path")) if one_per_file else F.col("id")
    kept = F.filter("tokens", lambda t: ~t.isin("<SOS>", "<EOS>", "<PAD>"))
    reason = (F.when(F.col("_corrupt_record").isNotNull(), "unreadable")
              .when(F.coalesce(F.size(kept), F.lit(0)) <= 0, "empty"))
    return raw.select(key.alias("score_id"), kept.alias("tokens"), "system_breaks",
                      reason.alias("skipped"))


def usable_labels(labels: DataFrame) -> DataFrame:
    return labels.filter("skipped IS NULL").drop("skipped")


def skip_report(labels: DataFrame) -> DataFrame:
    """How many labels were read and skipped, by reason."""
    return labels.groupBy(F.coalesce("skipped", F.lit("read")).alias("outcome")).agg(
        F.count("*").alias("n"))


def counted(rows: DataFrame, metrics: Observation | str, outcome: Column, *outcomes: str) -> DataFrame:
    """The rows, counted as they pass: ``rows`` and one metric for each of ``outcomes``. An ``Observation`` has
    them after the first action; a stream, which takes a name, reports them with every batch."""
    return rows.observe(metrics, F.count(F.lit(1)).alias("rows"), *[
        F.count_if(outcome == o).alias(o) for o in outcomes])


def counted_labels(labels: DataFrame, metrics: Observation | str) -> DataFrame:
    """Counts of usable, unreadable and empty labels as metrics of the read itself."""
    return counted(labels, metrics, F.coalesce("skipped", F.lit("read")), "read", "unreadable", "empty")


def counted_pairs(pairs: DataFrame, metrics: Observation | str) -> DataFrame:
    """S3: counts of pairs and orphans of both sides as metrics of the manifest itself."""
    return counted(pairs, metrics, F.col("status"), "pair", "image_only", "label_only")


def write_labels(tokens: DataFrame, path: str, breaks: DataFrame | None = None) -> None:
    """One JSON object per score, in as many files as there are partitions."""
    rows = tokens.groupBy(F.col("score_id").cast("string").alias("id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
        .alias("tokens"))
    if breaks is not None:
        rows = rows.join(breaks.select(F.col("score_id").cast("string").alias("id"),
                                       "system_breaks"), "id", "left")
    rows.write.mode("errorifexists").json(path)


def store_labels(labels: DataFrame, name: str, path: str, buckets: int) -> DataFrame:
    """S2 as a table: ``(score_id, tokens, ...)`` bucketed and sorted by ``score_id``. Whatever is computed per
    score from such a table needs no exchange, and tables with the same number of buckets meet without one."""
    labels.repartition(buckets, "score_id").write.bucketBy(buckets, "score_id").sortBy("score_id").option(
        "path", path).saveAsTable(name)
    return labels.sparkSession.table(name)


def stored_tokens(labels: DataFrame) -> DataFrame:
    """``(score_id, pos, token)`` of a stored table; it stays bucketed."""
    return labels.select("score_id", F.posexplode("tokens").alias("pos", "token"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """File paths and lengths; the content column is never read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length"))


def pair_manifest(images: DataFrame, labels: DataFrame) -> DataFrame:
    """``images(path)`` against ``labels(path)`` by stem, with orphans of both sides."""
    img = images.filter(F.col("path").rlike(IMAGE_PATTERN)).select(
        file_stem(F.col("path")).alias("stem"), F.col("path").alias("image"))
    lab = labels.filter(F.col("path").endswith(".json") & ~F.col("path").endswith("_staffs.json")
                        ).select(file_stem(F.col("path")).alias("stem"), F.col("path").alias("label"))
    status = (F.when(F.col("label").isNull(), "image_only")
              .when(F.col("image").isNull(), "label_only").otherwise("pair"))
    return img.join(lab, "stem", "full_outer").withColumn("status", status)


def valid_uploads(files: DataFrame) -> DataFrame:
    """Images of any type, of at most ten mebibytes; the type comes from the file name."""
    return files.filter(F.col("path").rlike(ANY_IMAGE_PATTERN) & (F.col("length") <= MAX_UPLOAD))


def write_markov(table: DataFrame, path: str, max_interval: int = 14) -> None:
    """``(interval, prob)`` as one JSON object; the table has at most 29 rows."""
    entry = F.struct(F.col("interval").cast("string").alias("key"), F.col("prob").alias("value"))
    table.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("table")).select(
        "table", F.lit(max_interval).alias("max_interval")).write.json(path)


def read_markov(spark: SparkSession, path: str) -> DataFrame:
    """``(interval, prob, max_interval)``; a missing ``max_interval`` is 14."""
    raw = spark.read.schema("table map<string,double>, max_interval int").json(path)
    return raw.select(F.explode("table").alias("k", "prob"),
                      F.coalesce("max_interval", F.lit(14)).alias("max_interval")).select(
        F.col("k").cast("int").alias("interval"), "prob", "max_interval")


def append_training_log(rows: DataFrame, path: str) -> None:
    """Every file carries the header, so appends need no look at earlier files."""
    rows.select("epoch", "phase", "train_loss", "val_ter", "val_acc", "lr").write.mode(
        "append").option("header", True).csv(path)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """S6."""
    return spark.read.schema(LOG_SCHEMA).option("header", True).csv(path)


