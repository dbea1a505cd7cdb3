"""Sources of JSON documents, logs, media listings and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import schemas
from loomframe.sources import media

#: Fixed values. Suffixes of video files; case counts.
MEDIA = ("mkv", "mp4", "avi", "mov")


def scan_media(spark: SparkSession, root: str, in_tasks: bool = False) -> DataFrame:
    """One row for each video file below ``root``: path, name, folder, length, modificationTime. Contents are not read. With
    ``in_tasks`` no listing lies in the driver, and empty files, which Spark's source passes over, are listed too."""
    path = F.col("path")
    if in_tasks:
        files = media.listed(spark, root).where(path.rlike(rf"\.({'|'.join(MEDIA)})$")).withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), path))
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{','.join(MEDIA)}}}").load(root)
    return files.select("path", F.regexp_extract(path, r"([^/]+)$", 1).alias("name"), F.regexp_replace(path, r"/[^/]+$", "").alias("folder"), "length", "modificationTime")


def number_or(field: str):
    """A value that is a number or an object with the number under ``field``."""
    return lambda c: F.coalesce(F.get_json_object(c, f"$.{field}"), c).try_cast("double")


def read_generator_config(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """A generator configuration as tables: settings, videos, formats, targets, paths."""
    doc = spark.read.schema(schemas.CONFIG).option("multiLine", multiline).json(path)
    formats = doc.select(F.explode("format_config").alias("category", "f")).select("category", F.explode("f").alias("format", "w"))
    targets = doc.select(F.explode("category_targets").alias("category", "t"))
    return {
        "settings": doc.select("base_settings.*"),
        "videos": doc.select(F.explode("videos").alias("v")).select("v.*"),
        "formats": formats.select("category", "format", number_or("probability")(F.col("w")).alias("weight")),
        "targets": targets.select("category", number_or("target")(F.col("t")).cast("bigint").alias("target")),
        "paths": doc.select(F.explode("category_paths").alias("category", "path")),
    }


def read_status(spark: SparkSession, path: str, multiline: bool = True) -> dict[str, DataFrame]:
    """Generator status documents as tables: progress, category_stats, video_checkpoints; broken documents give no rows."""
    doc = spark.read.schema(schemas.STATUS).option("multiLine", multiline).option("mode", "DROPMALFORMED").json(path).where("progress is not null or status is not null")
    return {
        "progress": doc.select("status", "last_update", "progress.*"),
        "category_stats": doc.select("last_update", F.explode("category_stats").alias("category", "s")).select("last_update", "category", "s.*"),
        "video_checkpoints": doc.select(F.explode("video_checkpoints").alias("video", "entry")),
    }


def stream_status_documents(spark: SparkSession, path: str, files_per_batch: int, multiline: bool = True) -> DataFrame:
    """Status documents as they arrive, a row for each category: category, status, last_update and its counts. A broken
    document ends up in the corrupt-record column and gives no row."""
    schema = f"{schemas.STATUS}, _corrupt_record string"
    docs = spark.readStream.schema(schema).option("multiLine", multiline).option("columnNameOfCorruptRecord", "_corrupt_record").option("maxFilesPerTrigger", files_per_batch).json(path)
    whole = docs.where("_corrupt_record is null")
    return whole.select(F.explode("category_stats").alias("category", "s"), "status", "last_update").select("category", "status", "last_update", "s.*")


def file_step() -> list:
    """Step and run name from a statistics path: ``Statistik_<step>[_name].json``, or a folder ``step=<step>``."""
    path = F.col("_metadata.file_path")
    step = F.coalesce(F.nullif(F.regexp_extract(path, r"Statistik_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(path, r"step=(\d+)", 1), F.lit("")))
    return [step.cast("bigint").alias("file_step"), F.nullif(F.regexp_extract(path, r"Statistik_\d+_(.+)\.json$", 1), F.lit("")).alias("run_name")]


def read_statistics(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Every snapshot of a folder, with the step and name that its file name gives."""
    docs = spark.read.schema(schemas.STATISTICS).option("multiLine", multiline).option("mode", "DROPMALFORMED").option("recursiveFileLookup", True).json(path)
    return docs.select("*", *file_step()).where("step_current is not null or file_step is not null")


def read_config_snapshots(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """Every configuration snapshot of a folder; broken files are left out."""
    docs = spark.read.schema(schemas.SNAPSHOT).option("multiLine", multiline).option("mode", "DROPMALFORMED").option("ignoreCorruptFiles", True).json(path)
    return docs.where("step is not null and config is not null")


#: Fixed values. Kinds of log lines, each by the first pattern that it holds.
LOG_KINDS = [
    ("crash", r"(?i)training crashed"),
    ("start", r"(?i)training started|starting training"),
    ("completion", r"(?i)training complete"),
    ("interrupt", r"(?i)interrupted"),
    ("emergency", r"(?i)emergency"),
    ("crash", r"(?i)crash|error"),
    ("best", r"(?i)new best"),
    ("validation", r"(?i)validation"),
    ("checkpoint", r"(?i)checkpoint"),
    ("lr_boost", r"(?i)lr boost"),
    ("pause", r"(?i)paus|resum"),
]


def log_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (value: ``[time] message``) as ts, message, kind, step, quality; other lines keep a null ts."""
    value = F.col("value")
    ts, message = F.regexp_extract(value, r"^\[([^\]]+)\] (.*)$", 1), F.regexp_extract(value, r"^\[[^\]]+\] (.*)$", 1)
    kind = None
    for name, pattern in LOG_KINDS:
        kind = F.when(F.col("message").rlike(pattern), name) if kind is None else kind.when(F.col("message").rlike(pattern), name)
    number = lambda pattern: F.nullif(F.regexp_extract("message", pattern, 1), F.lit(""))
    rows = lines.select(F.try_to_timestamp(F.nullif(ts, F.lit("")), F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), F.when(ts == "", value).otherwise(message).alias("message"))
    return rows.select("ts", "message", kind.otherwise("other").alias("kind"), number(r"(?i)step[ _:=]*(\d+)").cast("bigint").alias("step"), number(r"(?i)quality[ :=]*([0-9.]+)").try_cast("double").alias("quality"))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return log_lines(spark.read.text(path))


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False, png_only: bool = False) -> DataFrame:
    """Decoded images (BGR) below a folder; unreadable files have height -1, or are left out. Spark's image source keeps the
    status of every file in the driver, about 0.8 KB each; with ``png_only`` files are listed and decoded in tasks."""
    if png_only:
        return media.png_images(spark, path, drop_invalid)
    return spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", drop_invalid).load(path).select("image.*")
