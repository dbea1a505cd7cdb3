"""Sinks and the metric table."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe import schemas


def write_patches(df: DataFrame, base: str) -> None:
    """Patches by category and format; the job commits as a whole, so there are no half-written patches to look for."""
    df.write.mode("overwrite").partitionBy("category", "format").parquet(base)


def write_statistics(df: DataFrame, path: str) -> None:
    """Snapshots as JSON, a folder for each step."""
    df.withColumn("step", F.col("step_current")).write.mode("overwrite").partitionBy("step").json(path)


#: So many parts of a metric table of one level become one of the next.
FANOUT = 8


def metric_parts(path: str) -> list[tuple[int, int, str]]:
    """The parts of the metric table at ``path`` that count, oldest first: the first and last append of each, its folder.

    A part is a committed folder ``<first>-<last>``. One whose appends another part holds as well was merged into that
    one and waits to be removed.
    """
    fs, base = pafs.FileSystem.from_uri(path)
    found = []
    for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)):
        ends = f.base_name.split("-")
        if len(ends) == 2 and all(x.isdigit() for x in ends) and fs.get_file_info(f"{f.path}/_SUCCESS").type == pafs.FileType.File:
            found.append((int(ends[0]), -int(ends[1]), f"{path}/{f.base_name}"))
    parts: list[tuple[int, int, str]] = []
    for first, last, folder in sorted(found):  # of equal firsts the longest comes first
        if not parts or -last > parts[-1][1]:
            parts.append((first, -last, folder))
    return parts


def _write_part(df: DataFrame, path: str, first: int, last: int) -> None:
    rows = df.repartitionByRange("tag", "run_id", "step").sortWithinPartitions("tag", "run_id", "step")
    rows.write.mode("overwrite").option("parquet.block.size", 16 << 20).parquet(f"{path}/{first:010d}-{last:010d}")


def append_metrics(df: DataFrame, path: str, fanout: int = FANOUT) -> None:
    """Append to the metric table at ``path``, sorted by tag, run and step, so that a tag lies in few row groups.

    Whenever ``fanout`` parts of about the same number of appends have come together, they are merged into one: after n
    appends there are fewer than ``fanout`` parts for each of log n levels, and a row was written log n times. A merge
    counts from its commit on, a part that a broken job left does not. There is one writer at a time.
    """
    spark = df.sparkSession
    parts = metric_parts(path)
    n = parts[-1][1] + 1 if parts else 0
    _write_part(df.select("run_id", "tag", "step", "value", "wall_time"), path, n, n)
    while True:
        parts, size = metric_parts(path), 0
        young = []
        for first, last, folder in reversed(parts):  # from the newest: as many of one level as there are
            size = size or last - first + 1
            if last - first + 1 != size:
                break
            young.append((first, last, folder))
        if len(young) < fanout:
            break
        merged = young[:fanout][::-1]
        _write_part(spark.read.schema(schemas.METRICS).parquet(*[p[2] for p in merged]), path, merged[0][0], merged[-1][1])
    fs, base = pafs.FileSystem.from_uri(path)
    keep = {p[2].rsplit("/", 1)[1] for p in metric_parts(path)}
    for f in fs.get_file_info(pafs.FileSelector(base)):
        if f.base_name not in keep and f.type == pafs.FileType.Directory:
            fs.delete_dir(f.path)


def read_metrics(spark: SparkSession, path: str, tags: list[str] | None = None) -> DataFrame:
    """The metric table; other tags' row groups are skipped by their statistics."""
    parts = [p[2] for p in metric_parts(path)]
    rows = spark.read.schema(schemas.METRICS).parquet(*parts) if parts else spark.createDataFrame([], schemas.METRICS)
    return rows.where(F.col("tag").isin(tags)) if tags else rows


def export_log_record(snapshots: DataFrame) -> DataFrame:
    """One nested JSON record for each snapshot; its ``timestamp`` is the snapshot's last update, in UTC."""

    def part(**names: str):
        return F.struct(*[F.col(c).alias(k) for k, c in names.items()])

    utc = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.timestamp_seconds("last_update_time").cast("timestamp_ntz"))
    record = F.struct(
        F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp"),
        F.col("step_current").alias("step"),
        F.col("epoch_num").alias("epoch"),
        part(total="total_loss_value", l1="l1_loss_value", ms="ms_loss_value", gradient="gradient_loss_value", perceptual="perceptual_loss_value").alias("losses"),
        part(l1="l1_weight_current", ms="ms_weight_current", gradient="gradient_weight_current", perceptual="perceptual_weight_current").alias("weights"),
        F.col("learning_rate_value").alias("learning_rate"),
        part(lr="quality_lr_value", ki="quality_ki_value", improvement="quality_improvement_value", best_ever="best_quality_ever").alias("quality"),
        part(mode="adaptive_mode", cooldown="adaptive_is_cooldown", plateau_counter="adaptive_plateau_counter", gradient_clip="gradient_clip_val").alias("adaptive"),
        part(iteration_duration="iteration_duration", vram_usage_gb="vram_usage_gb", adam_momentum="adam_momentum_avg").alias("performance"),
    )
    return snapshots.select("step_current", F.to_json(record).alias("record"))
