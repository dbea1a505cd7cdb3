"""Pairing of targets with inputs, and checks of what was stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pair_train(gt: DataFrame, lr: DataFrame) -> DataFrame:
    """Targets and inputs with the same file name."""
    return gt.select("filename").join(lr.select("filename"), "filename")


def pair_val(gt: DataFrame, val_lr: DataFrame, patch_lr: DataFrame) -> DataFrame:
    """Targets with the input from the validation set, else from the patches; ``origin`` is null where there is none."""
    first = val_lr.select("filename").distinct().withColumn("in_val", F.lit("Val"))
    second = patch_lr.select("filename").distinct().withColumn("in_patches", F.lit("Patches"))
    return gt.select("filename").join(first, "filename", "left").join(second, "filename", "left").select("filename", F.coalesce("in_val", "in_patches").alias("origin"))


def pairing_report(gt: DataFrame, val_lr: DataFrame, patch_lr: DataFrame) -> DataFrame:
    """One row of counts."""
    origin = F.col("origin")
    return pair_val(gt, val_lr, patch_lr).agg(
        F.count("*").alias("found"),
        F.count_if(origin == "Val").alias("from_val"),
        F.count_if(origin == "Patches").alias("from_patches"),
        F.count_if(origin.isNull()).alias("skipped"),
        F.count("origin").alias("loaded"),
    )


def skipped_sample(gt: DataFrame, val_lr: DataFrame, patch_lr: DataFrame, n: int = 15) -> DataFrame:
    """The first ``n`` targets without an input."""
    return pair_val(gt, val_lr, patch_lr).where("origin is null").select("filename").orderBy("filename").limit(n)


def orphan_lr(gt: DataFrame, lr: DataFrame) -> DataFrame:
    """Inputs without a target."""
    return lr.select("filename").join(gt.select("filename"), "filename", "left_anti")


def shape_check(pairs: DataFrame, formats: DataFrame, frames: int = 5) -> DataFrame:
    """Pairs (filename, format, gt_*, lr_* height and width; -1 if unreadable) that are corrupt or of the wrong shape."""
    known = formats.select("format", F.col("gt_h").alias("want_gt_h"), F.col("gt_w").alias("want_gt_w"), F.col("lr_h").alias("want_lr_h"), F.col("lr_w").alias("want_lr_w"))
    rows = pairs.join(F.broadcast(known), "format", "left")
    broken = F.coalesce((F.col("gt_height") <= 0) | (F.col("lr_height") <= 0), F.lit(True))
    gt = (F.col("gt_height") != F.col("want_gt_h")) | (F.col("gt_width") != F.col("want_gt_w"))
    lr = (F.col("lr_height") != F.col("want_lr_h") * frames) | (F.col("lr_width") != F.col("want_lr_w"))
    problem = F.when(broken, "corrupt").when(F.col("want_gt_h").isNull(), "unknown format").when(gt, "gt shape").when(lr, "lr shape")
    return rows.withColumn("problem", problem).where("problem is not null").select("filename", "format", "problem")
