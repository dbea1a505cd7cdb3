"""Accounts of a generation run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def category_counts(patches: DataFrame, targets: DataFrame) -> DataFrame:
    """Images and videos by category, beside the target; a category on one side alone has zeros on the other."""
    made = patches.groupBy("category").agg(F.count("*").alias("images"), F.count_distinct("video_id").alias("videos"))
    return made.join(targets, "category", "full").select("category", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("images", "videos", "target")])


def category_progress(counts: DataFrame, elapsed: float) -> DataFrame:
    """Percent of the target, images a second, seconds left, and a status."""
    rate = F.col("images") / F.lit(float(elapsed)) if elapsed > 0 else F.lit(0.0)
    percent = F.when(F.col("target") > 0, F.col("images") / F.col("target") * 100).otherwise(0.0)
    left = F.col("target") - F.col("images")
    out = counts.withColumns({"percent": percent, "rate": rate})
    out = out.withColumn("eta", F.when(left <= 0, 0.0).when(F.col("rate") > 0, left / F.col("rate")))
    return out.withColumn("status", F.when(left <= 0, "Complete").when(F.col("rate") > 0, "Running").otherwise("Calculating"))


def overall_progress(videos: DataFrame, elapsed: float) -> DataFrame:
    """One row over videos (completed, extractions, attempts): shares, average time, time left, rates."""
    t = videos.agg(F.count("*").alias("total"), F.count_if("completed").alias("completed"), F.coalesce(F.sum("extractions"), F.lit(0)).alias("extractions"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    t = t.withColumns({"percent": ratio(F.col("completed") * 100.0, F.col("total")), "seconds_a_video": ratio(F.lit(float(elapsed)), F.col("completed"))})
    return t.withColumns({
        "eta": F.col("seconds_a_video") * (F.col("total") - F.col("completed")),
        "extraction_rate": F.col("extractions") / F.lit(float(elapsed)) if elapsed > 0 else F.lit(0.0),
        "success_rate": ratio(F.col("extractions") * 100.0, F.col("attempts")),
    })


def storage_by_category(files: DataFrame) -> DataFrame:
    """GiB by category, rounded to two places, and in all (category null)."""
    return files.rollup("category").agg(F.sum("bytes").alias("b"), F.grouping("category").alias("is_total")).select("category", "is_total", F.round(F.col("b") / 2**30, 2).alias("gib"))


def progress_rollup(patches: DataFrame, targets: DataFrame) -> DataFrame:
    """Videos, images, target (category, target), percent of it and bytes by category, with a TOTAL row (videos: null)."""
    done = patches.groupBy("category").agg(F.count_distinct("video_id").alias("videos"), F.count("*").alias("images"), F.sum("bytes").alias("bytes"))
    both = done.join(targets, "category", "full")
    of = lambda c: F.coalesce(c, F.lit(0))
    rows = both.rollup("category").agg(F.max("videos").alias("v"), *[F.sum(of(c)).alias(c) for c in ("images", "target", "bytes")], F.grouping("category").alias("g"))
    percent = F.when(F.col("target") > 0, F.col("images") / F.col("target") * 100).otherwise(0.0)
    total = F.col("g") == 1
    return rows.select(F.when(total, "TOTAL").otherwise(F.col("category")).alias("category"), F.when(~total, of("v")).alias("videos"), "images", "target", percent.alias("percent"), "bytes")


def checkpoint_status(entry):
    """Status of an entry that is a plain word or a JSON object with ``status``."""
    return F.coalesce(F.when(F.trim(entry).startswith("{"), F.get_json_object(entry, "$.status")), F.trim(F.translate(entry, '"', "")))


def checkpoint_status_counts(df: DataFrame) -> DataFrame:
    """One row over entries (video, entry): all, completed, in progress."""
    s = df.select(checkpoint_status(F.col("entry")).alias("s"))
    return s.agg(F.count("*").alias("entries"), F.count_if(F.col("s") == "completed").alias("completed"), F.count_if(F.col("s") == "in_progress").alias("in_progress"))


def resume_point(status: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Where each run resumes: its current video, and the last frame if that video was in progress, else 0."""
    going = checkpoints.where("status = 'in_progress'").select("run_id", F.col("video_index").alias("current_video_index"), "last_frame_idx")
    return status.select("run_id", "current_video_index").join(going, ["run_id", "current_video_index"], "left").withColumn("last_frame_idx", F.coalesce("last_frame_idx", F.lit(0)))
