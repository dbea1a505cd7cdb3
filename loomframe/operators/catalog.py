"""Catalogue of videos: titles, categories, order, availability, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import columns, dims
from loomframe.functions.draws import u
from loomframe.functions.ranks import numbered


def categorize(df: DataFrame, name: str, folder: str, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``categories``, a map of weights."""
    return df.withColumn("categories", columns.categories(F.col(name), F.col(folder), keywords))


def processing_order(df: DataFrame, seed: int, key: str = "video_id") -> DataFrame:
    """``df`` with ``priority`` (255 if null) and ``position``: by priority, ties in seeded random order. Ranks are counted
    inside ranges of the order and offset by the rows before them, so no task sorts a whole level."""
    drawn = df.withColumn("priority", F.coalesce("priority", F.lit(255))).withColumn("draw", u(seed, F.col(key)))
    ranked = numbered(drawn, "priority", "draw", key)
    return ranked.withColumn("position", F.col("ordinal") + 1).drop("draw", "ordinal")


def priority_histogram(df: DataFrame, top: int = 10) -> DataFrame:
    """Videos by priority: the default level and the first levels, ``top`` in all, and the others in one row (null)."""
    counts = df.groupBy(F.coalesce("priority", F.lit(255)).alias("priority")).agg(F.count("*").alias("videos"))
    default = F.col("priority") == 255
    place = F.row_number().over(Window.orderBy(default.desc(), "priority"))  # one row for each level
    shown = counts.withColumn("shown", place <= top)
    return shown.groupBy(F.when(F.col("shown"), F.col("priority")).alias("priority")).agg(F.sum("videos").alias("videos"))


def category_distribution(df: DataFrame) -> DataFrame:
    """Videos by category; a video counts in each of its categories."""
    return df.select(F.explode(F.map_keys("categories")).alias("category")).groupBy("category").agg(F.count("*").alias("videos"))


def availability(videos: DataFrame, listing: DataFrame) -> DataFrame:
    """One row: paths in all, found and missing, and the status."""
    there = listing.select("path").distinct().withColumn("there", F.lit(True))
    counts = videos.join(there, "path", "left").agg(F.count("*").alias("total"), F.count_if(F.col("there")).alias("found")).withColumn("missing", F.col("total") - F.col("found"))
    status = F.when(F.col("found") == 0, "none").when(F.col("missing") > F.col("total") * 0.5, "majority_missing").when(F.col("missing") > 0, "partial").otherwise("complete")
    return counts.withColumn("status", status)


def missing_videos(videos: DataFrame, listing: DataFrame) -> DataFrame:
    return videos.join(listing.select("path"), "path", "left_anti")


def resolve_category_path(df: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """``df`` (category) with ``base_path``: configured, built in, or made from the name."""
    spark = df.sparkSession
    mine = dims.category_paths(spark, overrides or {}).withColumnRenamed("path", "configured")
    known = dims.category_paths(spark).withColumnRenamed("path", "built_in")
    title = columns.capitalize(F.col("category"))
    made = F.concat(title, F.lit("/"), title, F.lit("Model/Learn"))
    return df.join(F.broadcast(mine), "category", "left").join(F.broadcast(known), "category", "left").withColumn("base_path", F.coalesce("configured", "built_in", made)).drop("configured", "built_in")


def output_layout(categories: DataFrame, base: str, overrides: dict[str, str] | None = None) -> DataFrame:
    """Every directory: categories x formats x (5, 7) frames x (gt, lr, val_gt, val_lr), each once."""
    spark = categories.sparkSession
    paths = resolve_category_path(categories.select("category").distinct(), overrides)
    kinds = F.array(*[F.struct(F.lit(n).alias("frames"), F.lit(k).alias("kind")) for n in (5, 7) for k in ("gt", "lr", "val_gt", "val_lr")])
    rows = paths.crossJoin(F.broadcast(dims.formats(spark).select("format", "output_dir"))).select("*", F.explode(kinds).alias("k"))
    folder = F.when(F.col("k.kind").startswith("val"), "Val").otherwise(F.col("output_dir"))
    leaf = F.when(F.col("k.kind").endswith("gt"), "GT").when((F.col("k.frames") == 7) & (F.col("k.kind") == "lr"), "LR_7frames").otherwise("LR")
    return rows.select("category", F.concat_ws("/", F.lit(base), "base_path", folder, leaf).alias("directory")).distinct()


def probe_defaults(df: DataFrame) -> DataFrame:
    """``df`` (avg_frame_rate text, duration text) with ``fps`` and ``seconds``; if either fails, both take defaults."""
    fps, seconds = columns.frame_rate(F.col("avg_frame_rate")), F.col("duration").try_cast("double")
    ok = fps.isNotNull() & seconds.isNotNull()
    return df.withColumns({"fps": F.when(ok, fps).otherwise(F.lit(23.976)), "seconds": F.when(ok, seconds).otherwise(F.lit(3600.0))})
