"""Questions to the saved statistics (run_id, step, quality_ki, improvement, plateau_counter, boost_available)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def improvement_history(stats: DataFrame) -> DataFrame:
    return stats.select("run_id", "step", (F.col("improvement") * 100).alias("improvement_pct"), (F.col("quality_ki") * 100).alias("quality_pct")).orderBy("run_id", "step")


def best_quality_step(stats: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` steps of each run with the best quality, earlier steps first among equals."""
    if k == 1:
        best = stats.groupBy("run_id").agg(F.max_by(F.struct("step", "quality_ki"), F.struct("quality_ki", -F.col("step"))).alias("b"))
        return best.select("run_id", "b.step", "b.quality_ki")
    place = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("quality_ki"), "step"))
    return stats.withColumn("place", place).where(F.col("place") <= k).select("run_id", "step", "quality_ki")


def plateau_report(stats: DataFrame, long: int = 300) -> DataFrame:
    """Steps on a long plateau, and whether a boost is ready."""
    advice = F.when(F.col("boost_available"), "boost ready").otherwise("cooling down")
    return stats.where(F.col("plateau_counter") > long).select("run_id", "step", "plateau_counter", advice.alias("boost"))


def compare_runs(stats: DataFrame, run1: str, run2: str) -> DataFrame:
    """Improvements of two runs at the same steps, in percent, and the difference."""
    a, b = (stats.where(F.col("run_id") == r).select("step", (F.col("improvement") * 100).alias(n)) for r, n in ((run1, "improvement_1"), (run2, "improvement_2")))
    return a.join(b, "step").withColumn("difference", F.col("improvement_2") - F.col("improvement_1"))


def layers_of(stats: DataFrame) -> list[str]:
    """The names of all layers, in order: the columns that a table of them gets."""
    return sorted(r.layer for r in stats.select(F.explode(F.map_keys("layer_activity_map")).alias("layer")).distinct().collect())


def flattened(stats: DataFrame, layers: list[str] | None = None) -> DataFrame:
    """``stats`` with the map of layer activities as columns, those named or all that are found."""
    layers = layers_of(stats) if layers is None else layers
    return stats.select(*[c for c in stats.columns if c != "layer_activity_map"], *[F.try_element_at("layer_activity_map", F.lit(k)).alias(k) for k in layers])


def export_history_csv(stats: DataFrame, path: str, layers: list[str] | None = None) -> None:
    flattened(stats, layers).write.mode("overwrite").option("header", True).csv(path)
