"""Checkpoints and configuration: names, history, audits, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import columns, dims
from loomframe.operators.scans import asof

PREVIEW = ("plateau_safety_threshold", "max_lr", "l1_weight_target")


def parsed(files: DataFrame) -> DataFrame:
    """``files`` (filename) with step and type; other files fall away."""
    step = columns.checkpoint_step(F.col("filename"))
    return files.withColumn("step", step).where("step is not null").withColumn("type", columns.checkpoint_type(F.col("filename"), F.col("step")))


def latest_checkpoint(files: DataFrame) -> DataFrame:
    """One row: the file with the highest step, of equals the last by name."""
    return parsed(files).agg(F.max_by(F.struct("filename", "step"), F.struct("step", "filename")).alias("m")).select("m.filename", "m.step")


def preview(config: Column) -> list[Column]:
    return [F.try_element_at(config, F.lit(k)).alias(k) for k in PREVIEW]


def checkpoint_registry(files: DataFrame, metrics: DataFrame, snapshots: DataFrame, last: int | None = None) -> DataFrame:
    """Checkpoints (filename, bytes, timestamp) beside their metrics (step, quality, loss) and configuration (step,
    config), by step; the last few if asked."""
    rows = parsed(files).join(metrics.select("step", "quality", "loss"), "step", "left").join(snapshots.select("step", "config"), "step", "left")
    out = rows.select("filename", "step", "type", F.coalesce("quality", F.lit(0.0)).alias("quality"), F.coalesce("loss", F.lit(0.0)).alias("loss"), (F.col("bytes") / 2**20).alias("size_mb"), "timestamp", F.col("config").isNotNull().alias("has_config_snapshot"), *preview(F.col("config")))
    return out.orderBy("step", "filename") if last is None else out.orderBy(F.desc("step"), F.desc("filename")).limit(last)


def best_check(step: Column) -> Column:
    return F.pmod(step, F.lit(10000)).between(2000, 8000)


def best_history(val: DataFrame) -> DataFrame:
    """Validations (run_id, step, quality) inside the check window that beat every earlier one there, and the best before."""
    before = F.max("quality").over(Window.partitionBy("run_id").orderBy("step").rowsBetween(Window.unboundedPreceding, -1))
    rows = val.where(best_check(F.col("step"))).withColumn("previous_best", F.coalesce(before, F.lit(0.0)))
    return rows.where(F.col("quality") > F.col("previous_best"))


def checkpoint_due(df: DataFrame) -> DataFrame:
    """``df`` (step) with regular, best_check and milestone."""
    s = F.col("step")
    return df.withColumns({"regular": (F.pmod(s, F.lit(10000)) == 0) & (s > 0), "best_check": best_check(s), "milestone": F.pmod(s, F.lit(25000)) == 0})


def cleanup_plan(files: DataFrame, links: DataFrame) -> DataFrame:
    """What a fresh start would do to each file (folder, filename) and to links (filename, target); nothing is done."""
    name = F.col("filename")
    action = F.when(F.col("folder") == "active_run", "reset").when(F.endswith(name, F.lit(".BAK")), "keep").when(F.endswith(name, F.lit(".pth")), "back up and remove").otherwise("remove")
    dangling = links.join(files.where("folder = 'checkpoints'").select(F.col("filename").alias("target")), "target", "left_anti")
    return files.select("folder", "filename", action.alias("action")).unionByName(dangling.select(F.lit("checkpoints").alias("folder"), "filename", F.lit("unlink").alias("action")))


def validate_params(changes: DataFrame, current: dict[str, float], rules: DataFrame) -> DataFrame:
    """``changes`` (change_id, param, value) with ``accepted`` and ``reason``; a weight must also keep the sum near 1."""
    weights = [r[0] for r in dims.PARAM_RULES if r[0].endswith("_weight_target")]
    rows = changes.join(F.broadcast(rules), "param", "left")
    total = sum((F.when(F.col("param") == w, F.col("value")).otherwise(F.lit(float(current.get(w, 0.0)))) for w in weights), F.lit(0.0))
    reason = (
        F.when(F.col("class") == "startup", "startup only")
        .when(F.col("value").isNull(), "no value")
        .when(F.col("class").isNotNull() & ~F.col("value").between(F.col("lo"), F.col("hi")), "out of range")
        .when(F.col("param").isin(weights) & ~total.between(0.95, 1.05), "weights do not sum to 1")
    )
    return rows.select("change_id", "param", "value", reason.alias("reason")).withColumn("accepted", F.col("reason").isNull())


def snapshot_list(snaps: DataFrame) -> DataFrame:
    return snaps.select("run_id", "step", "timestamp", F.format_string("runtime_config_step_%07d.json", "step").alias("file"), *preview(F.col("config")))


def entries(snaps: DataFrame) -> DataFrame:
    return snaps.select("run_id", "step", F.explode("config").alias("param", "value"))


def snapshot_diff(snaps: DataFrame, step1: int, step2: int) -> DataFrame:
    """Parameters whose values differ between two snapshots of a run (missing: null), and how many do."""
    rows = entries(snaps)
    a, b = (rows.where(F.col("step") == s).select("run_id", "param", F.col("value").alias(n)) for s, n in ((step1, "old"), (step2, "new")))
    out = a.join(b, ["run_id", "param"], "full").where(~F.col("old").eqNullSafe(F.col("new")))
    return out.withColumn("changes", F.count("*").over(Window.partitionBy("run_id")))


def effective_config(steps: DataFrame, snaps: DataFrame) -> DataFrame:
    """For each (run_id, step) the configuration in force: the latest snapshot at or before it."""
    right = snaps.select("run_id", "step", F.struct(F.col("step").cast("bigint").alias("config_step"), "config").alias("s"))
    found = asof(steps.select("run_id", "step"), right, ("run_id",), "step", F.col("s"), "l")
    return found.select("run_id", "step", "l.config_step", "l.config")


def config_changes(snaps: DataFrame) -> DataFrame:
    """run_id, step, param, old and new value, wherever a value changed; the first value of a parameter is no change."""
    w = Window.partitionBy("run_id", "param").orderBy("step")
    rows = entries(snaps).withColumns({"old": F.lag("value").over(w), "nth": F.row_number().over(w)})
    return rows.where((F.col("nth") > 1) & ~F.col("old").eqNullSafe(F.col("value"))).select("run_id", "step", "param", "old", F.col("value").alias("new"))


def merge_defaults(df: DataFrame, defaults: dict[str, str] | None = None) -> DataFrame:
    """``df`` (config: map of text) over the defaults."""
    base = F.create_map(*[F.lit(x) for kv in (defaults or dims.DEFAULT_CONFIG).items() for x in kv])
    mine = F.coalesce("config", F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(mine, k))
    return df.withColumn("config", F.map_concat(kept, mine))


def required_fields(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """``df`` with ``missing``, the required fields that its configuration lacks, and ``valid``."""
    need = F.array(*[F.lit(f) for f in fields or dims.REQUIRED_FIELDS])
    out = df.withColumn("missing", F.array_except(need, F.map_keys(F.coalesce("config", F.create_map().cast("map<string,string>")))))
    return out.withColumn("valid", F.size("missing") == 0)


def hparam_table(configs: DataFrame, metrics: DataFrame, params: list[str], tags: list[str]) -> DataFrame:
    """One row for each run: the latest value of each hyperparameter beside the final value of each tag."""
    latest = configs.groupBy("run_id").pivot("param", params).agg(F.max_by("value", "step"))
    final = metrics.groupBy("run_id").pivot("tag", tags).agg(F.max_by("value", "step"))
    return latest.join(final, "run_id", "left")
