"""Training telemetry over (run_id, tag, step, value): smoothing, trends, plateaus, activity, scores, audits.

Windows run inside one run and tag. Exponential means, means and slopes of the last rows, and merges by step are scans by
ranges or chunks of a series; truly sequential rules (plateau counters) are folds over one series in step order, streamed in
batches with a carried state.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import columns
from loomframe.operators.folds import Plateau, RateControl, SlidingQuantile
from loomframe.operators.scans import asof, ddl, exponential_mean, in_step_order, last_rows, mean_of, plain_terms, slope_of

SERIES = ("run_id", "tag")


def series(*more: str) -> Window:
    return Window.partitionBy(*SERIES, *more).orderBy("step")


def by_run() -> Window:
    return Window.partitionBy("run_id").orderBy("step")


def ema(df: DataFrame, alpha: float = 0.1, start: str = "first") -> DataFrame:
    """``df`` with ``ema``; it starts from the first value, or with ``start='zero'`` from 0. A series of any length is
    scanned by ranges of its steps."""
    return exponential_mean(df.select(*SERIES, "step", "value"), SERIES, alpha, 0.0 if start == "zero" else None)


def rolling_mean(df: DataFrame, n: int) -> DataFrame:
    """``df`` with ``rolling_mean`` of the last ``n`` values, fewer at the start; nulls are passed over."""
    k = "p" + uuid.uuid4().hex
    rows = last_rows(df, SERIES, "step", n, lambda row, _: plain_terms(row["value"].cast("double")), k)
    return rows.withColumn("rolling_mean", mean_of(F.col(k))).drop(k)


def trend_pct(activity: DataFrame, keys: tuple[str, ...] = ("run_id", "layer_pos")) -> DataFrame:
    """``activity`` with ``trend``: percent change from the ten values before to the last ten; 0 until there are 20."""
    k = "p" + uuid.uuid4().hex
    rows = last_rows(activity, keys, "step", 10, lambda row, _: plain_terms(row["value"].cast("double")), k, earlier=True)
    now, old = mean_of(F.col(k)), mean_of(F.col(k)["ago"])
    return rows.withColumn("trend", F.when(F.col(k)["place"] >= 19, (now - old) / (old + 1e-8) * 100).otherwise(0.0)).drop(k)


def convergence(df: DataFrame, n: int = 100, dead: float = 5e-5) -> DataFrame:
    """``df`` with ``slope``, the least-squares slope of the last ``n`` values by their order, null before there are as
    many, and ``status``."""
    k = "p" + uuid.uuid4().hex

    def terms(row: Column, place: Column) -> dict[str, Column]:
        found = plain_terms(row["value"].cast("double"))
        return found | {"x": found["n"] * place, "xx": found["n"] * place * place, "xy": found["y"] * place}

    rows = last_rows(df, SERIES, "step", n, terms, k)
    out = rows.withColumn("slope", F.when(F.col(k)["place"] >= n - 1, slope_of(F.col(k), n))).drop(k)
    s = F.col("slope")
    return out.withColumn("status", F.when(s.isNull(), "warming up").when(s < -dead, "converging").when(F.abs(s) < dead, "plateauing").otherwise("diverging"))


def plateau_tracker(df: DataFrame, patience: int = 250, safety: int = 800) -> DataFrame:
    """Per run over (run_id, step, loss, quality): bests, exponential means, counter, is_plateau, steps_until_reset."""
    names = ["best_loss", "best_quality", "ema_loss", "ema_quality", "counter"]

    def fold(pdf: pd.DataFrame, state: Plateau | None) -> tuple[pd.DataFrame, Plateau]:
        state, out = state or Plateau(), []
        for loss, quality in zip(pdf["loss"], pdf["quality"], strict=True):
            state.see(loss, quality)
            out.append(state.state())
        return pd.concat([pdf, pd.DataFrame(out, columns=names)], axis=1), state

    rows = df.select("run_id", "step", "loss", F.col("quality").cast("double").alias("quality"))
    folded = in_step_order(rows, ("run_id",), ddl(rows, *(f"{n} double" for n in names)), fold)
    return folded.withColumns({"is_plateau": F.col("counter") >= patience, "steps_until_reset": F.greatest(F.lit(0), F.lit(safety) - F.col("counter").cast("int"))})


def plateau_divergence_events(df: DataFrame, lr0: float) -> DataFrame:
    """Per series the events: step, event, old_rate, new_rate."""

    def fold(pdf: pd.DataFrame, state: RateControl | None) -> tuple[pd.DataFrame, RateControl]:
        state, out = state or RateControl(lr0), []
        for run, tag, step, value in pdf[[*SERIES, "step", "value"]].itertuples(index=False):
            event = state.see(value)
            if event:
                out.append((run, tag, step, *event))
        return pd.DataFrame(out, columns=[*SERIES, "step", "event", "old_rate", "new_rate"]), state

    rows = df.select(*SERIES, "step", "value")
    return in_step_order(rows, SERIES, ddl(rows.drop("value"), "event string", "old_rate double", "new_rate double"), fold)


def adaptive_clip(df: DataFrame, start: float = 1.5, n: int = 500, warm: int = 100) -> DataFrame:
    """``df`` with ``p95`` of the last ``n`` values (from ``warm`` values on) and ``clip``, its running mean."""
    rows = df.select(*SERIES, "step", "value")

    def fold(pdf: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last, clip = state or (SlidingQuantile(0.95, n), start)
        p95, clips = [], []
        for value in pdf["value"]:
            last.add(None if value is None or math.isnan(value) else value)
            p = last.value() if last.next >= warm else None
            clip = clip if p is None else 0.9 * clip + 0.1 * p
            p95.append(p)
            clips.append(clip)
        return pdf.assign(p95=pd.Series(p95, dtype=float), clip=clips), (last, clip)

    return in_step_order(rows, SERIES, ddl(rows, "p95 double", "clip double"), fold)


def peak_layer(activity: DataFrame) -> DataFrame:
    """For each (run_id, step) the layer with most activity, the first of equals, and its severity."""
    peak = F.max_by(F.struct("layer_pos", "value"), F.struct("value", -F.col("layer_pos")))
    return activity.groupBy("run_id", "step").agg(peak.alias("p")).select("run_id", "step", "p.layer_pos", F.col("p.value").alias("peak")).withColumn("severity", columns.peak_severity(F.col("peak")))


def relative_activity(activity: DataFrame, n_layers: int) -> DataFrame:
    """``activity`` with ``percent`` of the step's maximum, its trunk and its band."""
    most = F.max("value").over(Window.partitionBy("run_id", "step"))
    percent = F.when(most > 0, (F.col("value") / most * 100).cast("int")).otherwise(0)
    return activity.withColumns({"percent": percent, "trunk": trunk(n_layers), "band": columns.peak_severity(F.col("value"))})


def trunk(n_layers: int) -> Column:
    """The last position is the fusion; the first half of the others is the backward trunk."""
    return F.when(F.col("layer_pos") >= n_layers - 1, "fusion").when(F.col("layer_pos") < (n_layers - 1) // 2, "backward").otherwise("forward")


def trunk_average(activity: DataFrame, n_layers: int) -> DataFrame:
    return activity.groupBy("run_id", "step", trunk(n_layers).alias("trunk")).agg(F.avg("value").alias("mean"))


def rank_layers(activity: DataFrame, n_layers: int, grouped: bool = True, by: str = "activity") -> DataFrame:
    """``activity`` with ``rank`` inside its step: by trunk or flat, by position or descending activity."""
    order = [F.col("layer_pos")] if by == "position" else [F.col("value").desc(), F.col("layer_pos")]
    keys = ["run_id", "step"] + (["trunk"] if grouped else [])
    return activity.withColumn("trunk", trunk(n_layers)).withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def weight_shares(df: DataFrame, parts: list[str]) -> DataFrame:
    """``df`` with ``total`` and each part's percent of it (0 if the total is 0)."""
    total = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    return df.withColumn("total", total).withColumns({f"{p}_pct": F.when(F.col("total") != 0, F.col(p) / F.col("total") * 100).otherwise(0.0) for p in parts})


def value_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Counts of values by tag in ``bins`` equal buckets between the tag's extremes; the greatest value is in the last."""
    ends = df.groupBy("tag").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    rows = df.join(ends, "tag")
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    return rows.where("value is not null").groupBy("tag", bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def training_score(df: DataFrame, variant: str = "slope") -> DataFrame:
    """``df`` with ``score`` (percent of what is available) and ``label``.

    Over slope (null: warming up), quality (0-100, or null) and plateau (or null); the variant ``plateau`` judges the
    trend by the plateau counter and the stability also by the mode.
    """
    p, q = F.col("plateau"), F.coalesce("quality", F.lit(0.0))
    if variant == "slope":
        s = F.col("slope")
        trend = F.when(s.isNull(), 15.0).when(s < -5e-5, 30.0).when(F.abs(s) < 5e-5, 20.0).otherwise(5.0)
        stability = F.when(p.isNull(), 0.0).when(p < 150, 30.0).when(p < 300, 20.0).otherwise(10.0)
        stability_max = F.when(p.isNull(), 0.0).otherwise(30.0)
    else:
        p = F.coalesce("plateau", F.lit(0))
        trend = F.when(p < 150, 30.0).when(p < 300, 20.0).otherwise(10.0)
        stability = F.when((F.col("mode") == "Stable") | (p < 150), 30.0).when(p < 300, 20.0).otherwise(10.0)
        stability_max = F.lit(30.0)
    most = 30.0 + F.when(q > 0, 40.0).otherwise(0.0) + stability_max
    score = (trend + F.when(q > 0, q / 100 * 40).otherwise(0.0) + stability) / most * 100
    out = df.withColumn("score", score)
    return out.withColumn("label", F.when(F.col("score") >= 80, "EXCELLENT").when(F.col("score") >= 60, "GOOD").when(F.col("score") >= 40, "MODERATE").otherwise("NEEDS ATTENTION"))


def progress_eta(df: DataFrame, max_steps: int, val_every: int = 500, save_every: int = 10000, epoch_steps: int = 1000) -> DataFrame:
    """``df`` (step, mean_step_time, paused) with percent, seconds left in all and in the epoch, their texts (PAUSED while
    paused, N/A beyond the last step), steps a second, steps to validation and save."""
    left = F.lit(max_steps) - F.col("step")
    t = F.col("mean_step_time")
    until = lambda n: F.lit(n) - F.pmod(F.col("step"), F.lit(n))
    out = df.withColumns({"percent": F.col("step") / max_steps * 100, "eta": left * t, "epoch_eta": until(epoch_steps) * t, "rate": F.when(t > 0, 1 / t).otherwise(0.0), "to_validation": until(val_every), "to_save": until(save_every)})
    text = lambda c: F.when(F.col("paused"), "PAUSED").otherwise(columns.duration_text(F.col(c)))
    return out.withColumns({"eta_text": text("eta"), "epoch_eta_text": text("epoch_eta")})


def cadence(df: DataFrame, every: int) -> DataFrame:
    return df.where(F.col("step") % every == 0)


def expected_lr(step: Column, initial: float, most: float, least: float, warm: int, steps: int) -> Column:
    """Linear rise, then a cosine."""
    rising = initial + (most - initial) * (step / warm)
    share = F.least(F.lit(1.0), (step - warm) / (steps - warm))
    return F.when(step < warm, rising).otherwise(least + (most - least) * 0.5 * (1 + F.cos(share * math.pi)))


def lr_schedule_audit(df: DataFrame, initial: float = 1e-6, most: float = 1.5e-4, least: float = 1e-6, warm: int = 1000, steps: int = 100_000, tolerance: float = 0.01) -> DataFrame:
    """``df`` (step, value: logged rate) with ``expected``, ``phase`` and whether it is ``off`` by more than a share."""
    want = expected_lr(F.col("step"), initial, most, least, warm, steps)
    out = df.withColumn("expected", want).withColumn("phase", F.when(F.col("step") < warm, "warmup").otherwise("cosine"))
    return out.withColumn("off", F.abs(F.col("value") - F.col("expected")) > tolerance * F.col("expected"))


def lr_boost_events(df: DataFrame, most: float, cooldown: int = 1000, jump: float = 1.5) -> DataFrame:
    """Steps whose rate jumps by more than ``jump``: the ratio, whether it keeps the limits, and the gap to the last one."""
    before = F.lag("value").over(series())
    rows = df.withColumns({"before": before, "ratio": F.try_divide(F.col("value"), before)})
    boosts = rows.where(F.col("ratio") > jump)
    gap = F.col("step") - F.lag("step").over(series())
    return boosts.select(*SERIES, "step", "before", "value", "ratio", ((F.col("ratio") <= 3.0 + 1e-9) & (F.col("value") <= most)).alias("allowed"), gap.alias("gap")).withColumn("too_soon", F.coalesce(F.col("gap") <= cooldown, F.lit(False)))


def weight_guard_audit(df: DataFrame, move: float = 0.01, slack: float = 1e-6) -> DataFrame:
    """Violations over (run_id, step, l1, ms, grad, perceptual), one row each: rule and value."""
    parts = ("l1", "ms", "grad", "perceptual")
    rows = df.withColumns({f"{c}_move": F.abs(F.col(c) - F.lag(c).over(by_run())) for c in parts})
    rules = [("ms_floor", F.col("ms"), F.col("ms") < 0.05 - slack), ("grad_floor", F.col("grad"), F.col("grad") < 0.05 - slack), ("l1_range", F.col("l1"), ~F.col("l1").between(0.1 - slack, 0.9 + slack))]
    total = F.col("l1") + F.col("ms") + F.col("grad")
    rules += [("sum", total, F.abs(total - 1) > slack), ("perceptual_range", F.col("perceptual"), ~F.col("perceptual").between(0.05 - slack, 0.25 + slack))]
    rules += [(f"{c}_change", F.col(f"{c}_move"), F.coalesce(F.col(f"{c}_move") > move + slack, F.lit(False))) for c in parts]
    found = F.array(*[F.struct(F.lit(n).alias("rule"), v.alias("value"), bad.alias("bad")) for n, v, bad in rules])
    return rows.select("run_id", "step", F.explode(found).alias("f")).where("f.bad").select("run_id", "step", "f.rule", "f.value")


def mode_intervals(df: DataFrame, warm: int = 1000, settle: int = 100) -> DataFrame:
    """Contiguous intervals of the mode over (run_id, step, aggressive): Warmup, Settling, Aggressive, Stable."""
    after = F.sum((F.col("step") >= warm).cast("int")).over(by_run())
    mode = F.when(F.col("step") < warm, "Warmup").when(after <= settle, "Settling").when(F.col("aggressive"), "Aggressive").otherwise("Stable")
    rows = df.select("run_id", "step", mode.alias("mode"))
    new = F.coalesce((F.lag("mode").over(by_run()) != F.col("mode")).cast("int"), F.lit(1))
    marked = rows.withColumn("new", new).withColumn("interval", F.sum("new").over(by_run()))
    return marked.groupBy("run_id", "interval").agg(F.first("mode").alias("mode"), F.min("step").alias("from_step"), F.max("step").alias("to_step"), F.count("*").alias("steps"))


def validation_rollup(per_image: DataFrame, variant: str = "package") -> DataFrame:
    """For each (run_id, step) over images (lr_psnr, lr_ssim, ki_psnr, ki_ssim): means, qualities of the means, and the
    improvement: summed over images, or in the legacy form the difference of the qualities. With a column ``loss`` (that of
    the image's batch, batches of one image) also ``val_loss``, its mean."""
    q = lambda side: columns.quality_score(F.col(f"{side}_psnr"), F.col(f"{side}_ssim"), variant)
    sums = {"improvement": q("ki") - q("lr"), "ki_to_gt": q("ki") - 1, "lr_to_gt": q("lr") - 1}
    means = [F.avg(c).alias(c) for c in ("lr_psnr", "lr_ssim", "ki_psnr", "ki_ssim")]
    if "loss" in per_image.columns:
        means.append(F.avg("loss").alias("val_loss"))
    out = per_image.groupBy("run_id", "step").agg(*means, *[F.sum(e).alias(k) for k, e in sums.items()])
    out = out.withColumns({"lr_quality": q("lr"), "ki_quality": q("ki")})
    if variant != "package":
        out = out.drop("ki_to_gt", "lr_to_gt").withColumn("improvement", F.col("ki_quality") - F.col("lr_quality"))
    return out


def sharpness_decision(df: DataFrame, aggressive: bool = False, n: int = 20) -> DataFrame:
    """``df`` (value: sharpness ratio) with ``mean`` of the last ``n`` and ``decision``."""
    least, blurry = (2, 0.72) if aggressive else (10, 0.75)
    k = "p" + uuid.uuid4().hex
    rows = last_rows(df, SERIES, "step", n, lambda row, _: plain_terms(row["value"].cast("double")), k)
    out = rows.withColumn("mean", mean_of(F.col(k)))
    wait = F.col(k)["place"] < least - 1
    return out.withColumn("decision", F.when(wait, "wait").when(F.col("mean") < blurry, "blurry").when(F.col("mean") > 0.92, "sharp").otherwise("hold")).drop(k)


def perceptual_band(df: DataFrame) -> DataFrame:
    """``df`` (ema) with the cap of the perceptual weight and its direction."""
    e = F.col("ema")
    return df.withColumns({"cap": F.when(e < 0.008, 0.20).when(e < 0.012, 0.15).otherwise(0.10), "direction": F.when(e < 0.010, "raise").when(e > 0.018, "lower").otherwise("hold")})


def cooldown_flags(df: DataFrame, n: int = 80) -> DataFrame:
    """``df`` (adjusted) with ``remaining`` steps of the cooldown after the last adjustment, and ``cooling``."""
    last = F.last(F.when(F.col("adjusted"), F.col("step")), ignorenulls=True).over(by_run().rowsBetween(Window.unboundedPreceding, -1))
    left = F.greatest(F.lit(0), F.lit(n) - (F.col("step") - last))
    out = df.withColumn("remaining", F.coalesce(left, F.lit(0)))
    return out.withColumn("cooling", F.col("remaining") > 0)


def delayed_snapshot(val: DataFrame, metrics: DataFrame, delay: int = 2) -> DataFrame:
    """Each validation (run_id, step) with the first metric row at least ``delay`` steps later (of several the least value)."""
    left = val.select("run_id", F.col("step").alias("val_step"), (F.col("step") + delay).alias("at"))
    right = metrics.select("run_id", F.col("step").alias("at"), "step", "value")
    found = asof(left, right, ("run_id",), "at", F.struct(F.col("step").alias("metric_step"), "value"), "f", forward=True, tie=-F.col("value"))
    return found.select("run_id", "val_step", "f.metric_step", "f.value")


def latest_state(metrics: DataFrame) -> DataFrame:
    """The last value of every tag of a run, as a map."""
    last = metrics.groupBy("run_id", "tag").agg(F.max_by("value", "step").alias("value"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tag", "value")))).alias("state"))


def val_train_ratio(val: DataFrame, train: DataFrame) -> DataFrame:
    """Each validation loss over the latest training loss at or before its step (of several at that step the greatest). Over
    a loss of zero the ratio is infinite, or NaN for zero over zero."""
    left = val.select("run_id", "step", F.col("value").alias("val"))
    found = asof(left, train.where("value is not null"), ("run_id",), "step", F.col("value"), "train", tie=F.col("value"))
    over_zero = F.col("val") * F.pow("train", F.lit(-1.0))  # as IEEE 754 divides, also by a negative zero
    return found.withColumn("ratio", F.when(F.col("train") == 0, over_zero).otherwise(F.try_divide("val", "train")))


def dead_runs(files: DataFrame, metrics: DataFrame, least_mb: float = 0.5, most_mb: float = 20.0, points: int = 15) -> DataFrame:
    """Runs to clear away: tiny ones, and small ones whose first tag has few points."""
    size = files.groupBy("run_id").agg((F.sum("bytes") / 2**20).alias("mb"))
    tags = metrics.groupBy("run_id", "tag").agg(F.count("*").alias("n"))
    first = tags.groupBy("run_id").agg(F.min_by("n", "tag").alias("points"))
    rows = size.join(first, "run_id", "left").withColumn("points", F.coalesce("points", F.lit(0)))
    return rows.where((F.col("mb") < least_mb) | (F.col("mb") <= most_mb) & (F.col("points") < points))


#: Fixed values. Scale of each series of the dashboard, and the codes of words.
DASHBOARD = {"total_loss": 100.0, "ema_l1": 1000.0, "lr": 1e6, "ki_quality": 100.0, "plateau_counter": 0.1, "is_cooldown": 50.0, "aggressive": 50.0, "lr_boost_available": 50.0}
PHASES = {"warmup": 0, "cosine": 1, "plateau_reduced": 2}
MODES = {"stable": 0, "aggressive": 1, "cooldown": 2, "plateau_reducing": 3}
CHECKPOINTS = {"regular": 1, "best": 2, "emergency": 3}


def code(word: Column, codes: dict[str, int]) -> Column:
    out = None
    for k, v in codes.items():
        out = F.when(word == k, v) if out is None else out.when(word == k, v)
    return out.otherwise(0)


def core_dashboard(metrics: DataFrame, tags: dict[str, float] | None = None) -> DataFrame:
    """One wide row for each (run_id, step), every tag scaled for the common axis."""
    tags = tags or DASHBOARD
    wide = metrics.groupBy("run_id", "step").pivot("tag", list(tags)).agg(F.max("value"))
    return wide.select("run_id", "step", *[(F.col(t) * s).alias(t) for t, s in tags.items()])


def status_labels(df: DataFrame) -> DataFrame:
    """``df`` (plateau, quality percent, trend, validating, paused, active) with the labels shown for it."""
    return df.withColumns({
        "plateau_band": columns.plateau_band(F.col("plateau")),
        "quality_band": columns.quality_band(F.col("quality")),
        "trend_label": columns.trend_label(F.col("trend")),
        "state": columns.run_state(F.col("validating"), F.col("paused"), F.col("active")),
    })
