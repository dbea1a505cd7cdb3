"""Scalar functions over columns: titles, names, scores, labels, labels of states."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions import dims


def clean_title(name: Column) -> Column:
    """File name without extension and edition tags, trimmed. A leading dot starts no extension."""
    stem = F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")
    return F.trim(F.regexp_replace(stem, r"\{edition-[^}]+\}", ""))


def matches_any(text: Column, words: Iterable[str]) -> Column:
    return F.lower(text).rlike("|".join(re.escape(w) for w in words))


def categories(name: Column, folder: Column, keywords: dict[str, list[str]] | None = None) -> Column:
    """Category weights by keywords in name or folder; keywords are those of the two classes space and toon."""
    keywords = keywords or dims.KEYWORDS
    space, toon = (matches_any(name, keywords[k]) | matches_any(folder, keywords[k]) for k in ("space", "toon"))
    one = lambda k: F.create_map(F.lit(k), F.lit(1.0))
    both = F.create_map(*[F.lit(x) for x in ("general", 0.3, "space", 0.4, "toon", 0.3)])
    return F.when(space & toon, both).when(space, one("space")).when(toon, one("toon")).otherwise(one("general"))


def first_match_weight(name: Column, rules: list[tuple[str, float]] | None = None, default: float = dims.DEFAULT_NAME_WEIGHT) -> Column:
    """Weight of the first pattern, in listed order, that the lower-cased name contains."""
    out = None
    for pattern, weight in dims.NAME_WEIGHTS if rules is None else rules:
        hit = F.contains(F.lower(name), F.lit(pattern))
        out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def capitalize(text: Column) -> Column:
    """First character upper case, all others lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 2**30)))


def frame_rate(text: Column) -> Column:
    """``num/den`` as a number; null if it is none."""
    parts = F.split(text, "/")
    under = F.when(F.size(parts) > 1, F.get(parts, F.lit(1))).otherwise("1").try_cast("double")
    return F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), under)


def patch_name(title: Column, idx: Column, suffix: Column) -> Column:
    """Name of a patch file: the title with anything but ASCII letters and digits replaced, the index, the suffix."""
    safe = F.regexp_replace(title, r"[^a-zA-Z0-9]", "_")
    return F.concat(F.lit("patch_"), safe, F.lit("_idx"), idx.cast("string"), suffix, F.lit(".png"))


def round_double(x: Column, places: int) -> Column:
    """A double rounded as the SQL does it: scaled, to the nearest whole number with halves away from zero, and back. Spark's
    ``round`` goes by the shortest decimal of ``x`` instead, so it takes a quotient just below a half down. What has no finite
    scaled value stays as it is."""
    scaled = x * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.signum(scaled) * F.round(F.abs(scaled)) / 10.0**places).otherwise(x)


def mse(a: Column, b: Column) -> Column:
    """Mean squared difference of two arrays of numbers."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) > 0, total / F.size(a))


def psnr(a: Column, b: Column, variant: str = "package") -> Column:
    """Peak signal-to-noise ratio of values in 0-1; 50 for equal images (legacy: only if exactly equal)."""
    error = mse(a, b)
    same = error < 1e-10 if variant == "package" else error == 0
    return F.when(same, F.lit(50.0)).otherwise(20 * F.log10(1 / F.sqrt(error)))


def quality_score(psnr_: Column, ssim: Column, variant: str = "package") -> Column:
    """Weighted PSNR and SSIM: 0-1, or 0-100 in the legacy form."""
    clip = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(float(hi)), c))
    if variant == "package":
        return clip(0.7 * clip((psnr_ - 20) / 30, 1) + 0.3 * ssim, 1)
    return 0.5 * clip((psnr_ - 20) * 3.33, 100) + 0.5 * (100 * ssim)


def total_loss(weights: dict[str, tuple[Column, float]], parts: dict[str, Column]) -> Column:
    """Weighted sum of loss parts; a null weight takes its default, a null part counts as 0."""
    out = F.lit(0.0)
    for k, part in parts.items():
        weight, default = weights[k]
        out = out + F.coalesce(weight, F.lit(default)) * F.coalesce(part, F.lit(0.0))
    return out


def mean_abs(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))) / F.size(values))


def l2_norm(values: Column) -> Column:
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def log_activity_score(gradient: Column) -> Column:
    """0-100 from a mean absolute gradient, five decades wide."""
    raw = ((F.log10(gradient + 1e-9) + 5) * 25).cast("int")
    return F.greatest(F.lit(0), F.least(F.lit(100), raw))


def peak_severity(value: Column) -> Column:
    return F.when(value > 2.0, "EXTREME").when(value > 1.5, "VERY HIGH").when(value > 1.0, "HIGH").when(value > 0.5, "MODERATE").otherwise("NORMAL")


def plateau_band(counter: Column) -> Column:
    return F.when(counter > 300, "warning").when(counter > 150, "raised").otherwise("normal")


def quality_band(percent: Column) -> Column:
    return F.when(percent >= 70, "good").when(percent >= 50, "fair").otherwise("poor")


def trend_label(change: Column, dead: float = 0.001) -> Column:
    return F.when(change > dead, "rising").when(change < -dead, "falling").otherwise("stable")


def run_state(validating: Column, paused: Column, active: Column) -> Column:
    return F.when(validating, "validating").when(paused, "paused").when(active, "training")


def duration_text(seconds: Column) -> Column:
    """Days, hours and minutes; days only where there are any."""
    s = F.floor(seconds)
    d, h, m = F.floor(s / 86400), F.floor(F.pmod(s, F.lit(86400)) / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    return F.when(s < 0, "N/A").when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).otherwise(F.format_string("%dh %dm", h, m))


def checkpoint_step(name: Column) -> Column:
    """Step of a checkpoint file name; 0 for the old emergency name, null for anything else."""
    direct = F.nullif(F.regexp_extract(name, r"^checkpoint_step_(\d+)(?:_.*)?\.pth", 1), F.lit(""))
    numbers = F.filter(F.split(F.regexp_replace(name, r"\.pth", ""), "_"), lambda p: p.rlike(r"^\d+$"))
    ours = F.startswith(name, F.lit("checkpoint_step_")) & F.endswith(name, F.lit(".pth"))
    last = F.when(ours, F.get(numbers, F.size(numbers) - 1))
    return F.coalesce(direct.cast("long"), last.cast("long"), F.when(name == "checkpoint_emergency.pth", F.lit(0).cast("long")))


def checkpoint_type(name: Column, step: Column) -> Column:
    return F.when(F.contains(name, F.lit("_emergency")), "emergency").when((step % 10000 == 0) & (step > 0), "regular").otherwise("best")
