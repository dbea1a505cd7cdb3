"""Formats, category defaults, keywords and parameter rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values. Frame height and width of the source material.
FRAME = (1080, 1920)
#: Fixed values. format, gt_h, gt_w, lr_h, lr_w, output_dir, suffix, aspect_ratio.
FORMATS = [
    ("small_540", 540, 540, 180, 180, "Patches", "", "1:1"),
    ("medium_169", 405, 720, 135, 240, "Patches_Medium169", "_med169", "16:9"),
    ("large_720", 720, 720, 240, 240, "Patches_Large", "_large", "1:1"),
    ("xlarge_1440", 810, 1440, 270, 480, "Patches_XLarge169", "_xl169", "16:9"),
    ("fullhd_1920", 1080, 1920, 360, 640, "Patches_FullHD", "_fullhd", "16:9"),
]
FORMAT_SCHEMA = "format string, gt_h int, gt_w int, lr_h int, lr_w int, output_dir string, suffix string, aspect_ratio string"
#: Fixed values. Shares of the formats by category.
CATEGORY_FORMATS = {
    "master": {"small_540": 0.50, "medium_169": 0.35, "large_720": 0.15},
    "universal": {"small_540": 0.50, "medium_169": 0.35, "large_720": 0.15},
    "space": {"small_540": 0.40, "medium_169": 0.35, "large_720": 0.25},
    "toon": {"small_540": 0.65, "medium_169": 0.35},
}
#: Fixed values. Output paths by category.
CATEGORY_PATHS = {
    "master": "Master/MasterModel/Learn",
    "universal": "Universal/UniversalModel/Learn",
    "space": "Space/SpaceModel/Learn",
    "toon": "Toon/ToonModel/Learn",
}
#: Fixed values. Words that make a title one of a class.
KEYWORDS = {
    "space": ["star trek", "star wars", "trek", "wars", "space", "alien", "interstellar", "gravity", "martian", "dune", "avatar", "guardians", "foundation", "expanse", "mandalorian", "prometheus", "covenant", "arrival", "contact", "moon"],
    "toon": ["shrek", "toy story", "pixar", "disney", "dreamworks", "frozen", "moana", "finding", "incredibles", "cars", "kung fu panda", "madagascar", "despicable", "minions", "animation", "animated", "cartoon"],
}
#: Fixed values. Weight by the first pattern that a name contains, and for other names.
NAME_WEIGHTS = [("s01e", 1.0), ("beverly", 0.3), ("unendliche", 0.2), ("shrek", 0.1), ("trek", 0.2), ("wars", 0.2), ("forrest", 0.2), ("hai", 0.3), ("thrones", 0.1), ("westworld", 0.1), ("strange", 0.2)]
DEFAULT_NAME_WEIGHT = 0.1
#: Fixed values. Parameters: class, least and greatest value.
PARAM_RULES = [
    ("plateau_safety_threshold", "safe", 100.0, 5000.0),
    ("plateau_patience", "safe", 50.0, 1000.0),
    ("cooldown_duration", "safe", 20.0, 200.0),
    ("max_lr", "safe", 1e-5, 1e-3),
    ("min_lr", "safe", 1e-8, 1e-4),
    ("log_tboard_every", "safe", 10.0, 500.0),
    ("val_step_every", "safe", 100.0, 2000.0),
    ("save_step_every", "safe", 1000.0, 50000.0),
    ("initial_grad_clip", "safe", 0.1, 10.0),
    ("l1_weight_target", "careful", 0.1, 0.9),
    ("ms_weight_target", "careful", 0.05, 0.5),
    ("grad_weight_target", "careful", 0.05, 0.5),
    ("perceptual_weight_target", "careful", 0.0, 0.25),
    ("n_feats", "startup", None, None),
    ("n_blocks", "startup", None, None),
    ("batch_size", "startup", None, None),
    ("num_workers", "startup", None, None),
    ("accumulation_steps", "startup", None, None),
]
#: Fixed values. Default configuration, and the fields that it must have.
DEFAULT_CONFIG = {"LR_EXPONENT": "-5", "WEIGHT_DECAY": "0.001", "MAX_STEPS": "100000", "VAL_STEP_EVERY": "500", "SAVE_STEP_EVERY": "10000", "LOG_TBOARD_EVERY": "100", "HIST_STEP_EVERY": "500", "WARMUP_STEPS": "1000", "AUTO_TUNED": "false", "MODEL_CONFIG": "{}"}
REQUIRED_FIELDS = ["LR_EXPONENT", "WEIGHT_DECAY", "MAX_STEPS", "VAL_STEP_EVERY", "SAVE_STEP_EVERY", "LOG_TBOARD_EVERY"]


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, FORMAT_SCHEMA)


def category_formats(spark: SparkSession, shares: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """category, format, weight, ordinal (place in the listing)."""
    rows = [(c, f, float(w), i) for c, d in (shares or CATEGORY_FORMATS).items() for i, (f, w) in enumerate(d.items())]
    return spark.createDataFrame(rows, "category string, format string, weight double, ordinal int")


def category_paths(spark: SparkSession, paths: dict[str, str] | None = None) -> DataFrame:
    return spark.createDataFrame(list((CATEGORY_PATHS if paths is None else paths).items()), "category string, path string")


def param_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PARAM_RULES, "param string, class string, lo double, hi double")
