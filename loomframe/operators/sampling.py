"""Plans of what to extract: quotas, timestamps, attempts, windows, splits, order, formats and crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions import dims
from loomframe.functions.draws import u
from loomframe.functions.ranks import numbered, running_sum


def quota(base: int) -> Column:
    """Extractions of a video: the limit times its category weights, cut to a whole number."""
    return (F.aggregate(F.map_values("categories"), F.lit(0.0), lambda s, w: s + w) * base).cast("int")


def extraction_quota(videos: DataFrame, base: int = 3000) -> DataFrame:
    return videos.withColumn("quota", quota(base))


def upto(n: Column) -> Column:
    """0 .. n-1, empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def sample_grid(videos: DataFrame, base: int = 3000) -> DataFrame:
    """video_id, frame_idx, ts: evenly spaced starts, around the end back to the front."""
    rows = videos.select("video_id", "duration", F.explode(upto(quota(base))).alias("frame_idx"))
    ts = F.pmod(F.col("frame_idx") * F.col("duration") / base, F.nullif("duration", F.lit(0.0)))
    return rows.select("video_id", "frame_idx", "duration", ts.alias("ts"))


def retry_candidates(samples: DataFrame, max_attempts: int = 10, skip: float = 60.0) -> DataFrame:
    """Every attempt of a sample: each one ``skip`` seconds further."""
    rows = samples.select("*", F.explode(F.sequence(F.lit(0), F.lit(max_attempts - 1))).alias("attempt"))
    return rows.withColumn("ts", F.pmod(F.col("ts") + F.col("attempt") * skip, F.nullif("duration", F.lit(0.0))))


def first_accepted(candidates: DataFrame, max_attempts: int = 10) -> DataFrame:
    """For each sample whether an attempt was accepted, how many it took, and the start it got."""
    ok = F.when(F.col("accepted"), F.col("attempt"))
    return candidates.groupBy("video_id", "frame_idx").agg(
        F.max(F.coalesce("accepted", F.lit(False))).alias("success"),
        F.coalesce(F.min(ok) + 1, F.lit(max_attempts)).alias("attempts"),
        F.min_by("ts", ok).alias("ts"),
    )


#: Frames of a video that are dealt out together, with copies of the first ones of the next block.
BLOCK = 64


def frame_window(samples: DataFrame, frames: DataFrame, n: int = 7, min_bytes: int = 10000, size: tuple[int, int] = dims.FRAME) -> DataFrame:
    """Samples (video_id, frame_idx, start_frame) with their ``n`` frames in order; only whole windows of valid frames, each
    of which is there once.

    Frames are dealt out by blocks of a video, each with the next block's first ``n`` - 1, and a window slides over them:
    of all frames a tenth moves twice, however many windows hold it.
    """
    block = max(BLOCK, n - 1)
    at = F.floor(F.col("frame_no") / block).cast("bigint")
    near = F.explode(F.when(F.pmod("frame_no", F.lit(block)) < n - 1, F.array(at - 1, at)).otherwise(F.array(at)))
    valid = frames.where((F.col("bytes") > min_bytes) & (F.col("height") == size[0]) & (F.col("width") == size[1]))
    held = valid.select("video_id", F.col("frame_no").cast("bigint").alias("frame_no"), near.alias("block"), F.struct("frame_no", "image").alias("frame"))
    asked = samples.select("video_id", F.col("start_frame").cast("bigint").alias("frame_no"), "frame_idx", F.lit(True).alias("asked"))
    rows = held.unionByName(asked.withColumn("block", at), allowMissingColumns=True)
    ahead = Window.partitionBy("video_id", "block").orderBy("frame_no").rangeBetween(0, n - 1)
    met = rows.withColumn("w", F.collect_list("frame").over(ahead)).where("asked").select("video_id", "frame_idx", F.array_sort("w").alias("w"))
    out = met.select("video_id", "frame_idx", F.col("w.frame_no").alias("frame_nos"), F.col("w.image").alias("images"))
    return out.where((F.size("frame_nos") == n) & (F.size(F.array_distinct("frame_nos")) == n))


def limits(videos: DataFrame, base: int, val_percent: float) -> DataFrame:
    """``videos`` (weight) with the limit of tasks, of validation tasks, of training tasks and the chunk of a round."""
    rows = videos.withColumn("limit", (F.col("weight") * base).cast("int"))
    rows = rows.withColumn("n_val", F.greatest(F.lit(1), (F.col("limit") * val_percent).cast("int")))
    return rows.withColumns({"n_train": F.greatest(F.lit(0), F.col("limit") - F.col("n_val")), "chunk": F.greatest(F.lit(1), (F.col("weight") * 20).cast("int"))})


def val_train_plan(videos: DataFrame, base: int = 3000, val_percent: float = 0.01) -> DataFrame:
    """Validation starts over the band from 20 to 80 %, training starts from the beginning."""
    rows = limits(videos, base, val_percent)
    val = rows.select("video_id", F.lit("Val").alias("split"), F.explode(upto(F.col("n_val"))).alias("i"), "duration", "n_val")
    val = val.select("video_id", "split", "i", (F.col("duration") * 0.2 + F.col("i") * (F.col("duration") * 0.6 / F.col("n_val"))).alias("ts"))
    train = rows.select("video_id", F.lit("Patches").alias("split"), F.explode(upto(F.col("n_train"))).alias("i"), "duration", "limit")
    return val.unionByName(train.select("video_id", "split", "i", (F.col("i") * (F.col("duration") / F.col("limit"))).alias("ts")))


def weighted_interleave(videos: DataFrame, base: int = 3000, val_percent: float = 0.01) -> DataFrame:
    """Training tasks in round-robin order: in each round every video gives its chunk, heavier videos first.

    ``sort_round``, ``sort_video`` and ``i`` order all tasks; ``position`` follows from counts, without a global sort:
    tasks of earlier rounds, and those of heavier videos in the same round. Both come from range partitions and the
    sums before them, so no task sees all videos.
    """
    rows = numbered(limits(videos, base, val_percent), F.col("weight").desc(), F.col("name"), F.col("video_id")).withColumnRenamed("ordinal", "video_rank")
    rounds = rows.select("video_id", "video_rank", "chunk", "n_train", F.explode(upto(F.ceil(F.col("n_train") / F.col("chunk")).cast("int"))).alias("round"))
    sized = rounds.withColumn("given", F.least("chunk", F.col("n_train") - F.col("round") * F.col("chunk")))
    total = sized.groupBy("round").agg(F.sum("given").alias("all"))
    before = total.select("round", (F.sum("all").over(Window.orderBy("round")) - F.col("all")).alias("earlier"))
    summed = running_sum(sized.select("video_id", "round", "chunk", "given", "video_rank"), "given", "round", "video_rank", "heavier")
    placed = summed.join(before, "round")
    tasks = placed.select("video_id", "round", F.explode(upto(F.col("given").cast("int"))).alias("k"), "chunk", "earlier", "heavier")
    return tasks.select("video_id", (F.col("round") * F.col("chunk") + F.col("k")).alias("i"), "round", (F.col("earlier") + F.col("heavier") + F.col("k")).alias("position"))


def readiness(videos: DataFrame, done: DataFrame, base: int = 3000, val_percent: float = 0.01) -> DataFrame:
    """One row: tasks needed before training can start, tasks done, and whether that is enough."""
    needed = limits(videos, base, val_percent).agg(F.sum(F.col("n_val") + F.least("chunk", "n_train")).alias("needed"))
    return needed.crossJoin(F.broadcast(done.agg(F.count("*").alias("done")))).withColumn("ready", F.col("done") >= F.col("needed"))


def choose_format(samples: DataFrame, shares: DataFrame, seed: int, key: tuple[str, ...] = ("video_id", "frame_idx", "category")) -> DataFrame:
    """``samples`` (category, ...) with ``format``, drawn by the category's shares (category, format, weight, ordinal)."""
    order = Window.partitionBy("category").orderBy("ordinal")
    whole = F.sum("weight").over(Window.partitionBy("category"))
    bands = shares.select("category", "format", (F.sum("weight").over(order) / whole).alias("hi"), ((F.sum("weight").over(order) - F.col("weight")) / whole).alias("lo"))
    lists = bands.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("hi", "format"))).alias("bands"))
    drawn = samples.withColumn("draw", u(seed, *[F.col(k) for k in key])).join(lists, "category", "left")
    hit = F.filter("bands", lambda b: b["hi"] > F.col("draw"))
    last = F.element_at("bands", -1)["format"]
    return drawn.withColumn("format", F.coalesce(F.get(hit, F.lit(0))["format"], last, F.lit("small_540"))).drop("draw", "bands")


def crop_offsets(df: DataFrame, seed: int, key: tuple[str, ...], mode: str = "random", frame: tuple[int, int] = dims.FRAME) -> DataFrame:
    """``df`` (gt_h, gt_w) with crop_y and crop_x: uniform over the frame, or centred."""
    room = [F.greatest(F.lit(0), F.lit(full) - F.col(c)) for full, c in zip(frame, ("gt_h", "gt_w"), strict=True)]
    if mode == "center":
        at = [F.floor(r / 2) for r in room]
    else:
        at = [F.floor(u(seed, F.lit(axis), *[F.col(k) for k in key]) * (r + 1)) for axis, r in zip("yx", room, strict=True)]
    return df.withColumns({"crop_y": at[0].cast("int"), "crop_x": at[1].cast("int")})


def pending_work(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(done.select(*keys), keys, "left_anti")
