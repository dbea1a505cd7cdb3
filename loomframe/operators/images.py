"""Image operators: NumPy kernels over Arrow batches, Catalyst expressions where arrays suffice.

Images are structs (height, width, nChannels, data), ``data`` holding unsigned bytes by row, column and channel (BGR).
Tensors are flat arrays by channel, row and column. One kernel call handles one row; image rows are large, so jobs over
full-size frames should set ``spark.sql.execution.arrow.maxRecordsPerBatch`` to a few dozen.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.functions import columns
from loomframe.functions.draws import u
from loomframe.session import ship

IMAGE = "struct<height:int,width:int,nChannels:int,data:binary>"


def kernel(df: DataFrame, fn: Callable, returns: str, *inputs: Column) -> Column:
    """``fn`` over rows as a column; arrays arrive as NumPy arrays, structs as dicts, the result goes back as it is."""
    ship(df.sparkSession)

    def numbers(column: pa.Array) -> Callable[[int], object]:
        if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type):
            offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
            return lambda i: values[offsets[i] : offsets[i + 1]].astype(float)
        return lambda i: column[i].as_py()

    def run(*cols: pa.Array) -> pa.Array:
        get = [numbers(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c) for c in cols]
        out = [fn(*[g(i) for g in get]) for i in range(len(cols[0]))]
        return pa.array([x.tolist() if isinstance(x, np.ndarray) else x for x in out], kinds[0])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kinds = [to_arrow_type(StructType.fromDDL(f"x {returns}")[0].dataType)]
    return F.arrow_udf(run, returns)(*inputs)


def pixels(image: dict) -> np.ndarray:
    return np.frombuffer(image["data"], np.uint8).reshape(image["height"], image["width"], image["nChannels"])


def image(array: np.ndarray) -> dict:
    h, w, c = array.shape
    return {"height": h, "width": w, "nChannels": c, "data": np.ascontiguousarray(array, np.uint8).tobytes()}


def grey(array: np.ndarray) -> np.ndarray:
    """Luma of BGR pixels, rounded."""
    if array.shape[2] == 1:
        return array[:, :, 0].astype(float)
    return np.floor(array.astype(float) @ np.array([0.114, 0.587, 0.299]) + 0.5)


def scene_diff(windows: DataFrame, threshold: float = 45.0) -> DataFrame:
    """``windows`` (first, last) with ``diff``, the mean absolute grey difference, and ``stable``. Only two frames of a
    window are looked at, before the others are fetched."""
    diff = kernel(windows, lambda a, b: float(np.abs(grey(pixels(a)) - grey(pixels(b))).mean()), "double", F.col("first"), F.col("last"))
    return windows.withColumn("diff", diff).withColumn("stable", F.col("diff") < threshold)


def cut(array: np.ndarray, y: int, x: int, h: int, w: int) -> np.ndarray:
    return array[y : y + h, x : x + w]


def gt_crop(windows: DataFrame, centre: int = 3) -> DataFrame:
    """``windows`` (images, crop_y, crop_x, gt_h, gt_w) with ``gt``, the centre frame's crop at native resolution."""
    fn = lambda frame, y, x, h, w: image(cut(pixels(frame), y, x, h, w))
    return windows.withColumn("gt", kernel(windows, fn, IMAGE, F.get("images", F.lit(centre)), *[F.col(c) for c in ("crop_y", "crop_x", "gt_h", "gt_w")]))


def lr_stack(windows: DataFrame, n: int = 5) -> DataFrame:
    """``windows`` with ``lr``: the crops of the middle ``n`` frames, shrunk three times and stacked.

    At exactly three to one every interpolation with half-pixel centres reads the middle pixel of each 3 x 3 block.
    """
    frames = F.slice("images", (7 - n) // 2 + 1, n)
    fn = lambda images, y, x, h, w: image(np.concatenate([cut(pixels(f), y, x, h, w)[1::3, 1::3] for f in images]))
    return windows.withColumn("lr", kernel(windows, fn, IMAGE, frames, *[F.col(c) for c in ("crop_y", "crop_x", "gt_h", "gt_w")]))


def split_stack(df: DataFrame, column: str = "lr", n: int = 5) -> DataFrame:
    """``df`` with ``frames``: a stacked image's ``n`` frames as byte strings, in Catalyst."""
    c = F.col(column)
    size = F.floor(F.octet_length(c["data"]) / n).cast("int")
    return df.withColumn("frames", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.substring(c["data"], i * size + 1, size)))


def augmentation(seed: int, epoch: Column, key: Column) -> list[Column]:
    """Flip left-right, flip up-down (true in half of the cases) and quarter turns (0 to 3) of a sample in an epoch."""
    draw = lambda what: u(seed, F.lit(what), epoch, key)
    return [(draw("h") < 0.5).alias("hflip"), (draw("v") < 0.5).alias("vflip"), F.floor(draw("r") * 4).cast("int").alias("turns")]


def turned(x: np.ndarray, hflip: bool, vflip: bool, turns: int) -> np.ndarray:
    """An image (channel, row, column) flipped and turned."""
    x = x[:, :, ::-1] if hflip else x
    x = x[:, ::-1] if vflip else x
    return np.rot90(x, turns, axes=(1, 2))


def augment(df: DataFrame, seed: int, epoch: int, key: str, arrays: list[str], shape: tuple[int, int, int]) -> DataFrame:
    """``df`` with the flat arrays flipped and turned, all of a row alike; ``shape`` is (channels, height, width)."""
    out = df.withColumns(dict(zip(("hflip", "vflip", "turns"), augmentation(seed, F.lit(epoch), F.col(key)), strict=True)))
    fn = lambda x, h, v, r: turned(x.reshape(-1, *shape).reshape(-1, *shape[1:]), h, v, r).ravel()
    return out.withColumns({a: kernel(out, fn, "array<double>", F.col(a), F.col("hflip"), F.col("vflip"), F.col("turns")) for a in arrays})


def to_tensor(df: DataFrame, column: str, into: str = "tensor") -> DataFrame:
    """``df`` with an image as a flat RGB tensor in 0-1."""
    fn = lambda x: (pixels(x)[:, :, ::-1].transpose(2, 0, 1) / 255.0).ravel()
    return df.withColumn(into, kernel(df, fn, "array<double>", F.col(column)))


def pooled(x: np.ndarray) -> np.ndarray:
    """2 x 2 means; an odd last row or column is dropped."""
    c, h, w = x.shape
    x = x[:, : h // 2 * 2, : w // 2 * 2]
    return x.reshape(c, h // 2, 2, w // 2, 2).mean(axis=(2, 4))


def losses(a: np.ndarray, b: np.ndarray, variant: str) -> dict[str, float]:
    """l1, ms and grad between a prediction and a target (channel, row, column)."""
    if variant == "legacy":
        a = np.clip(a, 0, 1)
    l1 = float(np.abs(a - b).mean())
    ms = float(np.abs(pooled(a) - pooled(b)).mean())
    grads = []
    for axis in (2, 1):
        da, db = np.diff(a, axis=axis), np.diff(b, axis=axis)
        grads.append(float(np.abs(da - db).mean() if variant == "legacy" else np.abs(np.abs(da) - np.abs(db)).mean()))
    return {"l1": l1, "ms": ms * (0.5 if variant == "legacy" else 1), "grad": sum(grads) / (1 if variant == "legacy" else 2)}


def pixel_losses(pairs: DataFrame, shape: tuple[int, int, int], variant: str = "hybrid") -> DataFrame:
    """``pairs`` (a prediction, b target: flat arrays) with l1, ms and grad."""
    fn = lambda a, b: losses(a.reshape(shape), b.reshape(shape), variant)
    out = pairs.withColumn("loss", kernel(pairs, fn, "struct<l1:double,ms:double,grad:double>", F.col("a"), F.col("b")))
    return out.select(*pairs.columns, "loss.*")


def sharpness(x: np.ndarray) -> float:
    return float((np.abs(np.diff(x, axis=2)).mean() + np.abs(np.diff(x, axis=1)).mean()) / 2)


def sharpness_ratio(pairs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """``pairs`` with ``ratio``, the prediction's mean gradient over the target's; 1 for a flat target."""

    def fn(a: np.ndarray, b: np.ndarray) -> float:
        under = sharpness(b.reshape(shape))
        return sharpness(a.reshape(shape)) / under if under > 0 else 1.0

    return pairs.withColumn("ratio", kernel(pairs, fn, "double", F.col("a"), F.col("b")))


def box(x: np.ndarray, size: int = 11) -> np.ndarray:
    """Means over size x size windows; outside counts as zero and in the divisor."""
    r = size // 2
    for axis in (1, 2):
        edge = [(0, 0)] * 3
        edge[axis] = (r + 1, r)
        total = np.cumsum(np.pad(x, edge), axis=axis)
        n = x.shape[axis]
        x = np.take(total, range(size, n + size), axis) - np.take(total, range(n), axis)
    return x / size**2


def ssim_value(a: np.ndarray, b: np.ndarray) -> float:
    c1, c2 = 0.01**2, 0.03**2
    ma, mb = box(a), box(b)
    va, vb, cov = box(a * a) - ma * ma, box(b * b) - mb * mb, box(a * b) - ma * mb
    return float((((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def ssim(pairs: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    fn = lambda a, b: ssim_value(a.reshape(shape), b.reshape(shape))
    return pairs.withColumn("ssim", kernel(pairs, fn, "double", F.col("a"), F.col("b")))


def psnr(pairs: DataFrame, variant: str = "package") -> DataFrame:
    return pairs.withColumn("psnr", columns.psnr(F.col("a"), F.col("b"), variant))


def stretch(n: int, times: int = 3) -> np.ndarray:
    """Weights of linear interpolation from ``n`` to ``times * n`` places, half-pixel centres, ends clamped."""
    at = np.clip((np.arange(n * times) + 0.5) / times - 0.5, 0, n - 1)
    low = np.minimum(np.floor(at).astype(int), max(n - 2, 0))
    weights = np.zeros((n * times, n))
    weights[np.arange(n * times), low] += 1 - (at - low)
    weights[np.arange(n * times), np.minimum(low + 1, n - 1)] += at - low
    return weights


def bilinear_x3(df: DataFrame, column: str, shape: tuple[int, int, int], into: str = "upscaled") -> DataFrame:
    """``df`` with a flat tensor enlarged three times."""
    rows, cols = stretch(shape[1]), stretch(shape[2])
    return df.withColumn(into, kernel(df, lambda x: (rows @ x.reshape(shape) @ cols.T).ravel(), "array<double>", F.col(column)))


def comparison_strip(df: DataFrame, parts: list[str], shape: tuple[int, int, int], gap: int = 3) -> DataFrame:
    """``df`` with ``strip``: the tensors side by side as bytes (RGB), black columns between."""

    def fn(*tensors: np.ndarray) -> dict:
        images = [np.clip(t.reshape(shape).transpose(1, 2, 0) * 255, 0, 255).astype(np.uint8) for t in tensors]
        black = np.zeros((shape[1], gap, shape[0]), np.uint8)
        return image(np.concatenate([x for i in images for x in (i, black)][:-1], axis=1))

    return df.withColumn("strip", kernel(df, fn, IMAGE, *[F.col(p) for p in parts]))


def tensor_stats(tensors: DataFrame) -> DataFrame:
    """For each (run_id, step) over its tensors (``values``): mean activity, global L2 norm, mean of the L2 norms."""
    per = tensors.select("run_id", "step", columns.mean_abs(F.col("values")).alias("m"), columns.l2_norm(F.col("values")).alias("n"))
    return per.groupBy("run_id", "step").agg(F.avg("m").alias("activity"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("global_norm"), F.avg("n").alias("mean_norm"))
