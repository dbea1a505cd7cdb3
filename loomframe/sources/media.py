"""Media files: rows of a path and its bytes as named files, PNG images, and the patch files of a training set.

``NamedFiles`` is a sink with two phases. Tasks write below a staging folder beside the target, every file under a name of
its own attempt first; once all tasks are done, one rename puts the folder in place. Until then nothing is to be seen at the
target, and a failed job leaves it as it was. What tasks report is a count, so the driver's part does not grow with files.
Nor does it as they are read back: ``listed`` lists folders in tasks, where Spark's file sources keep every file's status in
the driver, and ``png_images`` opens and decodes the files in tasks.
"""

from __future__ import annotations

import posixpath
import struct
import sys
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from loomframe.functions import columns, dims
from loomframe.operators import images
from loomframe.operators.catalog import resolve_category_path
from loomframe.session import shared_folder, ship

#: The writer's Python also starts beside the driver, where added files are not seen: its code travels along.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "path string, content binary"
LISTING = "path string, length bigint, modificationTime timestamp, is_folder boolean"
DECODED = "origin string, height int, width int, nChannels int, mode int, data binary"
#: Fixed values. The three folders of a patch: its target, and the stacks of five and seven input frames.
PATCH_FOLDERS = (("GT", "gt"), ("LR", "lr"), ("LR_7frames", "lr7"))
#: Fixed values. Channels by PNG colour type, and the image source's modes by channels.
PNG_CHANNELS = {0: 1, 2: 3, 6: 4}
MODES = {1: 0, 3: 16, 4: 24}
PNG_MARK = b"\x89PNG\r\n\x1a\n"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class NamedWriter(DataSourceArrowWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        folder, name = posixpath.split(self.target)
        self.staging = f"{folder}/.{name}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = pafs.FileSystem.from_uri(self.staging)
        attempt, known, files, size = uuid.uuid4().hex, set(), 0, 0
        for batch in iterator:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                path, content = path.as_py(), content.as_py() or b""
                parts = (path or "").split("/")
                if not path or any(p in ("", ".", "..") for p in parts):
                    raise ValueError(f"not a relative path of a file: {path!r}")
                folder = posixpath.join(base, *parts[:-1])
                if folder not in known:
                    if fs.get_file_info(base).type == pafs.FileType.NotFound:
                        raise RuntimeError("the job was given up")
                    fs.create_dir(folder, recursive=True)
                    known.add(folder)
                aside = f"{folder}/.{attempt}"  # another attempt at the same file never meets it half written
                with fs.open_output_stream(aside) as out:
                    out.write(content)
                fs.move(aside, f"{folder}/{parts[-1]}")
                files, size = files + 1, size + len(content)
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, staged = pafs.FileSystem.from_uri(self.staging)
        target = pafs.FileSystem.from_uri(self.target)[1]
        if fs.get_file_info(target).type != pafs.FileType.NotFound:
            if not self.overwrite:
                fs.delete_dir(staged)
                raise FileExistsError(self.target)
            fs.delete_dir(target)
        fs.move(staged, target)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staged = pafs.FileSystem.from_uri(self.staging)
        for _ in range(10):  # tasks of the failed job may still write for a moment
            try:
                fs.delete_dir(staged)
            except FileNotFoundError:
                return
            except OSError:
                pass
            time.sleep(0.2)


class NamedFiles(DataSource):
    """Option: ``path``, the folder that the rows' paths are relative to; it is made, or replaced in mode overwrite."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> NamedWriter:
        writer = NamedWriter(self.options["path"], overwrite)
        fs, staged = pafs.FileSystem.from_uri(writer.staging)
        fs.create_dir(staged, recursive=True)
        return writer


def write_named(files: DataFrame, base: str, overwrite: bool = False) -> None:
    """``files`` (path, content) below ``base``; a path that comes twice is refused before anything is written."""
    spark = files.sparkSession
    ship(spark)
    twice = files.groupBy("path").count().where("count > 1").select("path").limit(3).collect()
    if twice:
        raise ValueError(f"paths that come twice: {[r.path for r in twice]}")
    spark.dataSource.register(NamedFiles)
    files.select("path", "content").write.format("named_files").mode("overwrite" if overwrite else "append").option("path", base).save()


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def listed(spark: SparkSession, base: str) -> DataFrame:
    """The files below ``base`` (path, relative to it; length, modificationTime). There is a job for each level of folders and
    each folder is listed by one task; the list is stored, and the driver sees none of it. Names that begin with ``.`` or ``_``
    are left out, as Spark's sources do."""
    ship(spark)
    schema, kept = arrow_schema(LISTING), shared_folder(spark, "listing")
    level, folders = 0, spark.createDataFrame([("",)], "path string")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base.rstrip("/"))
        for folder in (f for batch in batches for f in batch.column("path").to_pylist()):
            found = fs.get_file_info(pafs.FileSelector(posixpath.join(root, folder)))
            for k in range(0, len(found), 10_000):
                shown = [i for i in found[k : k + 10_000] if not i.base_name.startswith((".", "_"))]
                yield pa.RecordBatch.from_arrays([
                    pa.array([posixpath.join(folder, i.base_name) for i in shown], pa.string()),
                    pa.array([i.size for i in shown], pa.int64()),
                    pa.array([i.mtime_ns and i.mtime_ns // 1000 for i in shown], pa.int64()).cast(schema.field("modificationTime").type),
                    pa.array([i.type == pafs.FileType.Directory for i in shown], pa.bool_()),
                ], schema=schema)

    while level == 0 or not folders.isEmpty():
        folders.repartition(tasks(spark), "path").mapInArrow(children, LISTING).write.parquet(f"{kept}/level={level}")
        folders = spark.read.schema(LISTING).parquet(f"{kept}/level={level}").where("is_folder").select("path")
        level += 1
    return spark.read.schema(f"{LISTING}, level int").parquet(kept).where("not is_folder").drop("is_folder", "level")


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def png_images(spark: SparkSession, base: str, drop_invalid: bool = False) -> DataFrame:
    """The PNG files below ``base`` as the image source gives them; files that can't be read, also empty ones (which that source
    passes over), have height -1, or are left out."""
    schema = arrow_schema(DECODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base.rstrip("/"))
        rows, size = [], 0
        for path in (p for batch in batches for p in batch.column("path").to_pylist()):
            with fs.open_input_stream(posixpath.join(root, path), compression=None) as file:
                found = png_pixels(file.read())
            rows.append(dict(zip(schema.names, (f"{base.rstrip('/')}/{path}", *(found or (-1, -1, -1, -1, b""))), strict=True)))
            size += len(rows[-1]["data"])
            if len(rows) == 1000 or size > 2**24:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    decoded = listed(spark, base).select("path").repartition(tasks(spark), "path").mapInArrow(run, DECODED)
    return decoded.where("height >= 0") if drop_invalid else decoded


def png_pixels(content: bytes) -> tuple[int, int, int, int, bytes] | None:
    """Height, width, channels, mode and pixels (grey, BGR or BGR with alpha) of a PNG, or None if it is none or broken. The
    kinds that ``png_bytes`` writes, with any filter; others are refused."""
    try:
        chunks, at = {b"IDAT": b""}, len(PNG_MARK)
        if not content.startswith(PNG_MARK):
            return None
        while b"IEND" not in chunks:
            length, kind = struct.unpack_from(">I4s", content, at)
            data, (crc,) = content[at + 8 : at + 8 + length], struct.unpack_from(">I", content, at + 8 + length)
            if zlib.crc32(kind + data) != crc:
                return None
            chunks[kind] = chunks[kind] + data if kind == b"IDAT" else data
            at += 12 + length
        w, h, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
        packed = zlib.decompress(chunks[b"IDAT"])
    except (struct.error, zlib.error, KeyError):
        return None
    if depth != 8 or colour not in PNG_CHANNELS or interlaced or b"tRNS" in chunks:
        raise ValueError(f"a PNG of depth {depth}, colour type {colour}, interlacing {interlaced}; read it by the image source")
    c = PNG_CHANNELS[colour]
    if len(packed) != h * (1 + w * c):
        return None
    rows = np.frombuffer(packed, np.uint8).reshape(h, 1 + w * c)
    if rows[:, 0].max(initial=0) > 4:
        return None
    array = unfiltered(rows, c) if rows[:, 0].any() else rows[:, 1:]
    array = array.reshape(h, w, c)[:, :, [2, 1, 0, 3][:c]] if c > 1 else array
    return h, w, c, MODES[c], np.ascontiguousarray(array).tobytes()


def unfiltered(rows: np.ndarray, c: int) -> np.ndarray:
    """The bytes of a PNG's rows, of ``c`` bytes a pixel, without their filters: none, left, up, mean of both, Paeth."""
    out = np.zeros((len(rows) + 1, rows.shape[1] - 1 + c), np.int64)  # a row above and a pixel to the left, of zeros
    for y, row in enumerate(rows, 1):
        kind, line, above = row[0], row[1:].astype(np.int64), out[y - 1]
        if kind == 1:
            line = line.reshape(-1, c).cumsum(axis=0).ravel()
        elif kind == 2:
            line += above[c:]
        if kind < 3:
            out[y, c:] = line % 256
            continue
        for x in range(c, out.shape[1], c):
            a, b, corner = out[y, x - c : x], above[x : x + c], above[x - c : x]
            if kind == 3:
                guess = (a + b) // 2
            else:
                da, db, dc = abs(b - corner), abs(a - corner), abs(a + b - 2 * corner)
                guess = np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, corner))
            out[y, x : x + c] = (line[x - c : x] + guess) % 256
    return out[1:, c:].astype(np.uint8)


def png_bytes(image: dict | None, level: int = 3) -> bytes | None:
    """A PNG of an image struct: grey, BGR or BGR with alpha."""
    if image is None:
        return None
    array = images.pixels(image)
    h, w, c = array.shape
    kinds = {1: 0, 3: 2, 4: 6}
    array = array[:, :, [2, 1, 0, 3][:c]] if c > 1 else array
    rows = np.concatenate([np.zeros((h, 1), np.uint8), array.reshape(h, w * c)], axis=1).tobytes()  # no filter on any row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, kinds[c], 0, 0, 0)
    return PNG_MARK + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows, level)) + chunk(b"IEND", b"")


def as_png(df: DataFrame, image: Column) -> Column:
    return images.kernel(df, png_bytes, "binary", image)


def patch_files(windows: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """(path, content) of the three files of each window (category, format, name, frame_idx, images, crop_y, crop_x, gt_h,
    gt_w): below the category's path and the format's folder, all three by the same name."""
    spark = windows.sparkSession
    known = dims.formats(spark).select("format", "output_dir", "suffix")
    rows = resolve_category_path(windows, overrides).join(F.broadcast(known), "format")  # a row for each format
    cut = images.gt_crop(images.lr_stack(images.lr_stack(rows, 7).withColumnRenamed("lr", "lr7"), 5))
    each = F.explode(F.array(*[F.struct(F.lit(folder).alias("folder"), F.col(c).alias("image")) for folder, c in PATCH_FOLDERS]))
    name = columns.patch_name(F.col("name"), F.col("frame_idx"), F.col("suffix"))
    out = cut.select(F.concat_ws("/", "base_path", "output_dir").alias("base"), name.alias("name"), each.alias("e"))
    return out.select(F.concat_ws("/", "base", "e.folder", "name").alias("path"), as_png(out, F.col("e.image")).alias("content"))


def write_patch_files(windows: DataFrame, base: str, overrides: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """GT, LR and LR_7frames images of every window, as PNG files below ``base``."""
    write_named(patch_files(windows, overrides), base, overwrite)
