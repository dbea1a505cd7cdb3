"""Named files: what is seen before, after and instead of a commit."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomframe import queries as own
from loomframe.operators import images
from loomframe.sources import media
from loomframe.sources.documents import read_images, scan_media


def tree(base: Path) -> dict[str, bytes]:
    return {str(f.relative_to(base)): f.read_bytes() for f in base.rglob("*") if f.is_file() and not f.name.endswith(".crc")}


def rows(spark, files):
    return spark.createDataFrame([(p, c, 1) for p, c in files], "path string, content binary, more int").repartition(3)


def test_named_files_and_replacing_them(spark, tmp_path):
    base = tmp_path / "out"
    files = {"a.mkv": b"1", "deep/er/b.png": b"22", "deep/c": b"", "deep/null": None}
    media.write_named(rows(spark, files.items()), f"file://{base}")
    assert tree(base) == {p: c or b"" for p, c in files.items()}
    with pytest.raises(Exception, match="FileExistsError"):
        media.write_named(rows(spark, [("x", b"x")]), f"file://{base}")
    assert "a.mkv" in tree(base)
    media.write_named(rows(spark, [("x", b"x")]), f"file://{base}", overwrite=True)
    assert tree(base) == {"x": b"x"}
    media.write_named(rows(spark, []), f"file://{tmp_path}/none")
    assert (tmp_path / "none").is_dir() and tree(tmp_path / "none") == {}
    assert [f.name for f in tmp_path.iterdir() if f.name.startswith(".")] == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    base = tmp_path / "out"
    for bad in ("../up", "/abs", "a//b", "", None, "a/."):
        with pytest.raises(Exception, match="not a relative path"):
            media.write_named(rows(spark, [(f"ok{k}", b"1") for k in range(9)] + [(bad, b"2")]), f"file://{base}")
    torn = rows(spark, [(f"f{k}", b"1") for k in range(9)]).withColumn("content", F.when(F.col("path") == "f7", F.raise_error(F.lit("torn"))).otherwise(F.col("content")))
    with pytest.raises(Exception, match="torn"):
        media.write_named(torn, f"file://{base}")
    with pytest.raises(ValueError, match="twice"):
        media.write_named(rows(spark, [("same", b"1"), ("same", b"2")]), f"file://{base}")
    assert list(tmp_path.iterdir()) == []


@pytest.mark.parametrize("channels", [1, 3, 4])
def test_png_is_read_back_by_the_decoder(spark, tmp_path, channels):
    array = np.random.default_rng(channels).integers(0, 256, (5, 7, channels), np.uint8)
    png = media.png_bytes(images.image(array))
    media.write_named(rows(spark, [("a/b.png", png), ("a/torn.png", png[:40])]), f"file://{tmp_path}/p")
    got = {r.origin.rsplit("/", 1)[1]: r for r in read_images(spark, f"file://{tmp_path}/p").collect()}
    assert (images.pixels(got["b.png"].asDict()) == array).all()
    assert got["torn.png"].height == -1
    assert media.png_bytes(None) is None


def filtered(array: np.ndarray, kinds: list[int]) -> bytes:
    """A PNG whose rows have the given filters."""
    h, w, c = array.shape
    rgb = array[:, :, [2, 1, 0, 3][:c]] if c > 1 else array
    lines, packed = np.zeros((h + 1, (w + 1) * c), int), b""
    lines[1:, c:] = rgb.reshape(h, w * c)
    for y, kind in enumerate(kinds, 1):
        line, left, up, corner = lines[y, c:], lines[y, :-c], lines[y - 1, c:], lines[y - 1, :-c]
        near = [min((abs(b - k), 0, a), (abs(a - k), 1, b), (abs(a + b - 2 * k), 2, k))[2] for a, b, k in zip(left.tolist(), up.tolist(), corner.tolist(), strict=True)]
        packed += bytes([kind]) + ((line - [0 * line, left, up, (left + up) // 2, np.array(near)][kind]) % 256).astype(np.uint8).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head, half, z = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0), len(packed) // 2, zlib.compressobj()
    parts = [z.compress(packed[:half]) + z.flush(zlib.Z_SYNC_FLUSH), z.compress(packed[half:]) + z.flush()]
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + b"".join(chunk(b"IDAT", p) for p in parts) + chunk(b"IEND", b"")


def test_images_read_in_tasks_are_those_of_the_image_source(spark, tmp_path):
    files, r = {}, np.random.default_rng(3)
    for c in (1, 3, 4):
        array = r.integers(0, 256, (11, 6, c), np.uint8)
        files[f"{c}/plain.png"] = media.png_bytes(images.image(array))
        files[f"{c}/deep/er/all.png"] = filtered(array, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0, 4])
        files[f"{c}/deep/first.png"] = filtered(array[:3], [4, 3, 2])
    files |= {"torn.png": files["3/plain.png"][:50], "none.png": b"no image", "empty.png": b"", "_left.png": b"", "_out/x.png": files["1/plain.png"]}
    base = f"file://{tmp_path}/p"
    media.write_named(rows(spark, files.items()), base)

    def found(**how):
        return sorted((r.origin.split("/p/")[1], r.height, r.width, r.nChannels, r.mode, bytes(r.data)) for r in read_images(spark, base, **how).collect())

    assert len(found()) == 11
    assert found(png_only=True) == sorted([*found(), ("empty.png", -1, -1, -1, -1, b"")])
    assert found(png_only=True, drop_invalid=True) == found(drop_invalid=True)
    for damaged in (files["3/plain.png"][:-20] + b"x" + files["3/plain.png"][-19:], files["3/plain.png"][:-12]):
        assert media.png_pixels(damaged) is None
    with pytest.raises(ValueError, match="interlacing 1"):
        head = b"IHDR" + struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 1)
        media.png_pixels(b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + head + struct.pack(">I", zlib.crc32(head)) + files["3/plain.png"][33:])


def test_files_are_listed_in_tasks(spark, tmp_path):
    files = {"a.mkv": b"1", "deep/er/b.png": b"22", "deep/c d": b"", ".x": b"1", "deep/_y": b"1"}
    media.write_named(rows(spark, files.items()), f"file://{tmp_path}/p")
    (tmp_path / "p" / "no file").mkdir()
    got = media.listed(spark, f"file://{tmp_path}/p/").collect()
    assert {r.path: r.length for r in got} == {"a.mkv": 1, "deep/er/b.png": 2, "deep/c d": 0}
    now = spark.range(1).select(F.current_timestamp()).collect()[0][0]
    assert all(0 <= (now - r.modificationTime).total_seconds() < 600 for r in got)
    media.write_named(rows(spark, []), f"file://{tmp_path}/none")
    assert media.listed(spark, f"file://{tmp_path}/none").collect() == []


def test_the_driver_keeps_no_status_of_patch_files(spark, sf):
    """The patch files' list does not pass through the driver: no scan of the plan names them."""
    got = own.queries()["s8_patch_files"](spark, sf)
    assert got.count() > 0
    assert not [f for f in got.inputFiles() if f.endswith(".png")]


def test_media_listed_in_tasks_are_those_of_sparks_source(spark, sf, tmp_path):
    files = {"a.mkv": b"1", "deep/b c.mov": b"22", "deep/d.MP4": b"1", "deep/e.mkv.part": b"1", "mkv": b"1", "none.avi": b"", ".x.mkv": b"1"}
    media.write_named(rows(spark, files.items()), f"file://{tmp_path}/p")

    def found(root, **how):
        below = lambda p: p.split(f"{tmp_path}/p", 1)[1]
        return sorted((below(r.path), r.name, below(r.folder), r.length, r.modificationTime.replace(microsecond=0)) for r in scan_media(spark, root, **how).collect())

    plain = found(f"file://{tmp_path}/p")
    assert [r[1] for r in plain] == ["a.mkv", "b c.mov"]
    for root in (f"file://{tmp_path}/p", f"file://{tmp_path}/p/", f"{tmp_path}/p"):
        got = found(root, in_tasks=True)
        assert [r for r in got if r[1] != "none.avi"] == plain
        assert [r[:4] for r in got if r[1] == "none.avi"] == [("/none.avi", "none.avi", "", 0)]
    assert not own.queries()["s1_scan_media"](spark, sf).inputFiles()[0].endswith((".mkv", ".mp4", ".avi", ".mov"))
