"""Sources that read files, and the shape check of decoded pairs."""

from __future__ import annotations

import struct
import zlib

from loomframe.operators.pairing import shape_check
from loomframe.sources.documents import read_images, scan_media


def png(width: int, height: int, rgb: tuple[int, int, int]) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = (b"\0" + bytes(rgb) * width) * height
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_scan_media(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for name in ("a.mkv", "b.MP4", "c.txt", "deep/d.mov"):
        (tmp_path / name).write_bytes(b"1234")
    got = scan_media(spark, str(tmp_path)).collect()
    assert sorted((r.name, r.length) for r in got) == [("a.mkv", 4), ("d.mov", 4)]


def test_read_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, (10, 20, 30)))
    (tmp_path / "b.png").write_bytes(b"no image")
    got = {r.origin.rsplit("/", 1)[1]: r for r in read_images(spark, str(tmp_path)).collect()}
    assert (got["a.png"].height, got["a.png"].width, bytes(got["a.png"].data)[:3]) == (2, 3, bytes([30, 20, 10]))
    assert got["b.png"].height == -1
    assert read_images(spark, str(tmp_path), drop_invalid=True).count() == 1


def test_shape_check(spark):
    formats = spark.createDataFrame([("small", 6, 6, 2, 2)], "format string, gt_h int, gt_w int, lr_h int, lr_w int")
    pairs = spark.createDataFrame(
        [("ok", "small", 6, 6, 10, 2), ("gt", "small", 6, 5, 10, 2), ("lr", "small", 6, 6, 8, 2), ("torn", "small", -1, -1, 10, 2), ("none", "small", None, 6, 10, 2), ("odd", "other", 6, 6, 10, 2)],
        "filename string, format string, gt_height int, gt_width int, lr_height int, lr_width int",
    )
    assert {r.filename: r.problem for r in shape_check(pairs, formats).collect()} == {"gt": "gt shape", "lr": "lr shape", "torn": "corrupt", "none": "corrupt", "odd": "unknown format"}


def test_null_values_of_parameters_are_rejected(spark):
    from loomframe.functions import dims
    from loomframe.operators import registry

    changes = spark.createDataFrame([(1, "max_lr", None), (2, "max_lr", 1e-4)], "change_id long, param string, value double")
    said = {r.change_id: (r.accepted, r.reason) for r in registry.validate_params(changes, {}, dims.param_rules(spark)).collect()}
    assert said == {1: (False, "no value"), 2: (True, None)}


def test_folds_carry_their_state_over_batches(spark):
    from loomframe.operators import telemetry

    rows = spark.createDataFrame([(r, "loss", k, float((k * 7 + len(r or "")) % 11)) for r in ("a", "bb", None) for k in range(50)], "run_id string, tag string, step long, value double")
    whole = sorted(map(str, telemetry.ema(rows).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(str, telemetry.ema(rows).collect())) == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    y = None
    for k in range(50):
        x = float((k * 7 + 1) % 11)
        y = x if y is None else 0.1 * x + 0.9 * y
    last = [r.ema for r in telemetry.ema(rows).where("run_id = 'a' and step = 49").collect()]
    assert abs(last[0] - y) < 1e-12


def test_running_sums_and_numbers_of_an_empty_table(spark):
    from loomframe.functions.ranks import numbered, running_sum

    empty = spark.createDataFrame([], "k string, o long, v long")
    assert numbered(empty, "o").collect() == [] and running_sum(empty, "v", "k", "o", "s").collect() == []
    rows = spark.createDataFrame([("a" if k % 3 else "b", k, k) for k in range(200)], "k string, o long, v long")
    for r in running_sum(rows.repartition(9), "v", "k", "o", "s").collect():
        assert r.s == sum(k for k in range(r.o) if ("a" if k % 3 else "b") == r.k)
