"""The metric table: parts that merge, row groups that are skipped."""

from __future__ import annotations

from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from loomframe.sources import tables


def metrics(spark, k, tags=("a", "b", "c")):
    rows = spark.range(30).select(F.concat(F.lit("run"), (F.col("id") % 2).cast("string")).alias("run_id"), F.element_at(F.array(*[F.lit(t) for t in tags]), (F.col("id") % len(tags) + 1).cast("int")).alias("tag"), (F.col("id") + 100 * k).alias("step"))
    return rows.select("*", (F.col("step") / 7).alias("value"), F.timestamp_seconds("step").alias("wall_time"))


def folders(base: Path) -> list[str]:
    return sorted(f.name for f in base.iterdir() if f.is_dir())


def test_parts_stay_few_and_rows_whole(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    assert tables.read_metrics(spark, path).count() == 0
    for k in range(14):
        tables.append_metrics(metrics(spark, k), path, 3)
    assert folders(tmp_path / "m") == ["0000000000-0000000008", "0000000009-0000000011", "0000000012-0000000012", "0000000013-0000000013"]
    got = sorted((r.run_id, r.tag, r.step, r.value) for r in tables.read_metrics(spark, path).collect())
    assert got == sorted((r.run_id, r.tag, r.step, r.value) for k in range(14) for r in metrics(spark, k).collect())
    assert tables.read_metrics(spark, path, ["b"]).count() == 140


def test_a_broken_merge_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    for k in range(2):
        tables.append_metrics(metrics(spark, k), path, 3)
    metrics(spark, 9).write.parquet(f"{path}/0000000000-0000000002")
    (tmp_path / "m" / "0000000000-0000000002" / "_SUCCESS").unlink()
    assert tables.read_metrics(spark, path).count() == 60
    tables.append_metrics(metrics(spark, 2), path, 3)  # the same merge, now whole
    assert folders(tmp_path / "m") == ["0000000000-0000000002"] and tables.read_metrics(spark, path).count() == 90


def test_a_tag_lies_in_few_files(spark, tmp_path):
    path = f"file://{tmp_path}/m"
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.append_metrics(metrics(spark, 0, [f"t{i}" for i in range(10)]).crossJoin(spark.range(500)), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    groups = [pq.ParquetFile(f).metadata.row_group(g).column(1).statistics for f in (tmp_path / "m").rglob("*.parquet") for g in range(pq.ParquetFile(f).metadata.num_row_groups)]
    assert len(groups) >= 6 and sum(s.min <= "t4" <= s.max for s in groups) <= 2
    read = tables.read_metrics(spark, path, ["t4"])
    assert "In(tag, [t4])" in read._jdf.queryExecution().toString() or "EqualTo(tag,t4)" in read._jdf.queryExecution().toString()
    assert read.count() == 1500
