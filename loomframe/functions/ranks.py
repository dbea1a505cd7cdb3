"""Ranks and running sums over a whole order without a window that holds it in one task."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.session import shared_folder


def ranges(df: DataFrame, order: tuple[Column | str, ...], n: int | None = None) -> tuple[DataFrame, str]:
    """``df`` range-partitioned (``n``: into so many, else by size) and stored, with the name of the column that tells the
    ranges apart, in order."""
    by = "p" + uuid.uuid4().hex
    parts = df.repartitionByRange(*([n] if n else []), *order).withColumn(by, F.spark_partition_id())
    path = shared_folder(df.sparkSession, "ranges")
    parts.write.parquet(path)
    return df.sparkSession.read.schema(parts.schema).parquet(path), by


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``ordinal``, 0, 1, ... in the given order."""
    parts, by = ranges(df, order)
    counts = parts.groupBy(by).count()
    before = counts.select(F.col(by), (F.sum("count").over(Window.orderBy(by)) - F.col("count")).alias("ordinal_0"))  # a row for each range
    inside = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return parts.withColumn("ordinal", inside).join(F.broadcast(before), by).withColumn("ordinal", F.col("ordinal") + F.col("ordinal_0")).drop(by, "ordinal_0")


def running_sum(df: DataFrame, value: str, key: str, order: str, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of the same ``key`` before this one in the order."""
    parts, by = ranges(df, (key, order))
    sums = parts.groupBy(key, by).agg(F.sum(value).alias("s"))
    before = sums.select(key, by, (F.sum("s").over(Window.partitionBy(key).orderBy(by)) - F.col("s")).alias(f"{name}_0"))  # a row for each key and range
    inside = F.sum(value).over(Window.partitionBy(key, by).orderBy(order)) - F.col(value)
    return parts.withColumn(name, inside).join(before, [key, by]).withColumn(name, F.col(name) + F.col(f"{name}_0")).drop(by, f"{name}_0")


def placed(df: DataFrame, key: str | tuple[str, ...], *order: Column | str, n: int | None = None) -> DataFrame:
    """``df`` with ``place``: 0, 1, ... in the given order inside each ``key`` (nulls are one), however many rows that has.
    It is dealt into ``n`` ranges, or by size."""
    keys = (key,) if isinstance(key, str) else key
    parts, by = ranges(df, (*keys, *order), n)
    counts = parts.groupBy(*keys, by).count()
    first = F.sum("count").over(Window.partitionBy(*keys).orderBy(by)) - F.col("count")
    before = counts.select(*[F.col(k).alias(f"{by}_{k}") for k in keys], F.col(by).alias(f"{by}_of"), first.alias("place_0"))  # a row for each key and range
    inside = F.row_number().over(Window.partitionBy(*keys, by).orderBy(*order)) - 1
    on = [F.col(k).eqNullSafe(F.col(f"{by}_{k}")) for k in keys]
    met = parts.withColumn("place", inside).join(before, reduce(Column.__and__, on, F.col(by) == F.col(f"{by}_of")))
    return met.withColumn("place", F.col("place") + F.col("place_0")).select(*df.columns, "place")
