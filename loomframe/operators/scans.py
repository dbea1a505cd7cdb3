"""Scans along an ordered key that is too long for one task.

Rows are dealt out by ranges of (keys, order), so one key spreads over neighbouring ranges. Every range is scanned by
itself; what a range passes on is one row, and as only the first key of a range can come from the one before, a range
receives one row at most. These carries (no more than there are ranges, so they are broadcast) finish the scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.functions.ranks import placed, ranges
from loomframe.session import shared_folder, ship


def tasks(df: DataFrame) -> int:
    """Ranges of a scan: its rows are small but its work is not, so they are not merged by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def on_keys(keys: tuple[str, ...], prefix: str) -> Column:
    """Equal keys, nulls together; those of the other side carry ``prefix``."""
    return reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys])


def received(rows: DataFrame, carries: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``rows`` with the further columns of ``carries``, of which there is one row for each range at most."""
    named = carries.select(*[F.col(k).alias(f"of_{k}") for k in keys], *[c for c in carries.columns if c not in keys])
    return rows.join(F.broadcast(named), on_keys(keys, "of_"), "left").drop(*[f"of_{k}" for k in keys])


def last_seen(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the last ``value`` that is not null at or before the row, in ascending order inside its keys."""
    parts, by = ranges(df, (*keys, *order), tasks(df))
    own = Window.partitionBy(*keys, by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = parts.withColumn(name, F.last(value, ignorenulls=True).over(own))
    ends = parts.groupBy(*keys, by).agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("carry"))
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)  # a row for each key and range
    carries = ends.withColumn("carry", F.last("carry", ignorenulls=True).over(before)).where("carry is not null")
    return received(rows, carries, (*keys, by)).withColumn(name, F.coalesce(name, "carry")).drop("carry", by)


def asof(left: DataFrame, right: DataFrame, keys: tuple[str, ...], at: str, value: Column, name: str, forward: bool = False, tie: Column | None = None) -> DataFrame:
    """``left`` with ``name``: the ``value`` of the latest row of ``right`` at or before it (``forward``: of the first at or
    after it) along ``at`` inside its keys, or null. Of rows of ``right`` at the same place the greatest ``tie`` counts."""
    place = F.col(at) * (-1 if forward else 1)
    tie = F.lit(0) if tie is None else tie
    rows = right.select(*keys, place.alias("asof_at"), F.lit(0).alias("asof_side"), tie.alias("asof_tie"), value.alias("asof_value"))
    asked = left.select("*", place.alias("asof_at"), F.lit(1).alias("asof_side"))
    both = asked.unionByName(rows, allowMissingColumns=True)
    found = last_seen(both, keys, ("asof_at", "asof_side", "asof_tie"), "asof_value", name)
    return found.where("asof_side = 1").select(*left.columns, name)


def last_rows(df: DataFrame, keys: tuple[str, ...], order: str, n: int, terms: Callable[[Column, Column], dict[str, Column]], name: str, earlier: bool = False, chunk: int = 4096) -> DataFrame:
    """``df`` with the struct ``name``: the sums of ``terms`` over the last ``n`` rows of the key, the row included.

    A key is cut into blocks of ``n`` rows. The last ``n`` rows at the i-th row of a block are its first i and all but the
    first i of the block before, so they are a sum from the block's start (``own``) and one to the end of that block
    (``before``, null in the first block): work does not grow with ``n``, and nothing is subtracted. Blocks are dealt out in
    chunks of about ``chunk`` rows, each with a copy of the block before it (``earlier``: of two), so a key of any length
    spreads over the tasks.

    ``terms`` takes a row (a struct) and its place in its block and gives the terms by name: finite numbers, never null. ``name.place`` is
    the place in the key from 0 on; with ``earlier``, ``name.ago`` is ``own`` and ``before`` of the row ``n`` rows back.
    """
    tag = "p" + uuid.uuid4().hex
    place, block, part, mine, back, rev = (f"{tag}_{c}" for c in ("place", "block", "part", "mine", "back", "rev"))
    per, halo = max(chunk // n, 2), 2 if earlier else 1
    rows = placed(df.withColumn(tag, F.struct(*df.columns)).select(*keys, order, tag), keys, order, n=tasks(df)).withColumnRenamed("place", place)
    rows = rows.withColumn(block, F.floor(F.col(place) / n))
    home = F.floor(F.col(block) / per)
    to = F.when(F.col(block) % per >= per - halo, F.array(home, home + 1)).otherwise(F.array(home))
    dealt = rows.withColumn(part, F.explode(to)).withColumns({mine: F.col(part) == home, back: -F.col(block), rev: -F.col(place)})
    row = {c: F.col(tag)[c] for c in df.columns}
    found = terms(F.col(tag), F.col(place) - F.col(block) * n)
    dealt = dealt.withColumns({f"{tag}_t{c}": v for c, v in found.items()}).repartition(tasks(df), *keys, part)
    inside = Window.partitionBy(*keys, part, back)
    start, end = (inside.orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (place, rev))
    backward = Window.partitionBy(*keys, part).orderBy(back, rev)
    ahead = dealt.withColumn(f"{tag}_own", F.struct(*[F.sum(f"{tag}_t{c}").over(start).alias(c) for c in found]))
    ahead = ahead.withColumn(f"{tag}_end", F.struct(*[F.sum(f"{tag}_t{c}").over(end).alias(c) for c in found]))
    # the row n - 1 back is the first of the window; at a block's last row that is the block's own first row
    last = F.col(place) - F.col(block) * n == n - 1
    out = ahead.withColumn(f"{tag}_before", F.when(~last, F.lead(f"{tag}_end", n - 1).over(backward)))
    said = F.struct(F.col(f"{tag}_own").alias("own"), F.col(f"{tag}_before").alias("before"))
    parts = [F.col(place).alias("place"), F.col(f"{tag}_own").alias("own"), F.col(f"{tag}_before").alias("before")]
    if earlier:
        parts.append(F.lead(said, n).over(backward).alias("ago"))
    done = out.withColumn(f"{tag}_said", F.struct(*parts)).where(mine)
    return done.select(*[v.alias(c) for c, v in row.items()], F.col(f"{tag}_said").alias(name))


def plain_terms(value: Column) -> dict[str, Column]:
    """Terms of a mean: what is not null is counted, and what is not finite is counted apart, so that it is forgotten
    when it leaves. A NaN counts as both infinities."""
    nan, inf = F.isnan(value), float("inf")
    known = F.when(value.isNotNull(), 1).otherwise(0)
    up, down = (F.when(nan | (value == F.lit(end)), 1).otherwise(0) for end in (inf, -inf))
    return {"n": known, "up": up, "down": down, "y": F.when(value.isNull() | (up + down > 0), 0.0).otherwise(value)}


def total(of: Column, term: str) -> Column:
    """A term's sum over the last rows, of a struct of ``own`` and ``before``."""
    return of["own"][term] + F.coalesce(of["before"][term], F.lit(0))


def mean_of(of: Column) -> Column:
    """The mean of the values of ``plain_terms``, null where there are none."""
    up, down, n = (total(of, t) for t in ("up", "down", "n"))
    odd = F.when((up > 0) & (down > 0), float("nan")).when(up > 0, float("inf")).when(down > 0, float("-inf"))
    return F.when(n > 0, F.coalesce(odd, total(of, "y") / n))


def slope_of(of: Column, n: int) -> Column:
    """The least-squares slope by place of the values of ``plain_terms`` with ``x``, ``xx`` and ``xy`` of places in blocks;
    null where fewer than two values are known, NaN where one is not finite."""
    b = {t: F.coalesce(of["before"][t], F.lit(0)) for t in ("n", "y", "x", "xx", "xy")}  # its places lie n lower
    x = of["own"]["x"] + b["x"] - n * b["n"]
    xx = of["own"]["xx"] + b["xx"] - 2 * n * b["x"] + n * n * b["n"]
    xy = of["own"]["xy"] + b["xy"] - n * b["y"]
    count, y = total(of, "n"), total(of, "y")
    odd = total(of, "up") + total(of, "down") > 0
    return F.when(count > 1, F.when(odd, float("nan")).otherwise((count * xy - x * y) / (count * xx - x * x)))


def ddl(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"{c} {t}" for c, t in df.dtypes), *more])


def streamed(keys: tuple[str, ...], fold: Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, Any]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """``fold`` for ``mapInPandas`` over sorted partitions: it takes the next rows of a key and its state (None at first)
    and returns the rows to emit and the state. Only the state is carried from batch to batch, no key is held."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for pdf in batches:
            of = list(zip(*(pdf[k] for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(of)) if of[i] != of[i - 1]), len(of)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if last != of[a]:
                    last, state = of[a], None
                out, state = fold(pdf.iloc[a:b].reset_index(drop=True), state)
                yield out

    return run


def in_step_order(rows: DataFrame, keys: tuple[str, ...], schema: str, fold: Callable[[pd.DataFrame, Any], tuple[pd.DataFrame, Any]]) -> DataFrame:
    """Fold every series of ``rows`` in step order; parallelism is across series."""
    ship(rows.sparkSession)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "step").mapInPandas(streamed(keys, fold), schema)


def exponential_mean(df: DataFrame, keys: tuple[str, ...], alpha: float, start: float | None = None) -> DataFrame:
    """``df`` (keys, step, value) with ``ema``: y = alpha x + (1 - alpha) y, from ``start`` or else from the first value.

    A row maps the mean before it to a x + b, and such maps compose: one pass over a range gives every row the map of the
    range's rows up to it, and a range's last map carries the mean over to the next. Null values leave the mean as it is;
    without ``start`` there is none before the first value.
    """
    spark, by = df.sparkSession, "p" + uuid.uuid4().hex
    inside = (*keys, by)
    ship(spark)

    def fold(pdf: pd.DataFrame, state: tuple | None) -> tuple[pd.DataFrame, tuple]:
        y, seen, first, nth = state or (0.0, 0, np.nan, 0)
        values = pdf["value"].astype(float)
        offsets = pd.Series([y, *values]).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().to_numpy()[1:]
        counts = seen + values.notna().to_numpy().cumsum()
        known = values.dropna()
        first = known.iloc[0] if np.isnan(first) and len(known) else first
        nths = nth + np.arange(1, len(pdf) + 1)
        out = pdf.assign(offset=offsets, seen=counts, first=np.where(counts > 0, first, np.nan), nth=nths)
        return out, (float(offsets[-1]), int(counts[-1]), float(first), int(nths[-1]))

    def over(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, y, out = pdf.sort_values(by), np.nan if start is None else start, []
        for offset, seen, first in zip(pdf["offset"], pdf["seen"], pdf["first"], strict=True):
            out.append(y)
            if seen:
                y = offset + (1 - alpha) ** seen * (first if np.isnan(y) else y)
        return pdf[list(inside)].assign(carry=out)

    dealt = df.repartitionByRange(tasks(df), *keys, "step").sortWithinPartitions(*keys, "step").withColumn(by, F.spark_partition_id())
    maps = dealt.mapInPandas(streamed(inside, fold), ddl(dealt, "offset double", "seen bigint", "first double", "nth bigint"))
    path = shared_folder(spark, "scan")
    maps.write.parquet(path)
    rows = spark.read.schema(maps.schema).parquet(path)
    ends = rows.groupBy(*inside).agg(F.max_by(F.struct("offset", "seen", "first"), "nth").alias("e")).select(*inside, "e.*")
    several = ends.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n > 1").drop("n")  # two rows a range at most
    kinds = dict(rows.dtypes)
    carries = several.groupBy(*keys).applyInPandas(over, ", ".join(f"{c} {kinds[c]}" for c in inside) + ", carry double").where("carry is not null")
    before = F.coalesce("carry", F.col("first") if start is None else F.lit(float(start)))
    out = received(rows, carries, inside).withColumn("ema", F.col("offset") + F.pow(F.lit(1 - alpha), F.col("seen")) * before)
    return out.select(*df.columns, "ema")
