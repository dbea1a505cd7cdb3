"""Helpers shared by the corpus operators: the shared work folder, stored tables, bounded joins, row selection."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomframe.functions.ranks import numbered  # noqa: F401
from loomframe.session import shared_folder

#: A side with at most so many rows, counted after it is written, may be broadcast (under 50 MB for the narrow rows used here).
BROADCAST_ROWS = 200_000

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder."""
    return shared_folder(spark, name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives the loss of any executor."""
    path = work_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS, lists: str | None = None) -> DataFrame:
    """Hint a broadcast of a stored table if its counted rows stay within ``limit``; else leave a shuffle join to AQE.

    Where a row holds an array, ``lists`` names it and its elements are counted instead.
    """
    rows = df.count() if lists is None else df.agg(F.sum(F.size(lists) + 1)).first()[0] or 0
    return F.broadcast(df) if rows <= limit else df


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, with memory given back at a partition's end: later stages reuse its worker."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def draw(seed: int, *key: Column) -> Column:
    """Repeatable uniform draw in [0, 1) from 52 bits of an MD5 of seed and key; the same in any SQL engine."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def keep_rows(docs: DataFrame, keys: dict[str, Column], decisions: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose decision says keep, one for each repeated key.

    ``keys`` gives each key column of ``decisions`` as an expression over ``docs``; ``decisions`` has the keys and
    ``keep``, one row for each row of ``docs``. Only keys that lose a row are joined back, so most text never moves.
    """
    spark = docs.sparkSession
    names = list(keys)
    counted = decisions.groupBy(*names).agg(F.count("*").alias("n"), F.sum(F.col("keep").cast("long")).alias("kept"))
    marks = stored(counted.where("kept = 0 or n > 1").select(*names, (F.col("kept") == 0).alias("gone")), "marks")
    tag = "k" + uuid.uuid4().hex
    marks = bounded(marks.select(*[F.col(n).alias(f"{tag}_{n}") for n in names], F.col("gone").alias(f"{tag}_gone")))
    on = reduce(Column.__and__, [keys[n].eqNullSafe(F.col(f"{tag}_{n}")) for n in names])
    marked = docs.join(marks, on, "left")
    once = marked.where(F.col(f"{tag}_gone").isNull())
    again = marked.where(~F.col(f"{tag}_gone")).dropDuplicates([f"{tag}_{n}" for n in names])
    return once.select(*[once[c] for c in docs.columns]).unionByName(again.select(*[again[c] for c in docs.columns]))
