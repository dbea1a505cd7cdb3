"""Packing documents into token sequences: shortest-pack-first over the histogram of lengths.

Documents are tokenised and cut into pieces of at most one sequence. The histogram of piece lengths, at most 4,096
numbers whatever the corpus, goes to the driver, which places lengths longest first: all pieces of a length go into the
emptiest pack that is open, or open new packs, and only counts of packing patterns are updated. Each slot of a pattern
then stands for a range of ranks among the pieces of its length, and pieces find their slot by their rank.

Ranks need no gathered group: pieces are stored, numbered within (length, slice) and offset by the counts of slices,
with as many slices to a length as its count asks for.

Defined cases: a null text counts as empty and packs as its end id alone; repeated rows are packed each; null doc_ids
are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import lean, stored, table
from loomframe.llm.tokens import batch_ids, vocabulary_path
from loomframe.session import ship

LENGTH = 4096


def pieces(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, and ids (little-endian uint32) if asked."""
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, out = [], []
            for i, found in enumerate(batch_ids(batch.column(1), path)):
                ids = found.astype("<u4")
                for start in range(0, len(ids), length):
                    part = ids[start : start + length].tobytes()
                    row.append(i)
                    out.append((start, len(part) // 4, zlib.crc32(part), len(ids), part if with_ids else None))
            columns = list(zip(*out, strict=True)) or [()] * 5
            arrays = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:4])]
            if with_ids:
                arrays.append(pa.array(columns[4], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return rows.mapInArrow(lean(run), schema)


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Slots (length, first rank, count, first sequence, offset) that place every piece, and the number of sequences.

    Open packs are grouped by pattern; the heap gives the group with most room. A pattern is a chain of slots, so a
    group that splits shares what it had.
    """
    open_packs: list[tuple[int, int, int, tuple | None]] = []  # (-room, order, count, chain of lengths)
    done: list[tuple[int, int, tuple | None]] = []  # (room, count, chain)
    order = 0
    for length in sorted(histogram, reverse=True):
        left, back = histogram[length], []
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, count, chain = heapq.heappop(open_packs)
                room = -room
            else:
                room, count, chain = capacity, left, None
            used = min(left, count)
            left -= used
            order += 1
            if count > used:
                heapq.heappush(open_packs, (-room, order, count - used, chain))
                order += 1
            rest = (room - length, used, (length, chain))
            if rest[0] == 0:
                done.append(rest)
            else:
                heapq.heappush(open_packs, (-rest[0], order, *rest[1:]))
    done += [(-room, count, chain) for room, _, count, chain in open_packs]
    slots, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for room, count, chain in done:
        offset = capacity - room
        while chain is not None:
            length, chain = chain
            offset -= length
            slots.append((length, ranks[length], count, sequence, offset))
            ranks[length] += count
        sequence += count
    return slots, sequence


def ranked(rows: DataFrame) -> DataFrame:
    """Stored ``rows`` (uid, length) with ``rank``, 0, 1, ... among the pieces of a length; no length gathers in one task.

    A length of n pieces has about sqrt(n) slices of about sqrt(n) pieces, so the slices' sizes stay as short as a slice.
    """
    n = F.col("n")
    counts = stored(rows.groupBy("length").agg(F.count("*").alias("n")), "histogram")  # at most one row for each length
    sliced = rows.join(F.broadcast(counts), "length").withColumn("slice", F.pmod(F.xxhash64("uid"), F.ceil(F.sqrt(n)))).drop("n")
    sizes = sliced.groupBy("length", "slice").agg(F.count("*").alias("m"))
    before = F.sum("m").over(Window.partitionBy("length").orderBy("slice")) - F.col("m")
    starts = sizes.select("length", "slice", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "slice").orderBy("uid")) - 1
    return sliced.withColumn("inside", inside).join(starts, ["length", "slice"]).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "slice")


def pack(docs: DataFrame, length: int = LENGTH, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece with its sequence_id and offset."""
    rows = stored(pieces(docs, length, path, with_ids).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    slots, _ = shortest_pack_first(histogram, length)
    slots.sort()
    table_ = np.array(slots, np.int64).reshape(-1, 5)
    shared = docs.sparkSession.sparkContext.broadcast(table_)
    keyed = ranked(rows.select("uid", "length"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        start = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            size, rank = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            i = np.searchsorted(start, size << 44 | rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(t[i, 3] + rank - t[i, 1]), pa.array(t[i, 4])], names=["uid", "sequence_id", "offset"])

    placed = keyed.select("uid", "length", "rank").mapInArrow(place, "uid long, sequence_id long, offset long")
    return rows.join(placed, "uid").drop("uid")


def query(spark, sf_dir: str) -> DataFrame:
    """op1: where every piece of every document lies."""
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
