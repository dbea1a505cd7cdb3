"""Best-fit-decreasing packing into binary id matrices.

Every task packs the documents it reads, a bounded buffer of tokens at a time, and writes whole sequences: nothing is
shuffled, and a lost task is run again from its input. Documents longer than a sequence are split without loss. Within
a buffer pieces are placed longest first, each into the open sequence with the least room that holds it; a segment tree
over the amounts of room, 4,097 leaves, finds that sequence in a dozen steps. Sequences that are still short when a
buffer closes go on into the next one.

A packed sequence is one row: the id matrix row (little-endian unsigned integers of two or four bytes, ``PAD`` up to
the full length), the cumulative lengths of its segments from 0 on, and the positions, which start from 0 in every
segment. ``doc_ids``, ``starts`` and ``doc_tokens`` say what each segment holds.

Defined cases: a null text counts as empty and packs as its end id alone; repeated rows are packed each; null doc_ids
are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import stored, table
from loomframe.llm.tokens import batch_ids, vocabulary_path
from loomframe.session import ship

LENGTH, PAD = 4096, 0
#: Tokens that a task holds before it packs them (16 MB).
BUFFER_TOKENS = 4_000_000


class RoomTree:
    """Segment tree over amounts of room: which amounts have an open sequence, and the least of them that suffices."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.tree = [False] * (2 * self.base)

    def mark(self, room: int, there: bool) -> None:
        i = room + self.base
        self.tree[i] = there
        while i > 1:
            i //= 2
            now = self.tree[2 * i] or self.tree[2 * i + 1]
            if self.tree[i] == now:
                return
            self.tree[i] = now

    def least(self, room: int) -> int | None:
        """The least marked amount that is at least ``room``."""
        i = room + self.base
        if self.tree[i]:
            return room
        while i > 1:
            if not i % 2 and self.tree[i + 1]:
                i += 1
                while i < self.base:
                    i = 2 * i if self.tree[2 * i] else 2 * i + 1
                return i - self.base
            i //= 2
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of places in ``lengths``; equal lengths keep their order."""
    tree, open_, sequences = RoomTree(capacity), {}, []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        room = tree.least(lengths[i])
        if room is None:
            sequences.append([])
            at, room = len(sequences) - 1, capacity
        else:
            at = open_[room].pop()
            if not open_[room]:
                tree.mark(room, False)
        sequences[at].append(i)
        left = room - lengths[i]
        if left:
            if not open_.setdefault(left, []):
                tree.mark(left, True)
            open_[left].append(at)
    return sequences


def packed(docs: DataFrame, length: int = LENGTH, path: str | None = None, width: int = 2, buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row for each sequence: sequence_id, tokens, ids, cu_seqlens, positions, doc_ids, starts, doc_tokens."""
    if length > 1 << 16:
        raise ValueError(f"positions have two bytes: {length} is over {1 << 16}")
    ship(docs.sparkSession)
    path = path or vocabulary_path()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["doc_id"]
    doc_type = rows.select("doc_id").schema[0].dataType
    names = ["sequence_id", "tokens", "ids", "cu_seqlens", "positions", "doc_ids", "starts", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        doc_arrow = to_arrow_type(doc_type)
        held, tokens, made = [], 0, TaskContext.get().partitionId() << 33
        pad = np.full(length, PAD, f"<u{width}").tobytes()

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, tokens, made
            sequences = best_fit_decreasing([len(p[2]) // width for p in held], length)
            rows_, keep = [], []
            for s in sequences:
                sizes = [len(held[i][2]) // width for i in s]
                if not last and sum(sizes) < length - length // 64:
                    keep += [held[i] for i in s]
                    continue
                ends = np.r_[0, np.cumsum(sizes)]
                positions = np.arange(ends[-1]) - np.repeat(ends[:-1], sizes)
                body = b"".join(held[i][2] for i in s)
                rows_.append((made, int(ends[-1]), body + pad[len(body) :], ends.tolist(), positions.astype("<u2").tobytes(), *([held[i][k] for i in s] for k in (0, 1, 3))))
                made += 1
                if len(rows_) == 256:
                    yield batch_of(rows_)
                    rows_ = []
            if rows_:
                yield batch_of(rows_)
            held, tokens = keep, sum(len(p[2]) // width for p in keep)

        def batch_of(rows_: list) -> pa.RecordBatch:
            c = list(zip(*rows_, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(doc_arrow), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(c, kinds, strict=True)], names=names)

        for batch in batches:
            for i, found in enumerate(batch_ids(batch.column(1), path)):
                if len(found) and int(found.max()) >> (8 * width):
                    raise ValueError(f"token id {int(found.max())} does not fit into {width} bytes")
                ids = found.astype(f"<u{width}")
                doc = batch.column(0)[i].as_py()
                held += [(doc, at, ids[at : at + length].tobytes(), len(ids)) for at in range(0, len(ids), length)]
                tokens += len(ids)
                if tokens >= buffer_tokens:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return rows.mapInArrow(run, f"sequence_id long, tokens int, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<{kind}>, starts array<long>, doc_tokens array<long>")


def segments(matrix: DataFrame, width: int = 2) -> DataFrame:
    """Read packed rows back: one row for each segment, its ids checked by CRC-32 as four-byte integers."""
    ship(matrix.sparkSession)
    kind = dict(matrix.dtypes)["doc_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for ids, cu in zip(batch.column(1), batch.column(2), strict=True):
                row = np.frombuffer(ids.as_py(), f"<u{width}").astype("<u4")
                ends = cu.as_py()
                crcs.append([zlib.crc32(row[a:b].tobytes()) for a, b in zip(ends, ends[1:], strict=False)])
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(crcs, pa.list_(pa.int64()))], names=["sequence_id", "cu_seqlens", "doc_ids", "starts", "doc_tokens", "crcs"])

    read = matrix.select("sequence_id", "ids", "cu_seqlens", "doc_ids", "starts", "doc_tokens").mapInArrow(
        run, f"sequence_id long, cu_seqlens array<int>, doc_ids {kind}, starts array<long>, doc_tokens array<long>, crcs array<long>"
    )
    offsets = F.slice("cu_seqlens", 1, F.size("doc_ids"))
    ends = F.slice("cu_seqlens", 2, F.size("doc_ids"))
    parts = read.select("sequence_id", F.inline(F.arrays_zip(F.col("doc_ids").alias("d"), F.col("starts").alias("s"), offsets.alias("o"), ends.alias("e"), F.col("crcs").alias("c"), F.col("doc_tokens").alias("t"))))
    return parts.toDF("sequence_id", "doc_id", "start", "offset", "end", "ids_crc32", "doc_tokens").select(
        "doc_id", "start", (F.col("end") - F.col("offset")).cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.col("offset").cast("long").alias("offset")
    )


def query(spark, sf_dir: str) -> DataFrame:
    """op10: packed matrices of all documents, written, read back and listed by segment."""
    return segments(stored(packed(table(spark, sf_dir, "documents")), "matrices"))
