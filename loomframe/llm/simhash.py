"""Near-duplicate search on SimHash fingerprints through segment popcounts.

A fingerprint is cut into 32 segments of two bits, and each segment becomes its number of set bits. The Manhattan
distance of two such count vectors never exceeds the Hamming distance of the fingerprints, so it serves as a lower
bound. Written in unary inside its segment (0, 1, 2 as 00, 01, 11) a count vector is again a 64-bit number, and the
Manhattan distance is the number of differing bits.

Grid range-join: the segments form seven blocks. Two vectors within distance 4 differ in at most four blocks, so they
agree on at least three whole blocks; each of the 35 choices of three blocks is one grid over that subspace with cells
of side one, and every pair in reach shares a cell of some grid. Only distinct fingerprints enter. In each cell, pairs
are tested on the lower bound and then on the fingerprints themselves, in numpy over the shuffled, sorted cells.

A cell of over ``cell_rows`` fingerprints is never compared pair by pair. Its members go another exact way: two
fingerprints within distance 4 share a midpoint within two flips of each, so each member is listed under its 2,081
midpoints, and a midpoint links all that it lists, in a number of rows linear in the members.

Defined cases: a null text counts as empty; texts without words have fingerprint zero and link like any other; rows
that repeat a doc_id are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import bounded, keep_rows, lean, stored, table
from loomframe.llm.components import components
from loomframe.session import ship

SHINGLE, REACH, SEED = 4, 4, 42
SEGMENT_BITS, BLOCKS = 2, 7
CELL_ROWS = 4096
EVEN = 0x5555555555555555


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the word shingles of ASCII-lower-cased UTF-8 text."""
    words = text.lower().split()  # bytes split at exactly the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = len(words) - SHINGLE + 1
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        upto = min(n, at + 65536)
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at:upto].tolist(), ends[at + SHINGLE - 1 : upto + SHINGLE - 1].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def majority(digests: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of a set of 64-bit digests: each bit that is set in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(digests), 65536):
        part = digests[at : at + 65536].astype("<u8", copy=False)
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(digests), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) for each row; fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            fps = np.fromiter((fingerprint(texts[i].as_py()) for i in range(len(texts))), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(fps.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    return rows.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, fp long")


def unary(fp: Column) -> Column:
    """The vector of segment popcounts, in unary."""
    even = F.lit(EVEN)
    half = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(half).bitwiseAND(even)
    both = fp.bitwiseAND(half).bitwiseAND(even)
    return either.bitwiseOR(F.shiftleft(both, 1))


def unary_np(fp: np.ndarray) -> np.ndarray:
    even, one = np.uint64(EVEN), np.uint64(1)
    half = fp >> one
    return ((fp | half) & even) | (((fp & half) & even) << one)


def grid_masks(blocks: int = BLOCKS) -> list[int]:
    """One mask for each choice of blocks on which a pair in reach may agree."""
    cuts = [round(i * 32 / blocks) * SEGMENT_BITS for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [signed(sum(c)) for c in combinations(block, blocks - REACH)]


def _linked(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links inside sorted cells: all pairs of small cells, a spanning forest of larger ones."""
    counts = unary_np(fps)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    group = np.repeat(np.arange(len(starts)), sizes)
    left = np.flatnonzero(np.repeat(sizes <= 32, sizes))
    for shift in range(1, 32):
        left = left[left + shift < len(keys)]
        left = left[group[left] == group[left + shift]]
        if not len(left):
            break
        near = left[np.bitwise_count(counts[left] ^ counts[left + shift]) <= REACH]  # the lower bound
        near = near[np.bitwise_count(fps[near] ^ fps[near + shift]) <= REACH]
        yield fps[near], fps[near + shift]
    for g in np.flatnonzero(sizes > 32):
        rest = np.arange(starts[g], starts[g] + sizes[g])
        while len(rest):
            todo, rest = [rest[0]], rest[1:]
            while todo and len(rest):
                i = todo.pop()
                hit = np.bitwise_count(counts[rest] ^ counts[i]) <= REACH
                hit[hit] = np.bitwise_count(fps[rest[hit]] ^ fps[i]) <= REACH
                found = rest[hit]
                todo.extend(found.tolist())
                rest = rest[~hit]
                if len(found):
                    yield np.full(len(found), fps[i]), fps[found]


def _link_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over partitions sorted by cell; the last cell of a batch waits for the next batch."""
    names = ["a", "b"]

    def edges(keys, fps):
        for a, b in _linked(keys, fps):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=names)

    keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy()])
        fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
        if len(keys):
            cut = int(np.searchsorted(keys, keys[-1]))
            if cut:
                yield from edges(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(keys):
        yield from edges(keys, fps)


def links(fps: DataFrame, cell_rows: int = CELL_ROWS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of ``fps`` that keep every connection within reach."""
    masks = F.array(*[F.lit(m) for m in grid_masks(blocks)])
    cells = fps.select("fp", unary(F.col("fp")).alias("u"), F.explode(masks).alias("mask")).select(
        F.xxhash64("mask", F.col("u").bitwiseAND(F.col("mask"))).alias("cell"), "fp"
    )
    crowded = stored(cells.groupBy("cell").count().where(F.col("count") > cell_rows).select("cell"), "crowded-cells")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    plain = cells.join(bounded(crowded), "cell", "left_anti").repartition(n, "cell").sortWithinPartitions("cell", "fp")
    found = plain.select("cell", "fp").mapInArrow(lean(_link_cells), "a long, b long")
    if not crowded.isEmpty():
        members = cells.join(bounded(crowded), "cell", "left_semi").select("fp").distinct()
        found = found.unionByName(_through_midpoints(stored(members, "crowded")))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _through_midpoints(fps: DataFrame) -> DataFrame:
    flips = [0, *[signed(1 << i) for i in range(64)], *[signed((1 << i) | (1 << j)) for i, j in combinations(range(64), 2)]]
    listed = fps.select("fp", F.explode(F.lit(flips)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid"))
    met = listed.groupBy("mid").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)  # 2,081 at most
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")


def classes(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id) for each row of ``docs``."""
    rows = stored(fingerprints(docs), "fingerprints")
    once = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    roots = components(stored(links(once.select("fp"), cell_rows), "links"))
    joined = once.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    linked = stored(joined.where("root is not null"), "linked")
    lowest = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    named = linked.join(lowest, "root").select("fp", "component_id")
    ids = stored(joined.where("root is null").select("fp", F.col("low").alias("component_id")).unionByName(named), "classes")
    return rows.join(ids, "fp").select("doc_id", "text_hash", "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each near-duplicate class stays: that with the smallest doc_id."""
    said = classes(docs).select("doc_id", "text_hash", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("keep"))
    return keep_rows(docs, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))}, said)


def query(spark, sf_dir: str) -> DataFrame:
    """op9: fingerprint and class of every document."""
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
