"""Near duplicates by the Jaccard similarity of five-word shingles: a pair is one from ``SIMILAR`` = 4/5 on.

Candidates come first from ``simhash``: fingerprints of the same shingles, and the links of its search by segment
popcounts over grids, within four bits. Pairs of 4/5 often differ in more bits, so MinHash signatures of ``BANDS`` bands of
``ROWS`` values add to them: texts that agree on a whole band share a cell. A pair of similarity s shares one with
probability 1 - (1 - s^5)^24: 0.99993 at 0.8, more above. Every candidate of either is then checked on its exact sets of
shingles (64-bit digests), so no pair below 4/5 links.

In a cell of over ``CELL`` texts pairs are checked where they meet, and only links between texts that no earlier link
connects are given out: fewer than a task has texts. A text outside the largest class so far is held against all others
that are not of its class, on the sets, so a large group of copies takes about one pass and no link between classes is
missed. No task holds a whole cell: texts are dealt by hash into blocks of about ``BLOCK``.

* Each text first meets the block of its most crowded cell. What that links is one class from then on.
* One text of each class meets those of its cell's other classes, block by block, for as long as that links any. So a
  group of copies becomes one class before all texts of the cell meet.
* In every crowded cell that still holds several classes, texts outside its largest class are dealt into groups of about
  ``BLOCK``, and every group meets every block of the cell. This reaches all pairs of different classes.

Defined cases as in ``simhash``: a null text counts as empty; texts without words are alike; a text of under five words
is one shingle; rows that repeat a doc_id are documents of their own, null doc_ids come after all others, and one row of a class stays; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm import simhash
from loomframe.llm.common import bounded, keep_rows, lean, stored
from loomframe.llm.components import components
from loomframe.session import ship

SHINGLE, BANDS, ROWS, SEED, CELL, BLOCK = 5, 24, 5, 42, 32, 512
#: Similarity as a fraction.
SIMILAR = (4, 5)
_draws = np.random.default_rng(SEED)
FACTORS = _draws.integers(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1)
OFFSETS = _draws.integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct digests of the word shingles of ASCII-lower-cased UTF-8 text."""
    words = text.lower().split()
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - SHINGLE + 1))


def signature(found: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        np.minimum(least, (found[at : at + 2048] * FACTORS[:, None] + OFFSETS[:, None]).min(axis=1), out=least)
    return least


def _mapped(docs: DataFrame, columns: str, make: Callable[[list[bytes]], list[pa.Array]]) -> DataFrame:
    """``docs`` (doc_id, text_hash, text as binary) without its text, with columns made of it."""
    names = ["doc_id", "text_hash", *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *make(part.column(2))], names=names)

    return docs.mapInArrow(lean(run), f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, {columns}")


def _signed(texts: pa.Array) -> list[pa.Array]:
    bands, fps = [], []
    for text in texts:
        found = shingles(text.as_py())
        raw = signature(found).reshape(BANDS, ROWS)
        bands.append(np.array([xxhash.xxh64_intdigest(raw[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64))
        fps.append(simhash.signed(simhash.majority(found)))
    return [pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())]


def _sets(texts: pa.Array) -> list[pa.Array]:
    return [pa.array([shingles(t.as_py()).view(np.int64) for t in texts], pa.list_(pa.int64()))]


class Shared:
    """Shingles in common between texts, from the list of texts of each shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(s) for s in sets])
        owners = np.repeat(np.arange(len(sets)), self.sizes)
        kinds, at = np.unique(np.concatenate(sets), return_inverse=True)
        self.ids = np.split(at, np.cumsum(self.sizes)[:-1])
        self.texts = owners[np.argsort(at, kind="stable")]
        self.ends = np.cumsum(np.bincount(at, minlength=len(kinds)))

    def alike(self, of: int) -> np.ndarray:
        """Whether each text has the similarity with text ``of``."""
        ends = self.ends[self.ids[of]]
        counts = ends - np.where(self.ids[of] > 0, self.ends[self.ids[of] - 1], 0)
        both = np.zeros(len(self.sizes), np.int64)
        upto = np.cumsum(counts)
        for e, c in zip(*(np.split(x, np.searchsorted(upto, np.arange(1 << 22, upto[-1], 1 << 22))) for x in (ends, counts)), strict=True):
            places = np.repeat(e - np.cumsum(c), c) + np.arange(c.sum())  # about four million at a time
            both += np.bincount(self.texts[places], minlength=len(both))
        part, whole = SIMILAR
        return both * whole >= (self.sizes[of] + self.sizes - both) * part


def _cell_links(sets: list[np.ndarray], roots: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join the classes (``roots``) of the texts of a task, one for each class that a text newly meets."""
    group = np.unique(roots, return_inverse=True)[1]
    if group.max() == 0:
        return
    open_, shared = np.ones(len(group), bool), Shared(sets)
    largest = np.bincount(group).argmax()
    while True:
        todo = np.flatnonzero(open_ & (group != largest))
        if not len(todo):
            return
        at = todo[0]
        open_[at] = False
        # classes are whole in here, so a text that was compared before needs no second look
        found = np.flatnonzero(open_ & (group != group[at]) & shared.alike(at))
        if len(found):
            met, first = np.unique(group[found], return_index=True)
            yield from ((int(at), int(j)) for j in found[first])
            group[np.isin(group, met)] = group[at]
            largest = np.bincount(group).argmax()


def _link_crowded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (cell, text, root, grams) in partitions sorted by cell; the last cell of a batch waits for the next batch."""

    def pairs(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        texts = np.concatenate([b.column(1).to_numpy() for b in held])
        roots = np.concatenate([b.column(2).to_numpy() for b in held])
        sets = [grams.values.to_numpy() for b in held for grams in b.column(3)]
        ends = np.array(list(_cell_links(sets, roots)), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(texts[ends[:, 0]]), pa.array(texts[ends[:, 1]])], names=["a", "b"])

    held, cell = [], None
    for batch in batches:
        keys = batch.column(0).to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        for a, b in zip(starts, [*starts[1:], len(keys)], strict=True):
            if held and keys[a] != cell:
                yield pairs(held)
                held = []
            cell = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pairs(held)


def shared_cells(signed: DataFrame) -> DataFrame:
    """Stored (cell, text_hash, n): the texts of every cell that ``n`` > 1 texts share."""
    cells = signed.select(F.explode("bands").alias("cell"), "text_hash").distinct()
    counts = stored(cells.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"), "shared-cells")
    return stored(cells.join(bounded(counts), "cell"), "cell-texts")


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def _by_fingerprint(signed: DataFrame) -> DataFrame:
    """Pairs of texts within reach of ``simhash``: one text of each fingerprint with its others and with those it links to."""
    texts = stored(signed.select("fp", "text_hash").distinct(), "fingerprints")
    first = stored(texts.groupBy("fp").agg(F.min("text_hash").alias("text")), "distinct-fingerprints")
    a, b = (first.select(F.col("fp").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
    near = stored(simhash.links(first.select("fp")), "fingerprint-links").join(a, "a").join(b, "b")
    same = texts.join(first, "fp").where("text <> text_hash")
    return near.select(F.col("a_text").alias("a"), F.col("b_text").alias("b")).unionByName(same.select(F.col("text").alias("a"), F.col("text_hash").alias("b")))


def _in_small_cells(shared: DataFrame, cell_rows: int) -> DataFrame:
    few = shared.where(F.col("n") <= cell_rows).groupBy("cell").agg(F.collect_list("text_hash").alias("texts"))
    return few.select("texts", F.explode("texts").alias("a")).select("a", F.explode("texts").alias("b"))


def _in_crowded_cells(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Stored links of texts that share a cell. ``members`` is (cell, text_hash, root), about ``BLOCK`` texts a cell."""
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = members.join(sets, "text_hash").select("cell", "text_hash", "root", "grams")
    found = rows.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(lean(_link_crowded), "a long, b long")
    return stored(_pairs(found), "crowded-links")


def _block(n: Column, block: int, salt: int) -> Column:
    """The number of one of the blocks into which ``n`` texts are dealt by hash."""
    return F.pmod(F.xxhash64("text_hash", F.lit(salt)), F.ceil(n / block))


def _rooted(crowded: DataFrame, found: DataFrame) -> DataFrame:
    """Stored ``crowded`` (cell, text_hash, n) with ``root``, the class by the links ``found``."""
    roots = components(stored(found, "links-so-far")).select(F.col("node").alias("text_hash"), "root")
    joined = crowded.select("cell", "text_hash", "n").join(bounded(roots), "text_hash", "left")
    return stored(joined.withColumn("root", F.coalesce("root", "text_hash")), "rooted")


def _of_classes(rooted: DataFrame, block: int) -> DataFrame:
    """Stored members of blocks: one text of each class of the cells whose texts are dealt into several."""
    one = stored(rooted.where(F.col("n") > block).groupBy("cell", "root").agg(F.min("text_hash").alias("text_hash")), "class-texts")
    counts = stored(one.groupBy("cell").agg(F.count("*").alias("m")).where("m > 1"), "cell-classes")
    return stored(one.join(bounded(counts), "cell").select(F.xxhash64("cell", _block(F.col("m"), block, 2)).alias("cell"), "text_hash", "root"), "class-blocks")


def _of_all(rooted: DataFrame, block: int) -> DataFrame:
    """Members of blocks that let every text outside the largest class of its cell meet all other texts of the cell."""
    sizes = rooted.groupBy("cell", "root").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    cells = sizes.groupBy("cell").agg(F.max(F.struct("size", "root")).alias("most"), F.first("n").alias("n"))
    left = F.col("n") - F.col("most.size")
    mixed = stored(cells.where(left > 0).select("cell", F.col("most.root").alias("most"), left.alias("left")), "mixed-cells")
    rows = rooted.join(bounded(mixed), "cell")
    groups, blocks = F.ceil(F.col("left") / block), F.ceil(F.col("n") / block)
    upto = lambda m: F.sequence(F.lit(0), m.cast("int") - 1)
    own, mine = _block(F.col("n"), block, 3), _block(F.col("left"), block, 4)
    in_block = F.transform(upto(groups), lambda i: F.xxhash64("cell", i.cast("long"), own))
    in_group = F.transform(upto(blocks), lambda j: F.xxhash64("cell", mine, j.cast("long")))
    where = F.when(F.col("root") == F.col("most"), in_block).otherwise(F.array_union(in_block, in_group))
    return rows.select(F.explode(where).alias("cell"), "text_hash", "root")


def _only(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    return docs.join(bounded(wanted), "text_hash", "left_semi").select("doc_id", "text_hash", "text")


def _checked(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Stored ``pairs`` whose sets of shingles have the similarity, stored."""
    wanted = stored(pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).distinct(), "candidate-texts")
    sets = stored(_mapped(_only(docs, wanted), "grams array<long>", _sets).groupBy("text_hash").agg(F.first("grams").alias("grams")), "shingles")
    a, b = (sets.select(F.col("text_hash").alias(c), F.col("grams").alias(f"{c}_grams")) for c in "ab")
    both = F.size(F.array_intersect("a_grams", "b_grams"))
    of, whole = SIMILAR
    return stored(pairs.join(a, "a").join(b, "b").where(both * whole >= (F.size("a_grams") + F.size("b_grams") - both) * of).select("a", "b"), "links")


def links(docs: DataFrame, signed: DataFrame, cell_rows: int = CELL, block: int = BLOCK) -> DataFrame:
    """Links between texts whose sets of shingles have the similarity, enough of them to connect every class."""
    shared = shared_cells(signed)
    crowded = shared.where(F.col("n") > cell_rows)
    pairs = _by_fingerprint(signed).unionByName(_in_small_cells(shared, cell_rows))
    found = _checked(docs, stored(_pairs(pairs), "candidates"))
    first = stored(crowded.groupBy("text_hash").agg(F.max(F.struct("n", "cell")).alias("c")).select("text_hash", "c.*"), "crowded-texts")
    if first.isEmpty():
        return found
    made = _mapped(_only(docs, first.select("text_hash")), "grams array<long>", _sets)
    sets = stored(made.groupBy("text_hash").agg(F.first("grams").alias("grams")), "crowded-shingles")
    dealt = first.select(F.xxhash64("cell", _block(F.col("n"), block, 1)).alias("cell"), "text_hash", F.col("text_hash").alias("root"))
    found = found.unionByName(_in_crowded_cells(dealt, sets))
    while True:
        rooted = _rooted(crowded, found)
        members = _of_classes(rooted, block)
        met = None if members.isEmpty() else _in_crowded_cells(members, sets)
        if met is None or met.isEmpty():
            return found.unionByName(_in_crowded_cells(_of_all(rooted, block), sets))
        found = found.unionByName(met)


def classes(docs: DataFrame, cell_rows: int = CELL, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, component_id, keeper) for each row of ``docs``; component_id is the smallest doc_id of its class,
    null if it has none, and keeper the one text of the class that goes by it."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    signed = stored(_mapped(rows, "bands array<long>, fp long", _signed), "signatures")
    roots = components(stored(links(rows, signed, cell_rows, block), "all-links")).select(F.col("node").alias("text_hash"), "root")
    once = signed.groupBy("text_hash").agg(F.min("doc_id").alias("low"))
    joined = stored(once.join(bounded(roots), "text_hash", "left"), "texts")
    first = F.min(F.struct(F.col("low").isNull().alias("nameless"), "low", "text_hash"))
    lowest = joined.where("root is not null").groupBy("root").agg(first.alias("f")).select("root", F.col("f.low").alias("component_id"), F.col("f.text_hash").alias("keeper"))
    named = joined.where("root is not null").join(lowest, "root").select("text_hash", "component_id", "keeper")
    ids = joined.where("root is null").select("text_hash", F.col("low").alias("component_id"), F.col("text_hash").alias("keeper")).unionByName(named)
    return signed.select("doc_id", "text_hash").join(ids, "text_hash").select("doc_id", "text_hash", "component_id", "keeper")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One row of each near-duplicate class stays: one with the smallest doc_id, whatever ids are repeated or null."""
    keep = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keeper"))
    said = classes(docs).select("doc_id", "text_hash", keep.alias("keep"))
    return keep_rows(docs, {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64(F.coalesce("text", F.lit("")))}, said)
