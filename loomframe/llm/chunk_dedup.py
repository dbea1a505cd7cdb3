"""Substring deduplication by content-defined chunks.

A gear hash rolls over the bytes of each text; where its top bits are all set, a chunk ends. The hash sees the last 16 bytes
only, so an insertion moves at most the chunks around it and all others keep their bytes. Chunks have at least ``least``
and about ``2 * least`` bytes on average, which leaves most of a shared passage of fifty words inside whole chunks.

Chunks are known by a 64-bit digest. A digest that lies in several documents marks its chunks as repeated; neighbouring
repeated chunks form runs, and runs of ``words`` words or more are reported. Chance agreement of single digests makes
no run of that length.

The digest table is aggregated before it is shuffled and joined back on the digest, a join that adaptive execution
splits where a passage is in a third of all documents. Runs are found inside single documents.

Defined cases: a null text counts as empty; rows that repeat a doc_id are one document, whatever their texts; a repeat
inside one document alone is none; null doc_ids are one document, which is never the first; an empty table gives an empty
result; further columns pass through ``deduplicate``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import bounded, stored, table
from loomframe.session import ship

LEAST, BITS, MOST, WORDS = 16, 4, 128, 25
GEAR = np.array([xxhash.xxh64_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], np.uint16)


def boundaries(data: np.ndarray, least: int = LEAST, bits: int = BITS, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data`` (bytes of UTF-8), each between two characters."""
    n = len(data)
    if not n:
        return []
    h = GEAR[data]
    for shift in (1, 2, 4, 8):  # after each round h covers twice as many bytes
        h = np.concatenate([h[:shift], h[shift:] + (h[:-shift] << np.uint16(shift))]) if n > shift else h
    score = np.where(np.r_[(data[1:] & 0xC0) == 0x80, False], 0, h)  # no end inside a character
    ends = np.flatnonzero(score >= (1 << 16) - (1 << (16 - bits))) + 1
    out, last = [], 0
    for end in [*ends.tolist(), n]:
        while end - last > most:  # nothing ends here: the highest score of the stretch does, which periodic text repeats
            last += least + int(np.argmax(score[last + least - 1 : last + most]))
            out.append(last)
        if end - last >= least or end == n and end > last:
            last = end
            out.append(end)
    return out


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each chunk: doc_id, text_hash, start and end (code points), words (that begin in it), digest."""
    ship(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))
    names = ["doc_id", "text_hash", "start", "end", "words", "digest"]
    digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, which, parts = batch.column(2), [], []
            for i in range(len(texts)):
                text = texts[i].as_py()
                data = np.frombuffer(text, np.uint8)
                ends = boundaries(data)
                if not ends:
                    continue
                points = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
                space = (data == 32) | ((data >= 9) & (data <= 13))
                begins = np.r_[0, np.cumsum(~space & np.r_[True, space[:-1]])]
                at = np.array([0, *ends])
                digests = np.array([digest(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)], np.uint64)
                which.append(np.full(len(ends), i))
                parts.append(np.array([points[at[:-1]], points[at[1:]], np.diff(begins[at]), digests.view(np.int64)]))
                if sum(map(len, which)) > 200_000:
                    yield made(batch, which, parts)
                    which, parts = [], []
            if which:
                yield made(batch, which, parts)

    def made(batch: pa.RecordBatch, which: list, parts: list) -> pa.RecordBatch:
        row, p = pa.array(np.concatenate(which)), np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), *(pa.array(p[k].astype(np.int32)) for k in range(3)), pa.array(p[3])], names=names)

    return rows.mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text_hash long, start int, end int, words int, digest long")


def repeated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The chunks of runs of at least ``words`` words that other documents repeat, with ``first`` (the smallest doc_id
    that holds the chunk) and the run's start, end and words."""
    all_ = stored(chunks(docs), "chunks")
    held = all_.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("nameless"))
    several = (F.col("first") != F.col("last")) | (F.col("nameless") & F.col("first").isNotNull())
    shared = stored(held.where(several).select("digest", "first"), "shared-chunks")
    marked = all_.join(shared, "digest").groupBy("doc_id", "text_hash", "start").agg(F.first("end").alias("end"), F.first("words").alias("words"), F.first("first").alias("first"))
    by_doc = Window.partitionBy("doc_id", "text_hash").orderBy("start")
    gap = F.coalesce(F.lag("end").over(by_doc) < F.col("start"), F.lit(False)).cast("int")
    runs = marked.withColumn("gap", gap).withColumn("run", F.sum("gap").over(by_doc)).drop("gap")
    run = Window.partitionBy("doc_id", "text_hash", "run")
    whole = runs.withColumn("run_start", F.min("start").over(run)).withColumn("run_end", F.max("end").over(run)).withColumn("run_words", F.sum("words").over(run))
    return whole.where(F.col("run_words") >= words)


def spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row for each run: doc_id, text_hash, start, end, n_words, the documents that held its chunks first, and
    whether all were first here."""
    return repeated(docs, words).groupBy("doc_id", "text_hash", "run").agg(
        F.first("run_start").alias("start"),
        F.first("run_end").alias("end"),
        F.first("run_words").alias("n_words"),
        F.array_sort(F.collect_set("first")).alias("first_doc_ids"),
        F.min(F.col("first").eqNullSafe(F.col("doc_id"))).alias("own"),
    )


def deduplicate(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``docs`` with every repeated chunk cut out of ``text`` but where the smallest doc_id holds it."""
    k = "c" + uuid.uuid4().hex
    cuts = repeated(docs, words).where(~F.col("first").eqNullSafe(F.col("doc_id")))
    lists = stored(cuts.groupBy(F.col("doc_id").alias(f"{k}_id"), F.col("text_hash").alias(f"{k}_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(f"{k}_cuts")), "cuts")
    joined = docs.join(bounded(lists, 1_000_000, f"{k}_cuts"), docs["doc_id"].eqNullSafe(F.col(f"{k}_id")) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col(f"{k}_hash")), "left")
    text, begin = F.col("text"), F.struct(F.lit("").alias("kept"), F.lit(0).alias("at"))
    step = lambda acc, c: F.struct(F.concat(acc["kept"], F.substring(text, acc["at"] + 1, c["start"] - acc["at"])).alias("kept"), c["end"].alias("at"))
    done = F.aggregate(f"{k}_cuts", begin, step)
    rebuilt = F.when(F.col(f"{k}_cuts").isNull(), text).otherwise(F.concat(done["kept"], F.substring(text, done["at"] + 1, F.length(text))))
    return joined.select(*[rebuilt.alias("text") if c == "text" else docs[c] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op5: passages of documents that other documents repeat."""
    return spans(table(spark, sf_dir, "documents")).select("doc_id", "start", "end", "n_words", "first_doc_ids", "own")
