"""Exact deduplication by a stateful stream.

A digest table (row, document, digest, content locator) is streamed, in several micro-batches, through one keyed
aggregation whose state lives in RocksDB without watermark or expiry: for each digest it retains the keeper's identifier,
the locator of its content (the file it lies in) and the number of rows seen. With a ``folder`` of their own, state and
checkpoint outlast the call, and a later delivery meets the digests of those before. Partial aggregation runs before the shuffle, so a digest that a
third of all rows share reaches its state as one row for each task. Hits, the digests seen more than once, are then
checked on their full bytes: the smallest and largest text of a digest are equal exactly if all its texts are, an
aggregation that also combines before it shuffles. Digests that fail are grouped again by the text itself.

Everything is DataFrame code; ``foreachBatch`` only names the table each micro-batch writes.

Defined cases: a null text counts as empty; of rows equal in text and doc_id one stays; null doc_ids are smaller than
any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import bounded, keep_rows, stored, table, work_folder

#: Micro-batches of a call, unless the number of files in each is given.
BATCHES = 4
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each of many small stores reserves megabytes
}


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def whole(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def digest_state(rows: DataFrame) -> DataFrame:
    """The keyed state, for a stream or a batch of (delivery, row_id, doc_id, digest, file)."""
    return rows.groupBy("digest").agg(F.max(F.struct("doc_id", "delivery", "row_id", "file")).alias("keeper"), F.count("*").alias("n"))


def _stream_state(rows: DataFrame, folder: str, files_per_batch: int | None) -> DataFrame:
    """Run the digest table in ``folder`` through the stream, from where it stands; latest state of each digest seen
    more than once."""
    spark = rows.sparkSession
    digests, state = f"{folder}/digests", f"{folder}/state"
    files = files_per_batch or -(-len(rows.inputFiles()) // BATCHES) or 1
    schema = digest_state(rows).withColumn("batch", F.lit(0).cast("long")).schema
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{state}/part=-1")
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(digests)
        query = (
            digest_state(stream)
            .writeStream.outputMode("update")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(lambda batch, i: batch.withColumn("batch", F.lit(i).cast("long")).write.mode("overwrite").parquet(f"{state}/part={i}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    seen = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(state).where("n > 1")
    return seen.groupBy("digest").agg(F.max(F.struct("n", "keeper")).alias("s")).select("digest", "s.n", "s.keeper")


def decide(
    docs: DataFrame,
    key: Callable[[Column], Column] | None = None,
    files_per_batch: int | None = None,
    folder: str | None = None,
) -> DataFrame:
    """One row for each row of ``docs``: row_id, doc_id, text_sha256, keep_id, group_size, kept, file, keep_file.

    ``key`` replaces the state's digest; anything weaker than SHA-256 is still exact, through the check of full bytes.
    A ``folder`` keeps the state for later deliveries, which must be read from Parquet files that stay: groups then
    span all deliveries so far, and a row of an earlier one that a later one takes over is not told again.
    """
    spark = docs.sparkSession
    key = key or sha256
    text = whole()
    base = folder or work_folder(spark, "dedup")
    delivery = time.time_ns()
    digests = docs.select(
        F.lit(delivery).alias("delivery"),
        F.monotonically_increasing_id().alias("row_id"),
        "doc_id",
        key(text).alias("digest"),
        F.input_file_name().alias("file"),
    )
    digests.write.mode("append").parquet(f"{base}/digests")
    all_rows = spark.read.schema(digests.schema).parquet(f"{base}/digests")
    rows = all_rows.where(F.col("delivery") == delivery) if folder else all_rows
    repeated = stored(_stream_state(all_rows, base, files_per_batch).join(rows.select("digest").distinct(), "digest", "left_semi") if folder else _stream_state(all_rows, base, files_per_batch), "repeated")
    texts = docs.select(F.lit(delivery).alias("delivery"), F.monotonically_increasing_id().alias("row_id"), "doc_id", key(text).alias("digest"), F.input_file_name().alias("file"), text.alias("text"))
    if folder:
        texts = texts.unionByName(_earlier(all_rows, repeated, delivery, key))
    hits = bounded(repeated.select("digest"))
    clashes = stored(
        texts.select("digest", "text").join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("low"), F.max("text").alias("high")).where("low <> high").select("digest"),
        "clashes",
    )
    sure = repeated
    if not clashes.isEmpty():
        sure = stored(repeated.join(clashes, "digest", "left_anti"), "repeated")
    out = rows.join(bounded(sure), "digest", "left")
    if not clashes.isEmpty():
        told = _by_text(texts, clashes).where(F.col("delivery") == delivery)
        out = out.join(bounded(clashes), "digest", "left_anti").unionByName(told)
    return out.select(
        "row_id",
        "doc_id",
        "digest",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keeper.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce((F.col("keeper.row_id") == F.col("row_id")) & (F.col("keeper.delivery") == delivery), F.lit(True)).alias("kept"),
        "file",
        F.coalesce("keeper.file", "file").alias("keep_file"),
    )


def _earlier(all_rows: DataFrame, repeated: DataFrame, delivery: int, key: Callable[[Column], Column]) -> DataFrame:
    """Rows of earlier deliveries under the ``repeated`` digests, with their texts, read from the files that their
    locators name. A file that was delivered twice counts twice."""
    spark = all_rows.sparkSession
    digests = bounded(repeated.select("digest"))
    of = all_rows.where(F.col("delivery") < delivery).join(digests, "digest", "left_semi").select("file", "delivery").distinct()
    files = stored(of, "earlier-files")
    paths = [r.file for r in files.select("file").distinct().collect()]  # a name for each file
    kind = dict(all_rows.dtypes)["doc_id"]
    rows = spark.read.schema(f"doc_id {kind}, text string").parquet(*paths) if paths else spark.createDataFrame([], f"doc_id {kind}, text string")
    told = rows.select("doc_id", key(whole()).alias("digest"), F.input_file_name().alias("file"), whole().alias("text")).join(digests, "digest", "left_semi")
    return told.join(bounded(files), "file").select("delivery", F.lit(-1).cast("long").alias("row_id"), "doc_id", "digest", "file", "text")


def _by_text(texts: DataFrame, clashes: DataFrame) -> DataFrame:
    """Exact groups, by the text itself, of the few digests under which texts differ."""
    rows = stored(texts.join(bounded(clashes), "digest", "left_semi"), "clashing")
    groups = rows.groupBy("text").agg(F.max(F.struct("doc_id", "delivery", "row_id", "file")).alias("keeper"), F.count("*").alias("n"))
    return rows.join(groups, "text").select("digest", "delivery", "row_id", "doc_id", "file", "n", "keeper")


def deduplicate(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; all columns are kept."""
    said = decide(docs).select("doc_id", "digest", F.col("kept").alias("keep"))
    return keep_rows(docs, {"doc_id": F.col("doc_id"), "digest": sha256(whole())}, said)


def query(spark, sf_dir: str) -> DataFrame:
    """op4: the decision on every document."""
    said = decide(table(spark, sf_dir, "documents"))
    return said.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
