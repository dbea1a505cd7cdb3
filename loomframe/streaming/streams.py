"""Streaming forms of progress, telemetry and alerts.

Each function maps a streaming DataFrame to another; ``settled`` runs one over what there is now and gives the last
state of every key, for tests and for batch use. State lives in RocksDB where it is written by a state machine.

Rules that depend on the order of steps (plateaus, alerts, values in force) hold their rows back until the watermark has
passed their time, and then take them in step order: rows may arrive in any order within the lateness. Steps must not
decrease with time inside a run. Rows behind the watermark (it begins at the epoch) are dropped by Spark and counted in
the query's progress.
"""

from __future__ import annotations

import json
import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from loomframe.operators import folds
from loomframe.operators.folds import Plateau
from loomframe.session import shared_folder

#: The state machines' Python also starts beside the driver, where added files are not seen: their code travels along.
cloudpickle.register_pickle_by_value(folds)
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PROVIDER, ROCKSDB = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(start: Callable[[], StreamingQuery], spark: SparkSession) -> StreamingQuery:
    """Start a query on its default trigger, with RocksDB as its state store, and stop it when its input is used up."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)
    return query


def settled(stream: DataFrame, keys: list[str] | None = None, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Run ``stream`` over its available input; all rows it emitted, or with ``keys`` the last row of each key."""
    spark = stream.sparkSession
    path, schema = shared_folder(spark, "stream"), StructType([*stream.schema.fields, StructField("batch", LongType())])
    batches = []

    def write(batch: DataFrame, i: int) -> None:
        batch.withColumn("batch", F.lit(i).cast("bigint")).write.mode("overwrite").parquet(f"{path}/part={i}")
        batches.append(i)

    def start() -> StreamingQuery:
        return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint or shared_folder(spark, "checkpoint")).foreachBatch(write).start()

    drained(start, spark)
    rows = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(path) if batches else spark.createDataFrame([], schema)
    if not keys:
        return rows.drop("batch")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("s"))
    return last.select(*keys, "s.*")


def stream_status(stream: DataFrame) -> DataFrame:
    """The newest status by category, as rows (category, last_update, ...) of ``documents.stream_status_documents`` arrive."""
    rest = [c for c in stream.columns if c != "category"]
    return stream.groupBy("category").agg(F.max_by(F.struct(*rest), "last_update").alias("s")).select("category", "s.*")


def stream_category_counts(stream: DataFrame) -> DataFrame:
    return stream.groupBy("category").agg(F.count("*").alias("images"))


def stream_once_per_step(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each (run_id, step) once, although several batches report it; state is dropped behind the watermark."""
    return stream.withWatermark("wall_time", late).dropDuplicatesWithinWatermark(["run_id", "step"])


#: A block of waiting rows has up to so many.
HELD = 10_000


def packed(rows: pd.DataFrame) -> list[tuple[bytes]]:
    """``rows`` as blocks for a list state: one state value for many rows, as each one is converted and sent by itself."""
    out = []
    for at in range(0, len(rows), HELD):
        block = pa.RecordBatch.from_pandas(rows.iloc[at : at + HELD], preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as stream:
            stream.write_batch(block)
        out.append((sink.getvalue().to_pybytes(),))
    return out


def unpacked(block: tuple[bytes]) -> pd.DataFrame:
    return pa.ipc.open_stream(bytes(block[0])).read_pandas()


class InOrder(StatefulProcessor):
    """Holds the rows of a run back until the watermark has passed their time, and takes them in step order then.

    Rows wait in blocks of (at, step, ...); one timer, at the earliest of them, wakes a run that gets no further rows.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")

    def waiting_rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """(at, step, ...) of input rows; at is in milliseconds, 0 where a row has no time."""
        raise NotImplementedError

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """What ``rows``, next in step order, give."""
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.release(key, timerValues.getCurrentWatermarkInMs(), [self.waiting_rows(pdf) for pdf in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self.release(key, timerValues.getCurrentWatermarkInMs())

    def release(self, key: tuple, now: int, new: Sequence[pd.DataFrame] = ()) -> pd.DataFrame:
        """Takes the rows that are due, of those that wait and of ``new``; only what is left of them goes to the state."""
        new = [pdf for pdf in new if len(pdf)]
        parts = [unpacked(b) for b in self.waiting.get()] if self.waiting.exists() else []
        rows = pd.concat([*parts, *new], ignore_index=True) if parts or new else pd.DataFrame({"at": [], "step": []})
        due = rows["at"] <= now
        ready, rest = rows[due], rows[~due]
        if parts and len(ready):
            self.waiting.clear()
            if len(rest):
                self.waiting.put(packed(rest))
        elif new:
            left = pd.concat(new, ignore_index=True)
            left = left[left["at"] > now]
            if len(left):
                self.waiting.appendList(packed(left))
        first = int(rest["at"].min()) if len(rest) else None
        timers = list(self.handle.listTimers())
        for old in timers:
            if old != first:
                self.handle.deleteTimer(old)
        if first is not None and first not in timers:
            self.handle.registerTimer(first)
        return self.take(key, ready.sort_values("step", kind="stable"))

    def close(self) -> None:
        pass


def millis(times: pd.Series) -> pd.Series:
    return pd.Series(times.to_numpy().astype("datetime64[ns]").astype("int64") // 1_000_000, times.index).where(times.notna(), 0)


class PlateauState(InOrder):
    """A plateau fold for each run; rows that repeat a step count once."""

    def __init__(self, patience: int, changes: bool):
        self.patience, self.changes = patience, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.fold = handle.getValueState("fold", "best_loss double, best_quality double, ema_loss double, ema_quality double, counter double, step bigint, plateau boolean")

    def waiting_rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": millis(pdf["wall_time"]), "step": pdf["step"].astype("int64"), "loss": pdf["loss"].astype(float), "quality": pdf["quality"].astype(float)})

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame([], columns=["run_id", "step", "wall_time", "state", "counter"])
        old = self.fold.get() if self.fold.exists() else None
        fold, step, was = (Plateau(*old[:5]), old[5], old[6]) if old else (Plateau(), -1, False)
        out = []
        for at, now, loss, quality in zip(*(rows[c].tolist() for c in ("at", "step", "loss", "quality")), strict=True):
            if now <= step:
                continue
            step = now
            fold.see(loss, quality)
            plateau = fold.counter >= self.patience
            if plateau != was or not self.changes:
                out.append((key[0], step, pd.Timestamp(at, unit="ms"), "plateau" if plateau else "progress", fold.counter))
            was = plateau
        self.fold.update((*fold.state(), step, was))
        return pd.DataFrame(out, columns=["run_id", "step", "wall_time", "state", "counter"])


def stream_plateau(stream: DataFrame, patience: int = 250, late: str = "1 hour", changes: bool = True) -> DataFrame:
    """The plateau state over (run_id, step, loss, quality, wall_time): run_id, step, wall_time, state, counter; of the
    steps where it changes, or of all."""
    out = "run_id string, step bigint, wall_time timestamp, state string, counter double"
    runs = stream.select("run_id", "step", F.col("loss").cast("double").alias("loss"), F.col("quality").cast("double").alias("quality"), "wall_time").withWatermark("wall_time", late).groupBy("run_id")
    return runs.transformWithStateInPandas(PlateauState(patience, changes), out, "Append", "EventTime", eventTimeColumnName="wall_time")


class AlertState(StatefulProcessor):
    """Whether an alert may go off, and the step of the last. The rows of a batch come after those of all batches before."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "step bigint, armed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last, armed = self.last.get() if self.last.exists() else (0, True)
        out = []
        ordered = pd.concat(list(rows)).sort_values("step", kind="stable")  # what one batch released of a run
        for step, state in zip(ordered["step"], ordered["state"], strict=True):
            if armed and state == "plateau":
                last, armed = int(step), False
                out.append((key[0], last))
            elif step - last > self.gap:
                armed = True
        self.last.update((last, armed))
        yield pd.DataFrame(out, columns=["run_id", "step"])

    def close(self) -> None:
        pass


def stream_rate_limited_alert(plateaus: DataFrame, gap: int = 1000) -> DataFrame:
    """Alerts (run_id, step) over every step of ``stream_plateau``: on the first step of a plateau that finds the alert
    armed; the first step more than ``gap`` after an alert arms it again, for the steps after it."""
    return plateaus.groupBy("run_id").transformWithStateInPandas(AlertState(gap), "run_id string, step bigint", "Append", "None")


class ConfigState(InOrder):
    """The versions of every parameter by step, and the rows that wait for theirs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.versions = handle.getMapState("versions", "param string, step bigint", "value double, at bigint")

    def waiting_rows(self, pdf: pd.DataFrame) -> pd.DataFrame:
        asked = pdf[pdf["param"].isna()]
        return pd.DataFrame({"at": millis(asked["wall_time"]), "step": asked["step"].astype("int64"), "row": asked["row"]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = []
        for pdf in rows:
            said = pdf[pdf["param"].notna()]
            for param, step, value, at in zip(said["param"], said["step"], said["value"], millis(said["wall_time"]), strict=True):
                self.versions.updateValue((param, int(step)), (float(value), int(at)))
            waiting.append(self.waiting_rows(pdf))
        yield self.release(key, timerValues.getCurrentWatermarkInMs(), waiting)

    def release(self, key: tuple, now: int, new: Sequence[pd.DataFrame] = ()) -> pd.DataFrame:
        out = super().release(key, now, new)
        for param, versions in self.known.items():  # of those that the watermark has passed, only the newest is still asked for
            passed = [step for step, _, at in versions if at <= now]
            for step in passed[:-1]:
                self.versions.removeKey((param, step))
        return out

    def take(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        self.known = {}  # (step, value, at) by parameter, in step order
        for (param, step), (value, at) in self.versions.iterator() if len(rows) else ():
            self.known.setdefault(param, []).append((step, value, at))
        for versions in self.known.values():
            versions.sort()
        steps = {param: [v[0] for v in versions] for param, versions in self.known.items()}
        out = []
        for step, row in zip(rows["step"].tolist(), rows["row"].tolist(), strict=True) if len(rows) else ():
            places = {param: bisect_right(of, step) for param, of in steps.items()}
            config = {param: self.known[param][k - 1][1] for param, k in places.items() if k}
            out.append((key[0], step, row, json.dumps(config)))
        return pd.DataFrame(out, columns=["run_id", "step", "row", "config"])


def stream_with_config(metrics: DataFrame, configs: DataFrame, late: str = "1 hour") -> DataFrame:
    """``metrics`` (run_id, step, wall_time, ...), a stream, with ``config``: of each parameter the value in force at the
    row's step, after the stream ``configs`` (run_id, step, param, value, wall_time) of accepted changes. Both are one
    stream of changes and questions by run; a row waits until the watermark has passed its time, so a change counts
    whichever of the two comes first."""
    kept = StructType([f for f in metrics.schema if f.name not in ("run_id", "step")])
    run = F.col("run_id").cast("string").alias("run_id")
    asked = metrics.select(run, "step", "wall_time", F.to_json(F.struct(*kept.names)).alias("row"), F.lit(None).cast("string").alias("param"), F.lit(None).cast("double").alias("value")).withWatermark("wall_time", late)
    said = configs.where("param is not null and value is not null").select(run, F.col("step").cast("bigint").alias("step"), "wall_time", F.lit(None).cast("string").alias("row"), "param", F.col("value").cast("double").alias("value")).withWatermark("wall_time", late)
    runs = asked.unionByName(said).groupBy("run_id")  # the watermark is that of the slower of the two
    out = runs.transformWithStateInPandas(ConfigState(), "run_id string, step bigint, row string, config string", "Append", "EventTime")
    row = F.from_json("row", kept, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return out.select(F.col("run_id").cast(metrics.schema["run_id"].dataType).alias("run_id"), "step", row.alias("r"), F.from_json("config", "map<string,double>").alias("config")).select("run_id", "step", "r.*", "config")


def stream_new_patches(stream: DataFrame, path: str, checkpoint: str, ready_at: int = 1) -> StreamingQuery:
    """Start a query that writes for each batch i a table ``path``/batch=i (category, new_patches, total, ready): the
    patches new since the batch before, all so far, and whether they suffice. A batch that runs again says the same."""
    schema = "category string, new_patches bigint, total bigint, ready boolean"

    def batch(rows: DataFrame, i: int) -> None:
        now = rows.groupBy("category").agg(F.count("*").alias("new_patches")).withColumn("old", F.lit(0).cast("bigint"))
        if i:
            before = rows.sparkSession.read.schema(schema).parquet(f"{path}/batch={i - 1}")
            now = now.unionByName(before.select("category", F.lit(0).cast("bigint").alias("new_patches"), F.col("total").alias("old")))
        counts = now.groupBy("category").agg(F.sum("new_patches").alias("new_patches"), F.sum(F.col("new_patches") + F.col("old")).alias("total"))
        counts.withColumn("ready", F.col("total") >= ready_at).write.mode("overwrite").parquet(f"{path}/batch={i}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(batch).start()


def stream_metric_rollup(stream: DataFrame, bucket: int = 100, every: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean, least, greatest and last value by (run_id, tag), bucket of steps and window of wall_time, whose start is
    ``since``. State of a window is dropped once the watermark passes its end; rows later than that are left out."""
    at = (F.floor(F.col("step") / bucket) * bucket).cast("bigint").alias("bucket")
    grouped = stream.withWatermark("wall_time", late).groupBy("run_id", "tag", at, F.window("wall_time", every).alias("w"))
    rolled = grouped.agg(F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.max_by("value", "step").alias("last"), F.count("*").alias("n"))
    return rolled.select("run_id", "tag", "bucket", F.col("w.start").alias("since"), "mean", "least", "greatest", "last", "n")
