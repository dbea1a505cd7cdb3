"""Streams against the batch operators on the same rows, and the ordered table as a source."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from loomframe.operators import registry, telemetry
from loomframe.session import shared_folder
from loomframe.sources import replay
from loomframe.streaming import streams

START = datetime(2024, 1, 1)
ROWS = "run_id string, step bigint, loss double, quality double, wall_time timestamp, arrival bigint"


def at(minutes: float) -> datetime:
    return START + timedelta(minutes=minutes)


def ordered(spark, rows, schema, files=8, a_batch=2, order="arrival"):
    path, checkpoint = shared_folder(spark, "ordered"), shared_folder(spark, "checkpoint")
    df = spark.createDataFrame(rows, schema)
    replay.write_ordered(df, path, files, order)
    return replay.read_ordered(spark, path, df.schema, a_batch, checkpoint), checkpoint


def batches(stream, checkpoint):
    seen = []

    def write(batch, i):
        ids = sorted(r.id for r in batch.collect())
        seen.append((i, ids, batch.rdd.getNumPartitions()))

    streams.drained(lambda: stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).start(), stream.sparkSession)
    return seen


def test_ordered_table_steps_through_its_files_and_resumes(spark):
    path, checkpoint = shared_folder(spark, "ordered"), shared_folder(spark, "checkpoint")
    rows = spark.range(1000).withColumn("at", F.timestamp_seconds("id")).repartition(5)
    read = lambda *of: replay.read_ordered(spark, path, rows.schema, 3, *of)
    replay.write_ordered(rows, path, 12, "id")
    first = batches(read(checkpoint), checkpoint)
    assert len(first) >= 4 and all(n > 1 for _, _, n in first)
    assert [i for _, ids, _ in first for i in ids] == list(range(1000))
    assert batches(read(checkpoint), checkpoint) == []
    replay.write_ordered(rows.where("id < 400"), path, 6, "id")  # a later generation, though its ids are small
    more = batches(read(checkpoint), checkpoint)
    assert len(more) >= 2 and [i for _, ids, _ in more for i in ids] == list(range(400)) and more[0][0] == first[-1][0] + 1
    fresh = batches(read(), shared_folder(spark, "checkpoint"))
    assert len(fresh) == 1 and len(fresh[0][1]) == 1400
    assert [f.name for f in replay.OrderedTable({"path": path}).schema()] == ["id", "at"]


def wandering(seed: int, runs=("a", "b"), steps=300):
    """Losses that fall, rest and fall again, shuffled by up to half an hour; a row a minute."""
    r = random.Random(seed)
    rows = [(run, k, 1.0 / (1 + (k // 60) * 0.1) + r.random() * 0.3, (k // 60) / 10.0 if k % 60 == 0 else None, at(k), 60 * k + r.randint(0, 1800)) for run in runs for k in range(steps)]
    return rows + [("a", 10_000, 9.0, None, at(10_000), 10**6)]  # moves the watermark past all others


def test_shuffled_plateaus_equal_the_batch_and_alerts_follow(spark):
    rows = wandering(1)
    late = ("a", 3, 0.0, 1.0, at(3), 15_000)  # four hours behind: dropped
    stream, checkpoint = ordered(spark, [*rows, late], ROWS, 12, 2)
    out = streams.settled(streams.stream_plateau(stream, 25, "40 minutes", changes=False), mode="append", checkpoint=checkpoint)
    got = sorted((r.run_id, r.step, r.state == "plateau", r.counter) for r in out.collect())
    batch = telemetry.plateau_tracker(spark.createDataFrame(rows[:-1], ROWS), 25)
    assert got == sorted((r.run_id, r.step, r.is_plateau, r.counter) for r in batch.collect())

    alerts, expected = streams.stream_rate_limited_alert(streams.stream_plateau(stream, 25, "40 minutes", changes=False), 40), []
    checkpoint = shared_folder(spark, "checkpoint")
    for run in ("a", "b"):
        last, armed = 0, True
        for _, step, flat, _ in (g for g in got if g[0] == run):
            if armed and flat:
                last, armed = step, False
                expected.append((run, step))
            elif step - last > 40:
                armed = True
    assert len(expected) > 2
    assert sorted(map(tuple, streams.settled(alerts, mode="append", checkpoint=checkpoint).collect())) == expected


def test_values_in_force_equal_the_batch_whichever_comes_first(spark):
    r = random.Random(2)
    asked = [(run, k, f"row {k}", at(k), 60 * k + r.randint(0, 600)) for run in (1, 2) for k in range(200)] + [(1, 9000, "end", at(9000), 10**6)]
    said = [(run, k, r.choice(["lr", "decay"]), r.random(), at(k), 60 * k + r.randint(0, 3000)) for run in (1, 3) for k in range(5, 200, 7)] + [(1, 9000, "lr", 0.0, at(9000), 10**6)]
    metrics, checkpoint = ordered(spark, asked, "run_id long, step long, note string, wall_time timestamp, arrival long")
    changes, _ = ordered(spark, said, "run_id long, step long, param string, value double, wall_time timestamp, arrival long")
    out = streams.settled(streams.stream_with_config(metrics.drop("arrival"), changes.drop("arrival"), "1 hour"), mode="append", checkpoint=checkpoint)
    got = sorted((x.run_id, x.step, x.note, x.wall_time, sorted(x.config.items())) for x in out.collect())
    snaps, now = [], {}
    for run, step, param, value, *_ in sorted(said[:-1], key=lambda s: s[1]):
        now.setdefault(run, {})[param] = value
        snaps.append((run, step, dict(now[run])))
    snaps = spark.createDataFrame(snaps, "run_id long, step long, config map<string,double>")
    steps = spark.createDataFrame(asked[:-1], "run_id long, step long, note string, wall_time timestamp, arrival long")
    batch = registry.effective_config(steps, snaps).join(steps, ["run_id", "step"]).collect()
    assert got == sorted((x.run_id, x.step, x.note, x.wall_time, sorted((x.config or {}).items())) for x in batch)


def test_new_patches_of_a_batch_that_runs_again(spark):
    stream, checkpoint = ordered(spark, [(c, k) for k, c in enumerate("aabbbaacab" * 4)], "category string, arrival bigint")
    path = shared_folder(spark, "patches")
    streams.drained(lambda: streams.stream_new_patches(stream, path, checkpoint, 12), spark)
    schema = "category string, new_patches bigint, total bigint, ready boolean"
    last = spark.read.schema(schema).parquet(f"{path}/batch=3")
    assert {r.category: (r.total, r.ready) for r in last.collect()} == {"a": (20, True), "b": (16, True), "c": (4, False)}
    again = shared_folder(spark, "checkpoint")  # all four batches from the start, over the tables of the first run
    fresh = replay.read_ordered(spark, stream_path(checkpoint), stream.schema, 2, again)
    streams.drained(lambda: streams.stream_new_patches(fresh, path, again, 12), spark)
    assert {r.category: r.total for r in spark.read.schema(schema).parquet(f"{path}/batch=3").collect()} == {"a": 20, "b": 16, "c": 4}


def stream_path(checkpoint: str) -> str:
    """The ordered table that a query's first batch read."""
    import json
    from pathlib import Path

    return json.loads((Path(checkpoint.removeprefix("file://")) / "offsets" / "0").read_text().splitlines()[2])["path"]


@pytest.mark.parametrize("multiline", [True, False])
def test_broken_status_documents_give_no_row(spark, tmp_path, multiline):
    from loomframe.sources.documents import stream_status_documents

    good = '{"status": "running", "last_update": "2024-01-01T00:00:0%d", "category_stats": {"space": {"images_created": %d}}}'
    for k, text in enumerate([good % (3, 30), "{not json", good % (5, 50), good % (1, 10), "{}"]):
        (tmp_path / f"{k}.json").write_text(text)
    out = streams.settled(streams.stream_status(stream_status_documents(spark, str(tmp_path), 2, multiline)), ["category"])
    assert [(r.category, r.last_update, r.images_created) for r in out.collect()] == [("space", "2024-01-01T00:00:05", 50)]


@pytest.mark.parametrize("balance", [500.0, 1e9])
def test_values_in_force_after_changes_that_end_early_or_are_none(spark, tmp_path, balance):
    import duckdb

    from loomframe.plans import storage

    events, supplier = tmp_path / "events.parquet", tmp_path / "supplier.parquet"
    spark.range(60).selectExpr("id * 10000 AS event_id", "id % 3 AS user_id", "'view' AS event_type").write.parquet(str(events))
    spark.range(40).select(F.col("id").alias("s_suppkey"), (F.col("id") % 3).alias("s_nationkey"), F.lit(balance).alias("s_acctbal")).write.parquet(str(supplier))
    con = duckdb.connect()
    for name in ("events", "supplier"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    want = sorted(map(repr, con.execute(storage.X6).fetchall()))
    assert sorted(repr(tuple(r)) for r in storage.x6(spark, str(tmp_path)).collect()) == want


def test_rows_wait_in_blocks_and_due_rows_do_not_wait():
    """A state value is converted and sent by itself, so a batch's rows of a run are one, and what is due is none."""
    import pandas as pd

    class Held(list):
        def exists(self):
            return bool(self)

        def get(self):
            return iter(list(self))

        appendList = list.extend  # noqa: N815

        def put(self, values):
            self[:] = values

    class Timers(set):
        listTimers, deleteTimer, registerTimer = set.copy, set.remove, set.add  # noqa: N815

    class Steps(streams.InOrder):
        def waiting_rows(self, pdf):
            return pd.DataFrame({"at": streams.millis(pdf["t"]), "step": pdf["step"]})

        def take(self, key, rows):
            return rows

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms  # noqa: N815

    fold = Steps()
    fold.waiting, fold.handle = Held(), Timers()
    batch = lambda a, b: pd.DataFrame({"t": pd.to_datetime(range(a, b), unit="ms")[::-1], "step": range(b - 1, a - 1, -1)})
    give = lambda now, *of: [s for out in fold.handleInputRows(("r",), iter(of), Now(now)) for s in out["step"]]
    assert give(0, batch(1, 500), batch(500, 1000)) == [] and len(fold.waiting) == 1 and fold.handle == {1}
    assert give(0, batch(1000, 1500)) == [] and len(fold.waiting) == 2
    assert give(1700, batch(1500, 2000)) == list(range(1, 1701)) and len(fold.waiting) == 1 and fold.handle == {1701}
    assert [s for out in fold.handleExpiredTimer(("r",), Now(1999), None) for s in out["step"]] == list(range(1701, 2000))
    assert not fold.waiting and not fold.handle
    assert give(3000, batch(2500, 2600)) == list(range(2500, 2600)) and not fold.waiting
    assert len(give(30_000, batch(5000, 5 + 2 * streams.HELD + 5000))) == 2 * streams.HELD + 5
    assert give(0, batch(40_000, 40_001 + 2 * streams.HELD)) == [] and len(fold.waiting) == 3
