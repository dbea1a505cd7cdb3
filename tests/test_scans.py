"""Scans by ranges against loops, on keys that spread over several ranges."""

from __future__ import annotations

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from loomframe.functions import columns
from loomframe.functions.ranks import placed
from loomframe.operators import registry, scans, telemetry
from loomframe.operators.folds import SlidingQuantile

METRICS = "run_id string, tag string, step long, value double"


def sides(seed: int):
    r = random.Random(seed)
    runs = ["long"] * 400 + ["b"] * 15 + [None] * 30 + ["only left"] * 3
    left = [(run, r.randint(0, 500), float(k)) for k, run in enumerate(runs)]
    right = [(run, r.randint(0, 500), r.random()) for run in ["long"] * 300 + [None] * 10 + ["b"] * 2 + ["only right"]]
    return left, right


@pytest.mark.parametrize("forward", [False, True])
def test_asof_merges(spark, forward):
    left, right = sides(1)
    a, b = spark.createDataFrame(left, "run_id string, step long, val double"), spark.createDataFrame(right, "run_id string, step long, value double")
    out = scans.asof(a, b, ("run_id",), "step", F.struct("step", "value"), "f", forward, F.col("value"))
    got = sorted((str(r.run_id), r.step, r.val, tuple(r.f) if r.f else None) for r in out.collect())
    want = []
    for run, step, val in left:
        known = [(s, v) for u, s, v in right if u == run and (s >= step if forward else s <= step)]
        best = (min(known, key=lambda x: (x[0], -x[1])) if forward else max(known)) if known else None
        want.append((str(run), step, val, best))
    assert got == sorted(want)


def test_a_run_spreads_over_tasks_without_frames_that_look_ahead(spark):
    n = 20_000
    val = spark.range(n).select(F.lit("one").alias("run_id"), (F.col("id") * 5).alias("step"), F.rand(1).alias("value"))
    metrics = spark.range(n).select(F.lit("one").alias("run_id"), (F.col("id") * 7 + 1).alias("step"), F.rand(2).alias("value"))
    out = telemetry.delayed_snapshot(val, metrics)
    assert "unboundedfollowing" not in out._jdf.queryExecution().toString().lower()
    assert out.where("metric_step <> ceil((val_step + 1) / 7D) * 7 + 1").count() == 0
    assert out.where("metric_step is null").count() == val.where(F.col("step") + 2 > (n - 1) * 7 + 1).count()
    assert scans.ranges(val, ("run_id", "step"), scans.tasks(val))[0].select(F.input_file_name()).distinct().count() == 8


def test_config_in_force_keeps_maps_and_nulls(spark):
    snaps = spark.createDataFrame([(1, 5, {"a": 1.0}), (1, 9, {}), (None, 2, {"a": 3.0})], "run_id long, step long, config map<string,double>")
    steps = spark.createDataFrame([(1, 4), (1, 5), (1, 100), (None, 2), (2, 7)], "run_id long, step long")
    got = {(r.run_id, r.step): (r.config_step, r.config) for r in registry.effective_config(steps, snaps).collect()}
    assert got == {(1, 4): (None, None), (1, 5): (5, {"a": 1.0}), (1, 100): (9, {}), (None, 2): (2, {"a": 3.0}), (2, 7): (None, None)}


@pytest.mark.parametrize("start", ["first", "zero"])
def test_exponential_means_of_long_short_and_broken_series(spark, start):
    r = random.Random(3)
    rows = [("long", "x", k, None if k % 50 == 7 else r.random()) for k in range(5000)]
    rows += [("late", "x", k, None if k < 3000 else float(k)) for k in range(3200)] + [(None, "x", 0, 2.0), (None, "x", 1, 4.0), ("none", "x", 0, None)]
    rows += [(f"s{i}", t, k, r.random()) for i in range(20) for t in ("x", "y") for k in range(3)]
    got = {(x.run_id, x.tag, x.step): x.ema for x in telemetry.ema(spark.createDataFrame(rows, METRICS).repartition(7), 0.2, start).collect()}
    assert len(got) == len(rows)
    y, last = None, None
    for run, tag, step, value in sorted(rows, key=lambda x: (str(x[0]), x[1], x[2])):
        if (run, tag) != last:
            y, last = (0.0 if start == "zero" else None), (run, tag)
        if value is not None:
            y = value if y is None else 0.2 * value + 0.8 * y
        found = got[run, tag, step]
        assert (found is None) == (y is None) and (y is None or math.isclose(found, y, rel_tol=1e-11, abs_tol=1e-300)), (run, tag, step)


def broken_series():
    """Rows of METRICS: a long series, short ones, one without a run, and nulls and values that are not finite."""
    r = random.Random(11)
    odd = {700: math.nan, 1500: math.inf, 1510: -math.inf, 2500: -math.inf, 9000: 1e12}
    rows = [("long", "x", 3 * k, odd.get(k, None if r.random() < 0.1 or 4000 <= k < 4300 else r.random())) for k in range(9500)]
    rows += [("none", "x", k, None) for k in range(150)] + [("flat", "x", k, 5.0) for k in range(130)]
    rows += [(None, t, k, r.gauss(1e3, 1)) for t in ("x", "y") for k in range(250)]
    return rows + [(f"s{i}", "x", k, float(k)) for i in range(20) for k in range(i + 1)]


def by_series(rows):
    out = {}
    for run, tag, step, value in rows:
        out.setdefault((run, tag), []).append((step, value))
    return {k: sorted(v) for k, v in out.items()}


def same(found, want, digits=1e-9):
    if found is None or want is None or math.isnan(found) or math.isnan(want):
        return (found is None) == (want is None) and (found is None or math.isnan(found) == math.isnan(want))
    return math.isclose(found, want, rel_tol=digits, abs_tol=1e-12)


def mean(values):
    known = [v for v in values if v is not None]
    return (sum(known) if any(map(math.isinf, known)) else math.fsum(known)) / len(known) if known else None


@pytest.mark.parametrize("n", [1, 2, 20, 5000])
def test_means_of_the_last_rows(spark, n):
    rows = broken_series()
    df = spark.createDataFrame(rows, METRICS).repartition(7).withColumn("place", F.lit("kept"))
    got = {(x.run_id, x.tag, x.step): (x.place, x.rolling_mean) for x in telemetry.rolling_mean(df, n).collect()}
    assert len(got) == len(rows)
    for key, values in by_series(rows).items():
        for k in range(0, len(values), 1 if n <= 20 else 97):
            place, found = got[*key, values[k][0]]
            assert place == "kept" and same(found, mean([v for _, v in values[max(0, k - n + 1) : k + 1]])), (key, k)


def test_trends_of_the_last_rows(spark):
    rows = broken_series()
    df = spark.createDataFrame(rows, METRICS)
    got = {(x.run_id, x.tag, x.step): x.trend for x in telemetry.trend_pct(df, ("run_id", "tag")).collect()}
    assert len(got) == len(rows)
    for key, values in by_series(rows).items():
        for k, (step, _) in enumerate(values):
            want = 0.0
            if k >= 19:
                now, old = mean([v for _, v in values[k - 9 : k + 1]]), mean([v for _, v in values[k - 19 : k - 9]])
                want = None if now is None or old is None else (now - old) / (old + 1e-8) * 100
            assert same(got[*key, step], want, 1e-8), (key, k)


def test_slopes_of_the_last_rows(spark):
    rows = broken_series()
    out = telemetry.convergence(spark.createDataFrame(rows, METRICS)).collect()
    got = {(x.run_id, x.tag, x.step): x.slope for x in out}
    assert len(got) == len(out) == len(rows)
    for key, values in by_series(rows).items():
        for k, (step, _) in enumerate(values):
            known = [(i, v) for i, (_, v) in enumerate(values[k - 99 : k + 1]) if v is not None] if k >= 99 else []
            want = None
            if len(known) > 1 and not all(math.isfinite(v) for _, v in known):
                want = math.nan
            elif len(known) > 1:
                mx, my = mean([i for i, _ in known]), mean([v for _, v in known])
                want = math.fsum((i - mx) * (v - my) for i, v in known) / math.fsum((i - mx) ** 2 for i, _ in known)
            assert same(got[*key, step], want), (key, k)


def test_a_series_spreads_over_tasks_for_its_last_rows(spark):
    n = 200_000
    df = spark.range(n).select(F.lit("one").alias("run_id"), F.lit("x").alias("tag"), "id", (F.col("id") * 2.0).alias("value")).withColumnRenamed("id", "step")
    out = telemetry.convergence(df)
    assert out.where("step >= 99").agg(F.max(F.abs(F.col("slope") - 2.0))).first()[0] < 1e-9
    assert out.groupBy(F.spark_partition_id()).count().count() == 8


@pytest.mark.parametrize(("q", "n"), [(0.95, 500), (0.5, 7), (0.0, 3), (1.0, 4), (0.95, 1)])
def test_sliding_quantile(q, n):
    r = random.Random(n)
    values = [None if r.random() < 0.1 else float(r.choice([r.random(), 0.5, r.randint(0, 3)])) for _ in range(3000)]
    slide = SlidingQuantile(q, n)
    for k, v in enumerate(values):
        slide.add(v)
        known = sorted(x for x in values[max(0, k - n + 1) : k + 1] if x is not None)
        if not known:
            assert slide.value() is None
            continue
        at = (len(known) - 1) * q
        lower, upper = known[math.floor(at)], known[math.ceil(at)]
        assert math.isclose(slide.value(), lower + (at - math.floor(at)) * (upper - lower), rel_tol=1e-12)


def test_places_inside_keys(spark):
    rows = spark.createDataFrame([("a" if k % 3 else "b", (k * 37) % 500) for k in range(500)], "k string, o long")
    got = sorted((r.k, r.o, r.place) for r in placed(rows.repartition(9), "k", "o").collect())
    want = [(k, o, i) for k in "ab" for i, o in enumerate(sorted((j * 37) % 500 for j in range(500) if ("a" if j % 3 else "b") == k))]
    assert got == sorted(want)
    assert placed(rows.where("false"), "k", "o").collect() == []


def test_windows_of_frames_over_block_edges(spark):
    from loomframe.operators.sampling import frame_window

    frames = [(v, k, 100 if (v, k) != (1, 70) else 5, 8, 8, f"{v}/{k}") for v in (1, 2) for k in range(200)] + [(3, 10, 100, 8, 8, "dup")] + [(3, k, 100, 8, 8, f"3/{k}") for k in range(10, 17)]
    frames = spark.createDataFrame(frames, "video_id long, frame_no int, bytes int, height int, width int, image string")
    samples = [(v, 10 * k, k) for v in (1, 2, 4) for k in range(-3, 200)] + [(2, 7, 5), (3, 1, 10), (1, 3, None)]
    got = sorted(map(str, frame_window(spark.createDataFrame(samples, "video_id long, frame_idx long, start_frame long"), frames, 7, 10, (8, 8)).collect()))
    want = [(v, i, list(range(k, k + 7)), [f"{v}/{j}" for j in range(k, k + 7)]) for v, i, k in samples if v in (1, 2) and k is not None and 0 <= k <= 193 and not (v == 1 and k <= 70 <= k + 6)]
    assert got == sorted(f"Row(video_id={v}, frame_idx={i}, frame_nos={n}, images={m})" for v, i, n, m in want)


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from loomframe.session import shared_folder

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, applicationId="a"))
    assert shared_folder(session("local[2]"), "x").startswith("file:///")
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError, match="checkpoint.dir"):
            shared_folder(session(master), "x")


def test_a_ratio_over_a_loss_of_zero(spark):
    val = [("r", 0, 0.5), ("r", 2, 0.5), ("r", 4, 0.0), ("r", 6, -0.5), ("r", 8, 0.5), ("r", 10, 0.5), ("r", 12, None)]
    train = [("r", 1, 0.0), ("r", 7, -0.0), ("r", 9, 0.25), ("r", 11, 0.0)]
    schema = "run_id string, step long, value double"
    out = telemetry.val_train_ratio(spark.createDataFrame(val, schema), spark.createDataFrame(train, schema)).collect()
    got = {r.step: "nan" if r.ratio is not None and math.isnan(r.ratio) else r.ratio for r in out}
    assert got == {0: None, 2: math.inf, 4: "nan", 6: -math.inf, 8: -math.inf, 10: 2.0, 12: None}


def test_a_ratio_beside_a_half_is_rounded_as_in_the_sql(spark, tmp_path):
    """53.23 over 51.2 and the like lie at a half of the last digit, which their quotients in floating point just miss."""
    vals = [50.03, 53.23, 54.43, 54.93, 25.89, 26.49, 53.13, 3.23, 109.31, 12.5]
    rows = []
    for user, val in enumerate(vals):  # the validation at step 10 is the third row, the training loss at step 10 the fourth
        rows += [(4 * user + k, f"2024-01-01 00:00:0{k}", 150 * user, "view", v) for k, v in enumerate((1.0, 2.0, val, 51.2))]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double")
    folder = f"{tmp_path}/events.parquet"
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(folder)
    got = {(r.run_id, r.step): r.ratio for r in contract.queries()["m27_val_train_ratio"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/*.parquet')")
    want = {(r[0], r[1]): r[4] for r in con.execute(contract.oracle_sql()["m27_val_train_ratio"]).fetchall()}
    assert len(got) == 4 * len(vals)
    assert got == want


def test_doubles_are_rounded_as_duckdb_rounds_them(spark):
    halves = [(k + 0.5) / 1e9 for k in (0, 3, 127148437, 1039648437, 56021 * 10**9)]
    near = [math.nextafter(h, way) for h in halves for way in (0, math.inf)]
    odd = [0.0, -0.0, 5e-324, 1e15 / 3, 1.7e308, math.inf, math.nan]
    xs = [s * x for x in [*halves, *near, *odd] for s in (1, -1)] + [None]
    for places in (5, 9):
        got = spark.createDataFrame([(x,) for x in xs], "x double").select(columns.round_double(F.col("x"), places).alias("r")).collect()
        want = [duckdb.execute("SELECT round(?::DOUBLE, ?)", [x, places]).fetchone()[0] for x in xs]
        assert [repr(r.r) for r in got] == [repr(w) for w in want]
