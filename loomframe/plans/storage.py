"""Queries of the sources, sinks and streams: they write what the tables give, read it back or stream it, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import columns, dims
from loomframe.operators import history, registry
from loomframe.plans import views
from loomframe.plans.monitoring import CROP, M5, WINDOW, stack_of, whole_windows
from loomframe.plans.views import sql, table
from loomframe.session import shared_folder
from loomframe.sources import documents, media, replay, tables
from loomframe.streaming import streams


def s2(spark, sf, part):
    """One configuration document for each video."""
    path = shared_folder(spark, "configs")
    v = views.videos(spark, sf)
    shares = F.create_map(F.lit("small_540"), F.lit("0.5"), F.lit("large_720"), F.lit('{"probability": 0.25}'))
    docs = v.select(
        F.array(F.struct("name", "path", "priority", "categories")).alias("videos"),
        F.create_map(F.lit("space"), shares).alias("format_config"),
        F.create_map(F.lit("space"), F.when(F.col("video_id") % 2 == 0, F.col("video_id").cast("string")).otherwise(F.concat(F.lit('{"target": '), F.col("video_id").cast("string"), F.lit("}")))).alias("category_targets"),
    )
    docs.write.json(path)
    return documents.read_generator_config(spark, path, multiline=False)[part]


def s3(spark, sf):
    path = shared_folder(spark, "status")
    e = table(spark, sf, "events")
    docs = e.select(
        F.lit("running").alias("status"),
        F.col("ts").cast("string").alias("last_update"),
        F.struct(F.lit(100).alias("total_videos"), F.pmod("event_id", F.lit(100)).cast("int").alias("completed_videos"), F.col("user_id").cast("int").alias("current_video_index")).alias("progress"),
        F.create_map("event_type", F.struct(F.lit(1).alias("videos_processed"), F.pmod("event_id", F.lit(50)).cast("int").alias("images_created"), F.lit(50).alias("target"))).alias("category_stats"),
    )
    docs.write.json(path)
    with open_junk(spark, path):
        got = documents.read_status(spark, path, multiline=False)["category_stats"]
    return got.groupBy("category").agg(F.count("*").alias("documents"), F.sum("images_created").alias("images"))


class open_junk:  # noqa: N801
    """A broken document beside the good ones."""

    def __init__(self, spark, path):
        spark.createDataFrame([("{not json",)], "value string").write.mode("append").text(path)

    def __enter__(self):
        return self

    def __exit__(self, *_):
        return False


#: A saved state's fields as SQL over a validation (step, quality, improvement, plateau, boost) that both engines read.
STATE = {
    "step_current": "step",
    "epoch_num": "CAST(step % 97 AS INT)",
    "step_max": "step + 100000",
    "epoch_step_current": "step % 1000",
    "epoch_step_total": "step * 0 + 1000",
    "total_loss_value": "quality + 1e0",
    "l1_loss_value": "quality + 2e0",
    "ms_loss_value": "quality + 3e0",
    "gradient_loss_value": "quality + 4e0",
    "perceptual_loss_value": "quality + 5e0",
    "l1_weight_current": "quality * 2e0",
    "ms_weight_current": "quality * 3e0",
    "gradient_weight_current": "quality * 4e0",
    "perceptual_weight_current": "quality * 5e0",
    "gradient_clip_val": "quality * 6e0",
    "adaptive_mode": "CASE WHEN boost THEN 'Aggressive' ELSE 'Stable' END",
    "adaptive_is_cooldown": "plateau % 2 = 0",
    "adaptive_cooldown_remaining": "CAST(plateau % 50 AS INT)",
    "adaptive_plateau_counter": "plateau",
    "adaptive_lr_boost_available": "boost",
    "adaptive_perceptual_trend": "CAST(plateau % 3 AS INT)",
    "learning_rate_value": "quality / 1000e0",
    "lr_phase_name": "CASE WHEN step < 100000 THEN 'warmup' ELSE 'cosine' END",
    "iteration_duration": "quality + 6e0",
    "vram_usage_gb": "quality + 7e0",
    "adam_momentum_avg": "quality + 8e0",
    "eta_total_formatted": "concat(CAST(step AS VARCHAR(20)), ' h')",
    "eta_epoch_formatted": "concat(CAST(plateau AS VARCHAR(20)), ' m')",
    "quality_lr_value": "quality - improvement",
    "quality_ki_value": "quality",
    "quality_improvement_value": "improvement",
    "quality_ki_to_gt_value": "quality - 1e0",
    "quality_lr_to_gt_value": "quality - improvement - 1e0",
    "validation_loss_value": "quality + 9e0",
    "best_quality_ever": "quality + 10e0",
    "training_active": "plateau % 5 > 0",
    "validation_running": "plateau % 7 = 0",
    "training_paused": "plateau % 5 = 0",
    "local_ip_address": "concat('192.0.2.', CAST(plateau % 250 AS VARCHAR(20)))",
    "tensorboard_port": "CAST(6006 + plateau % 10 AS INT)",
    "last_update_time": "CAST(step AS DOUBLE)",
}


def states(validations):
    """Saved states of ``validations`` (step, quality, improvement, plateau, boost)."""
    return validations.select(*[F.expr(e).alias(k) for k, e in STATE.items()], F.create_map(F.lit("Layer1"), F.col("quality")).alias("layer_activity_map"))


def validations(spark, sf):
    s = views.stats(spark, sf)
    return s.select("step", F.col("quality_ki").alias("quality"), "improvement", F.col("plateau_counter").alias("plateau"), F.col("boost_available").alias("boost"))


def statistics(spark, sf):
    """Saved statistics of each hundred validations, all runs together."""
    s = validations(spark, sf).withColumn("step", (F.floor((F.col("step") - 500) / 50000) * 50000).cast("bigint"))
    greatest = [F.max(c).alias(c) for c in ("plateau", "boost")]
    return states(s.groupBy("step").agg(*greatest, *[columns.round_double(F.max(c), 6).alias(c) for c in ("quality", "improvement")]))


FIELDS = ", ".join(f"{e} AS {k}" for k, e in STATE.items())
STATISTICS = "SELECT (step - 500) // 50000 * 50000 AS step, max(plateau_counter) AS plateau, max(boost_available::INT) = 1 AS boost, round(max(quality_ki), 6) AS quality, round(max(improvement), 6) AS improvement FROM stats GROUP BY 1"


def s4(spark, sf):
    path = shared_folder(spark, "statistics")
    tables.write_statistics(statistics(spark, sf), path)
    got = documents.read_statistics(spark, path, multiline=False)
    return got.select(*STATE, "file_step", F.element_at("layer_activity_map", "Layer1").alias("layer"))


def q5(spark, sf):
    path = shared_folder(spark, "history")
    s = statistics(spark, sf)
    history.export_history_csv(s, path)
    schema = history.flattened(s).withColumnRenamed("Layer1", "layer").schema
    return spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)


def s5(spark, sf):
    path = shared_folder(spark, "snapshots")
    views.snapshots(spark, sf).select("step", "timestamp", "config").write.json(path)
    open_junk(spark, path)
    got = documents.read_config_snapshots(spark, path, multiline=False)
    return got.select("step", "timestamp", F.size("config").alias("n"), F.try_element_at("config", F.lit("max_lr")).alias("max_lr"))


#: Fixed values. Messages of a training log, with their kinds; {s} is a step, {n} the same with leading zeros, {q} a quality.
MESSAGES = [
    ("start", "🚀 TRAINING STARTED"),
    ("validation", "Step {s} | Validation | KI Quality: {q}%"),
    ("best", "🏆 NEW BEST CHECKPOINT! (Step {s}, Quality {q}%)"),
    ("lr_boost", "⚡ LR BOOST triggered at step {s}"),
    ("completion", "✅ TRAINING COMPLETED"),
    ("interrupt", "⚠️  Training interrupted by user"),
    ("crash", "❌ Training crashed: interrupted after an emergency"),
    ("emergency", "⚠️  EMERGENCY CHECKPOINT SAVED (Step {s})"),
    ("checkpoint", "💾 Checkpoint saved: checkpoint_step_{n}.pth"),
    ("pause", "Training paused at step {s}"),
    ("other", "note"),
]


def s6(spark, sf):
    path = shared_folder(spark, "logs")
    c = views.checkpoints(spark, sf)
    parts = {"{s}": F.col("step").cast("string"), "{n}": F.format_string("%07d", "step"), "{q}": F.format_string("%.1f", columns.round_double(F.col("quality") * 100, 1))}
    message = F.element_at(F.array(*[F.lit(m) for _, m in MESSAGES]), (F.col("step") % len(MESSAGES) + 1).cast("int"))
    for mark, value in parts.items():
        message = F.replace(message, F.lit(mark), value)
    line = F.when(F.col("step") % 13 == 0, message).otherwise(F.concat(F.lit("["), F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), F.lit("] "), message))
    c.select(line.alias("value")).write.text(path)
    return documents.read_training_log(spark, path).groupBy("kind").agg(F.count("*").alias("lines"), F.count("ts").alias("timed"), F.sum("step").alias("steps"), columns.round_double(F.sum("quality"), 4).alias("quality"))


S6_KINDS = [k for k, _ in MESSAGES]
S6_STEPS = [i for i, (_, m) in enumerate(MESSAGES) if "{s}" in m or "{n}" in m]
S6_QUALITIES = [i for i, (_, m) in enumerate(MESSAGES) if "{q}" in m]
S6 = sql(
    f"""SELECT {S6_KINDS}[step % {len(MESSAGES)} + 1] AS kind, count(*) AS lines, count(*) FILTER (step % 13 <> 0) AS timed,
    sum(CASE WHEN step % {len(MESSAGES)} IN {tuple(S6_STEPS)} THEN step END)::BIGINT AS steps,
    round(sum(CASE WHEN step % {len(MESSAGES)} IN {tuple(S6_QUALITIES)} THEN round(quality * 100, 1) END), 4) AS quality FROM checkpoints GROUP BY 1""",
    "checkpoints",
)


def below(path, base):
    """A path as it is below the folder ``base``."""
    mark = base.rsplit("/", 1)[1] + "/"
    return F.substring_index(path, mark, -1)


#: Suffixes of the listing's files by document; some are no media files, case counts.
SUFFIXES = (".mkv", ".mp4", ".txt", ".avi", ".MKV", ".mov", ".mkv.part")


def s1(spark, sf):
    """Documents as named files, listed."""
    path = shared_folder(spark, "media")
    suffix = F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (F.pmod("doc_id", F.lit(len(SUFFIXES))) + 1).cast("int"))
    name = F.concat("lang", F.lit("/"), F.col("source"), F.lit("/{edition-x} "), F.col("doc_id").cast("string"), suffix)
    media.write_named(table(spark, sf, "documents").select(name.alias("path"), F.encode("text", "utf-8").alias("content")), path)
    found = documents.scan_media(spark, path, in_tasks=True)
    return found.select(below(F.col("path"), path).alias("path"), "name", below(F.col("folder"), path).alias("folder"), "length")


S1 = f"""SELECT lang || '/' || source || '/' || f AS path, f AS name, lang || '/' || source AS folder, length FROM (
SELECT lang, source, '{{edition-x}} ' || doc_id || {list(SUFFIXES)}[doc_id % {len(SUFFIXES)} + 1] AS f, strlen(text) AS length FROM documents) WHERE regexp_matches(f, '\\.(mkv|mp4|avi|mov)$')"""


def s7(spark, sf):
    """Embeddings as grey PNG files; every thirteenth file is broken."""
    path = shared_folder(spark, "pictures")
    e = table(spark, sf, "embeddings")
    image = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), views.bytes_of(F.col("embedding")).alias("data"))
    files = e.select(F.concat(F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), "vec_id", media.as_png(e, image).alias("png"))
    content = F.when(F.col("vec_id") % 13 == 0, F.encode(F.lit("no image"), "utf-8")).otherwise(F.col("png"))
    media.write_named(files.select("path", content.alias("content")), path)
    got = documents.read_images(spark, path, png_only=True)
    return got.select(below(F.col("origin"), path).alias("path"), "height", "width", "nChannels", F.lower(F.hex("data")).alias("px"))


S7 = """SELECT label || '/' || vec_id || '.png' AS path, CASE WHEN bad THEN -1 ELSE 8 END AS height, CASE WHEN bad THEN -1 ELSE 8 END AS width, CASE WHEN bad THEN -1 ELSE 1 END AS nChannels,
CASE WHEN bad THEN '' ELSE array_to_string(list_transform(embedding, lambda x: printf('%02x', floor(greatest(0, least(1, x::DOUBLE + 0.5)) * 255)::INT)), '') END AS px
FROM (SELECT *, vec_id % 13 = 0 AS bad FROM embeddings)"""


def s8_files(spark, sf):
    """The three files of every window, as the image decoder reads them back."""
    path = shared_folder(spark, "patches")
    video = F.col("video_id")
    category = F.when(video % 2 == 0, "space").otherwise("other")
    form = F.when(F.pmod("frame_idx", F.lit(2)) == 0, "small_540").otherwise("medium_169")
    windows = whole_windows(spark, sf).select("*", category.alias("category"), form.alias("format"), F.concat(F.lit("V: "), video.cast("string")).alias("name"))
    media.write_patch_files(windows, path, {"space": "Space/Own"})
    got = documents.read_images(spark, path, png_only=True)
    return got.select(below(F.col("origin"), path).alias("path"), "height", "width", F.lower(F.hex("data")).alias("px"))


S8_FILES = "p AS (SELECT *, CASE WHEN video_id % 2 = 0 THEN 'Space/Own/' ELSE 'Other/OtherModel/Learn/' END || CASE WHEN frame_idx % 2 = 0 THEN 'Patches' ELSE 'Patches_Medium169' END || '/' AS base, '/patch_V__' || video_id || '_idx' || frame_idx || CASE WHEN frame_idx % 2 = 0 THEN '' ELSE '_med169' END || '.png' AS name FROM w)"
S8_FILES = sql(
    f"SELECT base || 'GT' || name AS path, 6 AS height, 6 AS width, {CROP.format(y='y', x='x', more='', px='f[4]')} AS px FROM p"
    f" UNION ALL SELECT base || 'LR' || name, 10, 2, {stack_of(5)} FROM p UNION ALL SELECT base || 'LR_7frames' || name, 14, 2, {stack_of(7)} FROM p",
    "frames",
    recursive=f"{WINDOW}, {S8_FILES}",
)


def s8(spark, sf):
    path = shared_folder(spark, "patches")
    tables.write_patches(views.patches(spark, sf), path)
    got = spark.read.schema("video_id bigint, bytes bigint, idx int, category string, format string").parquet(path)
    return got.groupBy("category", "format").agg(F.count("*").alias("patches"), F.sum("bytes").alias("bytes"))


def s10(spark, sf):
    """Two appends, merged as the second comes."""
    path = shared_folder(spark, "metric-table")
    m = views.metrics(spark, sf)
    for tag in ("loss", "quality"):
        tables.append_metrics(m.withColumn("tag", F.lit(tag)), path, 2)
    return tables.read_metrics(spark, path, ["loss"]).select("run_id", "tag", "step", "value")


#: Where each field of a log record comes from.
RECORD = {
    "timestamp": None, "step": "step_current", "epoch": "epoch_num",
    "losses.total": "total_loss_value", "losses.l1": "l1_loss_value", "losses.ms": "ms_loss_value",
    "losses.gradient": "gradient_loss_value", "losses.perceptual": "perceptual_loss_value",
    "weights.l1": "l1_weight_current", "weights.ms": "ms_weight_current",
    "weights.gradient": "gradient_weight_current", "weights.perceptual": "perceptual_weight_current",
    "learning_rate": "learning_rate_value",
    "quality.lr": "quality_lr_value", "quality.ki": "quality_ki_value",
    "quality.improvement": "quality_improvement_value", "quality.best_ever": "best_quality_ever",
    "adaptive.mode": "adaptive_mode", "adaptive.cooldown": "adaptive_is_cooldown",
    "adaptive.plateau_counter": "adaptive_plateau_counter", "adaptive.gradient_clip": "gradient_clip_val",
    "performance.iteration_duration": "iteration_duration", "performance.vram_usage_gb": "vram_usage_gb",
    "performance.adam_momentum": "adam_momentum_avg",
}


def s11(spark, sf):
    s = states(validations(spark, sf))
    kinds = dict(s.dtypes)
    r = tables.export_log_record(s)
    return r.select(*[F.get_json_object("record", f"$.{k}").cast(kinds[c] if c else "string").alias(k.replace(".", "_")) for k, c in RECORD.items()])


S11_FIELDS = ", ".join(f"{STATE[c]} AS {k.replace('.', '_')}" for k, c in RECORD.items() if c)
S11 = sql(
    f"SELECT strftime(make_timestamp(step * 1000000), '%Y-%m-%dT%H:%M:%S.%gZ') AS timestamp, {S11_FIELDS} FROM (SELECT step, quality_ki AS quality, improvement, plateau_counter AS plateau, boost_available AS boost FROM stats)",
    "metrics",
    "stats",
)


BATCHES = 4


def replayed(spark, rows, order, end=None):
    """``rows`` as a stream of ``BATCHES`` micro-batches in their order, each read by as many tasks as there are cores, and
    the checkpoint of its query. The row of ``end``, if given, comes last and moves the watermark."""
    path, checkpoint = shared_folder(spark, "ordered"), shared_folder(spark, "checkpoint")
    tasks = max(2, spark.sparkContext.defaultParallelism)
    replay.write_ordered(rows, path, BATCHES * tasks - (end is not None), order)
    if end is not None:
        replay.write_ordered(end.select(rows.columns), path, 1, order)
    return replay.read_ordered(spark, path, rows.schema, tasks, checkpoint), checkpoint


#: Past every lateness: a row of this time after all others moves the watermark past them, and is never due itself.
LONG_AFTER = "INTERVAL 2 DAYS"


def x1(spark, sf):
    """Status documents of one event each: its own category's counts and those of all; one document is broken."""
    path = shared_folder(spark, "status")
    tasks = max(2, spark.sparkContext.defaultParallelism)
    e = table(spark, sf, "events").repartitionByRange(BATCHES * tasks - 1, "event_id")
    stats = lambda n: F.struct(F.lit(n).alias("videos_processed"), F.pmod("event_id", F.lit(50 * n)).cast("int").alias("images_created"), F.lit(50).alias("target"))
    docs = e.select(
        F.when(F.pmod("event_id", F.lit(2)) == 0, "running").otherwise("paused").alias("status"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("last_update"),
        F.struct(F.lit(100).alias("total_videos"), F.pmod("event_id", F.lit(100)).cast("int").alias("completed_videos")).alias("progress"),
        F.create_map("event_type", stats(1), F.lit("all"), stats(2)).alias("category_stats"),
    )
    docs.write.json(path)
    with open_junk(spark, path):
        stream = documents.stream_status_documents(spark, path, tasks, multiline=False)
        return streams.settled(streams.stream_status(stream), ["category"]).drop("disk_usage_gb")


X1 = """WITH d AS (SELECT event_type AS category, event_id, ts, 1 AS n FROM events UNION ALL SELECT 'all', event_id, ts, 2 FROM events)
SELECT category, strftime(max(ts), '%Y-%m-%dT%H:%M:%S.%f') AS last_update, arg_max(CASE WHEN event_id % 2 = 0 THEN 'running' ELSE 'paused' END, ts) AS status,
arg_max(n, ts) AS videos_processed, arg_max((event_id % (50 * n))::INT, ts) AS images_created, 50 AS target FROM d GROUP BY 1"""


def lines(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), F.col("l_orderkey").alias("video_id"))
    return replayed(spark, rows, "video_id")


def x2(spark, sf):
    stream, checkpoint = lines(spark, sf)
    return streams.settled(streams.stream_category_counts(stream), ["category"], checkpoint=checkpoint)


def events_by_time(spark, sf):
    e = table(spark, sf, "events")
    return e.select(views.run_of().alias("run_id"), "event_id", "value", F.col("ts").cast("timestamp").alias("wall_time"))


def x3(spark, sf):
    """A step is an hour, reported by every event in it; so a watermark of two hours suffices."""
    stream, checkpoint = replayed(spark, events_by_time(spark, sf), "wall_time")
    steps = stream.select("run_id", F.floor(F.unix_seconds("wall_time") / 3600).alias("step"), "wall_time")
    return streams.settled(streams.stream_once_per_step(steps, "2 hours"), mode="append", checkpoint=checkpoint).select("run_id", "step")


def plateaus(spark, sf, changes):
    """Events arrive up to an hour after their time, out of order, also from one micro-batch to the next."""
    e = events_by_time(spark, sf).withColumn("arrival", F.col("wall_time") + F.make_dt_interval(secs=F.pmod(F.xxhash64("event_id"), F.lit(3600)).cast("decimal(18,6)")))
    end = e.orderBy(F.col("wall_time").desc_nulls_last()).limit(1).withColumn("wall_time", F.col("wall_time") + F.expr(LONG_AFTER))
    stream, checkpoint = replayed(spark, e, "arrival", end)
    steps = stream.select("run_id", F.col("event_id").alias("step"), (F.col("value") / 10000).alias("loss"), (F.pmod("event_id", F.lit(97)) / 100.0).alias("quality"), "wall_time")
    return streams.stream_plateau(steps, 25, "2 hours", changes), checkpoint


def x4(spark, sf):
    out, checkpoint = plateaus(spark, sf, True)
    return streams.settled(out, mode="append", checkpoint=checkpoint).select("run_id", "step", "state", "counter")


X4_METRICS = f"metrics AS (SELECT {views.RUN} AS run_id, row_number() OVER (PARTITION BY {views.RUN} ORDER BY event_id) - 1 AS step, value / 10000 AS value, event_id FROM events)"
X4 = f"WITH RECURSIVE {X4_METRICS}, {M5} SELECT run_id, event_id AS step, CASE WHEN now THEN 'plateau' ELSE 'progress' END AS state, counter FROM (SELECT *, counter >= 25 AS now, coalesce(lag(counter >= 25) OVER (PARTITION BY run_id ORDER BY step), false) AS was FROM f) JOIN metrics USING (run_id, step) WHERE now <> was"
X5 = f"""WITH RECURSIVE {X4_METRICS}, {M5}, p AS MATERIALIZED (SELECT run_id, event_id, counter >= 25 AS plateau FROM f JOIN metrics USING (run_id, step)),
a AS (SELECT run_id, min(event_id) AS step FROM p WHERE plateau GROUP BY 1 UNION ALL
  SELECT a.run_id, (SELECT min(p.event_id) FROM p WHERE p.plateau AND p.run_id = a.run_id AND p.event_id > (SELECT min(q.event_id) FROM p q WHERE q.run_id = a.run_id AND q.event_id > a.step + 1000)) AS step FROM a WHERE a.step IS NOT NULL)
SELECT * FROM a WHERE step IS NOT NULL"""


def x5(spark, sf):
    out, checkpoint = plateaus(spark, sf, False)
    return streams.settled(streams.stream_rate_limited_alert(out), mode="append", checkpoint=checkpoint)


def second(step):
    """The time of a step. The first is not at the epoch, where watermarks begin."""
    return F.timestamp_seconds(step + 86400)


def configs(spark, sf):
    """Accepted changes of two parameters by run and step."""
    s = table(spark, sf, "supplier")
    changes = s.select(F.col("s_suppkey").alias("change_id"), F.when(F.col("s_suppkey") % 2 == 0, "max_lr").otherwise("min_lr").alias("param"), (F.abs("s_acctbal") / 1e7).alias("value"))
    said = registry.validate_params(changes, {}, dims.param_rules(spark)).where("accepted")
    keys = s.select(F.col("s_suppkey").alias("change_id"), F.col("s_nationkey").cast("bigint").alias("run_id"), (F.col("s_suppkey") * 50).cast("bigint").alias("step"))
    return said.join(keys, "change_id").select("run_id", "step", "param", "value", second(F.col("step")).alias("wall_time"))


def x6(spark, sf):
    """A step is a second. The changes come as a stream of their own. Both end at one time, after the last row of either, in
    a run of its own: the watermark is that of the slower, also where one ends long before the other or has no row."""
    rows = table(spark, sf, "events").select(F.pmod("user_id", F.lit(25)).alias("run_id"), F.col("event_id").alias("step"), "event_type", second(F.col("event_id")).alias("wall_time"))
    said = configs(spark, sf)
    last = rows.select("wall_time").unionByName(said.select("wall_time")).agg((F.max("wall_time") + F.expr(LONG_AFTER)).alias("wall_time")).where("wall_time is not null")
    end = last.selectExpr("-1L AS run_id", "0L AS step", "wall_time", "'end' AS event_type", "'end' AS param", "0D AS value")
    changes, _ = replayed(spark, said, "wall_time", end)
    metrics, checkpoint = replayed(spark, rows, "wall_time", end)
    out = streams.settled(streams.stream_with_config(metrics, changes, "10 minutes"), mode="append", checkpoint=checkpoint)
    return out.select("run_id", F.col("step").alias("event_id"), "event_type", *[F.try_element_at("config", F.lit(p)).alias(p) for p in ("max_lr", "min_lr")])


X6 = """WITH c AS (SELECT s_nationkey AS run_id, CASE WHEN s_suppkey % 2 = 0 THEN 'max_lr' ELSE 'min_lr' END AS param, s_suppkey * 50 AS step, abs(s_acctbal) / 1e7 AS value FROM supplier),
a AS (SELECT * FROM c WHERE CASE param WHEN 'max_lr' THEN value BETWEEN 1e-5 AND 1e-3 ELSE value BETWEEN 1e-8 AND 1e-4 END),
e AS (SELECT user_id % 25 AS run_id, event_id, event_type FROM events)
SELECT e.run_id, e.event_id, e.event_type, x.value AS max_lr, n.value AS min_lr
FROM e ASOF LEFT JOIN (SELECT * FROM a WHERE param = 'max_lr') x ON x.run_id = e.run_id AND e.event_id >= x.step
ASOF LEFT JOIN (SELECT * FROM a WHERE param = 'min_lr') n ON n.run_id = e.run_id AND e.event_id >= n.step"""


def x7(spark, sf):
    path = shared_folder(spark, "new-patches")
    stream, checkpoint = lines(spark, sf)
    streams.drained(lambda: streams.stream_new_patches(stream, path, checkpoint, 20_000), spark)
    got = spark.read.schema("category string, new_patches bigint, total bigint, ready boolean").option("recursiveFileLookup", True).parquet(path)
    return got.groupBy("category").agg(F.sum("new_patches").alias("new_patches"), F.max("total").alias("total"), F.max("ready").alias("ready"))


def x8(spark, sf):
    stream, checkpoint = replayed(spark, events_by_time(spark, sf), "wall_time")
    rows = stream.select("run_id", F.lit("loss").alias("tag"), F.col("event_id").alias("step"), "value", "wall_time")
    out = streams.settled(streams.stream_metric_rollup(rows, 1000), ["run_id", "tag", "bucket", "since"], checkpoint=checkpoint)
    return out.withColumns({"mean": columns.round_double(F.col("mean"), 6), "since": F.date_format("since", "yyyy-MM-dd")})


QUERIES = {
    "s1_scan_media": (s1, S1),
    "s7_read_images": (s7, S7),
    "s8_patch_files": (s8_files, S8_FILES),
    "s2_generator_config_videos": (lambda s, d: s2(s, d, "videos").select("name", "path", "priority", F.size("categories").alias("n")), sql("SELECT name, path, priority, len(cats)::INT AS n FROM videos", "videos")),
    "s2_generator_config_formats": (lambda s, d: s2(s, d, "formats").groupBy("category", "format").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")), "SELECT 'space' AS category, f AS format, count(*) AS n, count(*) * CASE f WHEN 'small_540' THEN 0.5 ELSE 0.25 END::DOUBLE AS weight FROM documents, (VALUES ('small_540'), ('large_720')) t(f) GROUP BY f"),
    "s2_generator_config_targets": (lambda s, d: s2(s, d, "targets"), "SELECT 'space' AS category, doc_id AS target FROM documents"),
    "s3_generator_status": (s3, "SELECT event_type AS category, count(*) AS documents, sum(event_id % 50)::BIGINT AS images FROM events GROUP BY 1"),
    "s4_s9_statistics": (s4, sql(f"SELECT {FIELDS}, step AS file_step, quality AS layer FROM ({STATISTICS})", "metrics", "stats")),
    "s5_config_snapshots": (s5, "SELECT c_custkey AS step, c_custkey::DOUBLE AS timestamp, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END::INT AS n, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 5) / 1e4 END AS max_lr FROM customer"),
    "s6_training_log": (s6, S6),
    "s8_write_patches": (s8, sql("SELECT category, format, count(*) AS patches, sum(bytes)::BIGINT AS bytes FROM patches GROUP BY 1, 2", "patches")),
    "s10_metric_table": (s10, sql("SELECT run_id, tag, step, value FROM metrics", "metrics")),
    "s11_export_log_record": (s11, S11),
    "q5_export_history_csv": (q5, sql(f"SELECT {FIELDS}, quality AS layer FROM ({STATISTICS})", "metrics", "stats")),
    "x1_stream_status": (x1, X1),
    "x2_stream_category_counts": (x2, "SELECT l_returnflag AS category, count(*) AS images FROM lineitem GROUP BY 1"),
    "x3_stream_once_per_step": (x3, f"SELECT DISTINCT {views.RUN} AS run_id, epoch_us(ts) // 3600000000 AS step FROM events"),
    "x4_stream_plateau": (x4, X4),
    "x5_stream_rate_limited_alert": (x5, X5),
    "x6_stream_with_config": (x6, X6),
    "x7_stream_new_patches": (x7, "SELECT l_returnflag AS category, count(*) AS new_patches, count(*) AS total, count(*) >= 20000 AS ready FROM lineitem GROUP BY 1"),
    "x8_stream_metric_rollup": (x8, f"SELECT {views.RUN} AS run_id, 'loss' AS tag, event_id // 1000 * 1000 AS bucket, strftime(ts, '%Y-%m-%d') AS since, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, arg_max(value, event_id) AS last, count(*) AS n FROM events GROUP BY ALL"),
}
