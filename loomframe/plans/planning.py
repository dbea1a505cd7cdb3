"""Queries of the catalogue, sampling, pairing, progress, registry and history operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomframe.functions import columns, dims
from loomframe.operators import catalog, history, pairing, progress, registry, sampling
from loomframe.plans import views
from loomframe.plans.views import sql, table

DRAW = "('0x' || substr(md5(concat_ws('|', {0})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
WORDS = {"space": ["widget", "bolt"], "toon": ["gear", "red"]}
RULES = [("widget", 1.0), ("bolt", 0.5), ("red", 0.25)]
OVERRIDES = {"en": "English/Own/Learn"}
VALUES = lambda rows: ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in r) + ")" for r in rows)


def titles(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_name", F.concat(F.lit("/media/"), "p_brand").alias("folder"))


def c2(spark, sf):
    m = catalog.categorize(titles(spark, sf), "p_name", "folder", WORDS).select("p_partkey", "categories")
    return m.select("p_partkey", *[F.try_element_at("categories", F.lit(k)).alias(k) for k in ("general", "space", "toon")])


def c6(spark, sf):
    v = views.videos(spark, sf)
    return catalog.availability(v, v.join(table(spark, sf, "labels").select(F.col("doc_id").alias("video_id")), "video_id", "left_semi"))


def c7(spark, sf):
    extra = table(spark, sf, "region").select(F.col("r_name").alias("category"))
    known = extra.sparkSession.createDataFrame([("space",), ("toon",), ("en",)], "category string")
    return catalog.resolve_category_path(extra.unionByName(known), OVERRIDES)


def c8(spark, sf):
    return catalog.output_layout(table(spark, sf, "documents").select(F.col("lang").alias("category")), "/data", OVERRIDES)


def c10(spark, sf):
    rate = F.when(F.col("p_size") % 7 == 0, F.lit("25/0")).when(F.col("p_size") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.col("p_size").cast("string"), F.lit("000/1001")))
    df = table(spark, sf, "part").select("p_partkey", rate.alias("avg_frame_rate"), F.when(F.col("p_size") % 11 == 0, F.lit("?")).otherwise(F.col("p_retailprice").cast("string")).alias("duration"))
    out = catalog.probe_defaults(df)
    return out.select("p_partkey", columns.round_double(F.col("fps"), 9).alias("fps"), "seconds")


def grid(spark, sf):
    return sampling.sample_grid(views.videos(spark, sf), 30)


GRID = "SELECT video_id, duration, unnest(range(CASE WHEN round(cat_sum * 30, 9) >= 1 THEN floor(cat_sum * 30)::INT ELSE 0 END))::INT AS frame_idx FROM videos"
GRID = f"SELECT *, fmod(frame_idx * duration / 30, nullif(duration, 0)) AS ts FROM ({GRID})"
TRIES = "SELECT video_id, frame_idx, duration, unnest(range(4))::INT AS attempt, ts AS t0 FROM grid"
TRIES = f"SELECT video_id, frame_idx, attempt, duration, fmod(t0 + attempt * 60.0::DOUBLE, nullif(duration, 0)) AS ts FROM ({TRIES})"


def p4(spark, sf):
    tries = sampling.retry_candidates(grid(spark, sf), 4).withColumn("accepted", F.pmod(F.floor("ts").cast("bigint") + F.col("video_id"), F.lit(3)) == 0)
    return sampling.first_accepted(tries, 4).withColumn("ts", columns.round_double(F.col("ts"), 6))


def p5(spark, sf):
    f = views.frames(spark, sf)
    starts = f.select("video_id", F.col("frame_no").alias("frame_idx"), F.col("frame_no").alias("start_frame"))
    w = sampling.frame_window(starts, f, 7, 10, (8, 8))
    return w.select("video_id", "frame_idx", F.element_at("frame_nos", -1).alias("last_frame"), F.size("images").alias("n_images"))


def p8(spark, sf):
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("video_id"))
    return sampling.readiness(views.weighted_videos(spark, sf), done, 300)


def formats_of(spark):
    return dims.category_formats(spark, {"R": {"small_540": 0.5, "medium_169": 0.35, "large_720": 0.15}, "A": {"small_540": 0.65, "medium_169": 0.35}})


def p9(spark, sf):
    s = views.patches(spark, sf).select("video_id", F.col("idx").alias("frame_idx"), "category").distinct()
    return sampling.choose_format(s, formats_of(spark), 5)


def p10(spark, sf):
    s = views.patches(spark, sf).select("video_id", "idx").distinct()
    f = dims.formats(spark).where("format = 'medium_169'")
    return sampling.crop_offsets(s.crossJoin(F.broadcast(f.select("gt_h", "gt_w"))), 5, ("video_id", "idx")).select("video_id", "idx", "crop_y", "crop_x")


def p11(spark, sf):
    v = views.videos(spark, sf)
    return v.select("video_id", columns.patch_name(columns.clean_title(F.col("name")), F.pmod("video_id", F.lit(9)), F.lit("_large")).alias("filename"))


def p12(spark, sf):
    v = views.patches(spark, sf).select("video_id", "idx").distinct()
    done = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("video_id"))
    return sampling.pending_work(v, done, ["video_id"])


def targets(spark, sf):
    return table(spark, sf, "region").select(F.col("r_name").alias("category"), (F.col("r_regionkey") * 100).cast("bigint").alias("target")).unionByName(spark.createDataFrame([("A", 20000), ("R", 10)], "category string, target bigint"))


TARGETS = "SELECT r_name AS category, (r_regionkey * 100)::BIGINT AS target FROM region UNION ALL VALUES ('A', 20000), ('R', 10)"
COUNTS = f"""SELECT coalesce(m.category, t.category) AS category, coalesce(images, 0) AS images, coalesce(videos, 0) AS videos, coalesce(target, 0) AS target
  FROM (SELECT category, count(*) AS images, count(DISTINCT video_id) AS videos FROM patches GROUP BY 1) m FULL JOIN ({TARGETS}) t ON m.category = t.category"""


def a2(spark, sf):
    out = progress.category_progress(progress.category_counts(views.patches(spark, sf), targets(spark, sf)), 50.0)
    return out.select("category", columns.round_double(F.col("percent"), 6).alias("percent"), columns.round_double(F.col("rate"), 6).alias("rate"), columns.round_double(F.col("eta"), 6).alias("eta"), "status")


def a3(spark, sf):
    c = views.checkpoints(spark, sf).select((F.pmod("step", F.lit(3)) > 0).alias("completed"), F.pmod("step", F.lit(11)).alias("extractions"), (F.pmod("step", F.lit(11)) + F.pmod("step", F.lit(2))).alias("attempts"))
    out = progress.overall_progress(c, 3600.0)
    return out.select("total", "completed", "extractions", "attempts", *[columns.round_double(F.col(x), 6).alias(x) for x in ("percent", "seconds_a_video", "eta", "extraction_rate", "success_rate")])


def entries_of(spark, sf):
    e = table(spark, sf, "events")
    word = F.when(F.col("event_id") % 3 == 0, "completed").when(F.col("event_id") % 3 == 1, "in_progress").otherwise("failed")
    return e.select(F.col("event_id").alias("video"), F.when(F.col("event_id") % 2 == 0, word).otherwise(F.to_json(F.struct(word.alias("status"), F.col("props")))).alias("entry"))


def a7(spark, sf):
    e = table(spark, sf, "events")
    status = e.groupBy(F.col("event_type").alias("run_id")).agg(F.max("user_id").alias("current_video_index"))
    done = e.groupBy(F.col("event_type").alias("run_id"), F.col("user_id").alias("video_index")).agg(F.max("event_id").alias("last_frame_idx"), F.count("*").alias("n"))
    return progress.resume_point(status, done.withColumn("status", F.when(F.col("n") % 2 == 1, "in_progress").otherwise("completed")))


def k4(spark, sf):
    c = views.checkpoints(spark, sf)
    snaps = views.snapshots(spark, sf).select("step", "config")
    out = registry.checkpoint_registry(c.select("filename", "bytes", "timestamp"), c.select("step", "quality", "loss"), snaps)
    return out.select("filename", "step", "type", "quality", "loss", "size_mb", "has_config_snapshot", "max_lr")


def k5(spark, sf):
    c = views.checkpoints(spark, sf)
    return registry.best_history(c.select((F.col("custkey") % 7).alias("run_id"), "step", "quality"))


def k7(spark, sf):
    c = views.checkpoints(spark, sf)
    files = c.select(F.when(F.col("step") % 10 == 0, "active_run").otherwise("checkpoints").alias("folder"), F.when(F.col("step") % 7 == 0, F.concat("filename", F.lit(".BAK"))).when(F.col("step") % 5 == 0, F.concat("filename", F.lit(".log"))).otherwise(F.col("filename")).alias("filename"))
    links = c.where("step % 21 = 0").select(F.concat(F.lit("link_"), "filename").alias("filename"), F.col("filename").alias("target"))
    return registry.cleanup_plan(files, links)


def k8(spark, sf):
    params = [r[0] for r in dims.PARAM_RULES]
    w = table(spark, sf, "events")
    name = F.element_at(F.array(*[F.lit(p) for p in params]), (F.pmod("event_id", F.lit(len(params))) + 1).cast("int"))
    changes = w.select(F.col("event_id").alias("change_id"), name.alias("param"), columns.round_double(F.col("value") / F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(500.0), 6).alias("value"))
    current = {"l1_weight_target": 0.6, "ms_weight_target": 0.2, "grad_weight_target": 0.2}
    return registry.validate_params(changes, current, dims.param_rules(spark))


PARAMS = ", ".join(f"'{r[0]}'" for r in dims.PARAM_RULES)
K8 = f"""WITH rules(param, class, lo, hi) AS (VALUES {VALUES(dims.PARAM_RULES)}), changes AS (
  SELECT event_id AS change_id, [{PARAMS}][event_id % {len(dims.PARAM_RULES)} + 1] AS param, round(value / CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 500.0 END::DOUBLE, 6) AS value FROM events),
t AS (SELECT c.*, r.class, r.lo, r.hi,
  0.0::DOUBLE + CASE WHEN c.param = 'l1_weight_target' THEN value ELSE 0.6::DOUBLE END + CASE WHEN c.param = 'ms_weight_target' THEN value ELSE 0.2::DOUBLE END
  + CASE WHEN c.param = 'grad_weight_target' THEN value ELSE 0.2::DOUBLE END + CASE WHEN c.param = 'perceptual_weight_target' THEN value ELSE 0.0::DOUBLE END AS total FROM changes c LEFT JOIN rules r ON c.param = r.param),
f AS (SELECT change_id, param, value, CASE WHEN class = 'startup' THEN 'startup only' WHEN class IS NOT NULL AND NOT value BETWEEN lo AND hi THEN 'out of range'
  WHEN param LIKE '%_weight_target' AND NOT total BETWEEN 0.95::DOUBLE AND 1.05::DOUBLE THEN 'weights do not sum to 1' END AS reason FROM t)
SELECT *, reason IS NULL AS accepted FROM f"""


def user_configs(spark, sf):
    c = table(spark, sf, "customer")
    keys = ["LR_EXPONENT", "WEIGHT_DECAY", "MAX_STEPS", "OTHER"]
    key = F.element_at(F.array(*[F.lit(k) for k in keys]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.create_map(key, F.col("c_mktsegment"))).alias("config"))


def k13(spark, sf):
    merged = registry.merge_defaults(user_configs(spark, sf))
    return merged.select("c_custkey", F.size("config").alias("n"), F.element_at("config", "MAX_STEPS").alias("max_steps"), F.try_element_at("config", F.lit("OTHER")).alias("other"))


def k13b(spark, sf):
    return registry.required_fields(user_configs(spark, sf)).select("c_custkey", F.array_join("missing", ",").alias("missing"), "valid")


USER = "SELECT c_custkey, CASE WHEN c_custkey % 9 > 0 THEN ['LR_EXPONENT', 'WEIGHT_DECAY', 'MAX_STEPS', 'OTHER'][c_custkey % 4 + 1] END AS key, c_mktsegment AS value FROM customer"


def k14(spark, sf):
    snaps = registry.entries(views.snapshots(spark, sf))
    m = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("run_id"), F.when(F.col("s_suppkey") % 2 == 0, "loss").otherwise("quality").alias("tag"), F.col("s_suppkey").alias("step"), F.col("s_acctbal").alias("value"))
    return registry.hparam_table(snaps, m, ["BUILDING", "max_lr"], ["loss", "quality"])


K14 = sql("""SELECT e.run_id, arg_max(value, step) FILTER (param = 'BUILDING') AS "BUILDING", arg_max(value, step) FILTER (param = 'max_lr') AS max_lr, any_value(loss) AS loss, any_value(quality) AS quality
FROM entries e LEFT JOIN (SELECT s_nationkey AS run_id, arg_max(s_acctbal, s_suppkey) FILTER (s_suppkey % 2 = 0) AS loss, arg_max(s_acctbal, s_suppkey) FILTER (s_suppkey % 2 = 1) AS quality FROM supplier GROUP BY 1) m ON e.run_id = m.run_id GROUP BY 1""", "entries")

CLEAN = r"trim(regexp_replace(regexp_replace(name, '\.[^.]*$', ''), '\{edition-[^}]+\}', '', 'g'))"

def a5(spark, sf):
    """The target of a category is the number of orders with its status; R has none."""
    targets = table(spark, sf, "orders").groupBy(F.translate("o_orderstatus", "FOP", "ANX").alias("category")).agg(F.count("*").alias("target"))
    return progress.progress_rollup(views.patches(spark, sf), targets)


A5 = sql("""SELECT CASE WHEN grouping(category) = 1 THEN 'TOTAL' ELSE category END AS category, CASE WHEN grouping(category) = 0 THEN max(coalesce(videos, 0)) END AS videos,
sum(coalesce(images, 0))::BIGINT AS images, sum(coalesce(target, 0))::BIGINT AS target, CASE WHEN sum(coalesce(target, 0)) > 0 THEN sum(coalesce(images, 0)) / sum(coalesce(target, 0))::DOUBLE * 100 ELSE 0 END AS percent, sum(coalesce(bytes, 0))::BIGINT AS bytes
FROM (SELECT category, count(DISTINCT video_id) AS videos, count(*) AS images, sum(bytes) AS bytes FROM patches GROUP BY 1)
FULL JOIN (SELECT translate(o_orderstatus, 'FOP', 'ANX') AS category, count(*) AS target FROM orders GROUP BY 1) USING (category) GROUP BY ROLLUP (category)""", "patches")


FORMAT_NAMES = sorted(f[0] for f in dims.FORMATS)


def j5(spark, sf):
    """Shapes from the line items: of all formats and an unknown one, some with a wrong side, some unreadable."""
    chosen = F.element_at(F.array(*[F.lit(n) for n in [*FORMAT_NAMES, "unknown"]]), (F.col("l_partkey") % (len(FORMAT_NAMES) + 1) + 1).cast("int"))
    rows = table(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("filename"), chosen.alias("format"), "l_suppkey", "l_orderkey")
    known = dims.formats(spark)
    side = lambda c: F.coalesce(c, F.lit(1))
    kind = F.col("l_suppkey") % 10
    pairs = rows.join(F.broadcast(known), "format", "left").select(
        "filename",
        "format",
        F.when(F.col("l_orderkey") % 13 == 0, -1).otherwise(side("gt_h")).alias("gt_height"),
        F.when(kind == 1, side("lr_w")).otherwise(side("gt_w")).alias("gt_width"),
        F.when(kind == 2, side("lr_h")).otherwise(side("lr_h") * 5).alias("lr_height"),
        side("lr_w").alias("lr_width"),
    )
    return pairing.shape_check(pairs, known)


J5 = f"""WITH f AS (SELECT * FROM (VALUES {VALUES([r[:5] for r in dims.FORMATS])}) t(format, gt_h, gt_w, lr_h, lr_w)),
r AS (SELECT l_orderkey || '-' || l_linenumber AS filename, [{", ".join(repr(n) for n in [*FORMAT_NAMES, "unknown"])}][l_partkey % {len(FORMAT_NAMES) + 1} + 1] AS format, l_suppkey % 10 AS kind, l_orderkey % 13 = 0 AS broken FROM lineitem),
p AS (SELECT filename, r.format, CASE WHEN broken THEN 'corrupt' WHEN gt_h IS NULL THEN 'unknown format' WHEN kind = 1 AND lr_w <> gt_w THEN 'gt shape' WHEN kind = 2 THEN 'lr shape' END AS problem FROM r LEFT JOIN f USING (format))
SELECT * FROM p WHERE problem IS NOT NULL"""


QUERIES = {
    "c1_clean_title": (lambda s, d: views.videos(s, d).select("video_id", columns.clean_title(F.col("name")).alias("title")), sql(f"SELECT video_id, {CLEAN} AS title FROM videos", "videos")),
    "c2_categorize": (c2, """WITH t AS (SELECT p_partkey, regexp_matches(lower(p_name), 'widget|bolt') OR regexp_matches(lower('/media/' || p_brand), 'widget|bolt') AS s, regexp_matches(lower(p_name), 'gear|red') OR regexp_matches(lower('/media/' || p_brand), 'gear|red') AS t FROM part)
SELECT p_partkey, CASE WHEN s AND t THEN 0.3 WHEN s OR t THEN NULL ELSE 1.0 END::DOUBLE AS general, CASE WHEN s AND t THEN 0.4 WHEN s THEN 1.0 END::DOUBLE AS space, CASE WHEN s AND t THEN 0.3 WHEN s THEN NULL WHEN t THEN 1.0 END::DOUBLE AS toon FROM t"""),
    "c3_processing_order": (lambda s, d: catalog.processing_order(views.videos(s, d).select("video_id", "priority"), 7), sql(f"SELECT video_id, coalesce(priority, 255) AS priority, row_number() OVER (ORDER BY coalesce(priority, 255), {DRAW.format('7, video_id')}, video_id) AS position FROM videos", "videos")),
    "c4_priority_histogram": (lambda s, d: catalog.priority_histogram(views.videos(s, d), 3), sql("""SELECT CASE WHEN k <= 3 THEN priority END AS priority, sum(n)::BIGINT AS videos FROM (SELECT *, row_number() OVER (ORDER BY priority <> 255, priority) AS k FROM (SELECT coalesce(priority, 255) AS priority, count(*) AS n FROM videos GROUP BY 1)) GROUP BY 1""", "videos")),
    "c5_category_distribution": (lambda s, d: catalog.category_distribution(views.videos(s, d)), sql("SELECT category, count(*) AS videos FROM (SELECT unnest(cats) AS category FROM videos) GROUP BY 1", "videos")),
    "c6_availability": (c6, sql("""SELECT *, CASE WHEN found = 0 THEN 'none' WHEN missing > total * 0.5 THEN 'majority_missing' WHEN missing > 0 THEN 'partial' ELSE 'complete' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (there) AS found, count(*) FILTER (NOT there) AS missing FROM (SELECT video_id IN (SELECT doc_id FROM labels) AS there FROM videos))""", "videos")),
    "c7_resolve_category_path": (c7, """WITH c AS (SELECT r_name AS category FROM region UNION ALL VALUES ('space'), ('toon'), ('en'))
SELECT category, CASE category WHEN 'en' THEN 'English/Own/Learn' WHEN 'space' THEN 'Space/SpaceModel/Learn' WHEN 'toon' THEN 'Toon/ToonModel/Learn' ELSE upper(category[1]) || lower(category[2:]) || '/' || upper(category[1]) || lower(category[2:]) || 'Model/Learn' END AS base_path FROM c"""),
    "c8_output_layout": (c8, f"""WITH c AS (SELECT DISTINCT lang AS category, CASE lang WHEN 'en' THEN 'English/Own/Learn' ELSE upper(lang[1]) || lower(lang[2:]) || '/' || upper(lang[1]) || lower(lang[2:]) || 'Model/Learn' END AS p FROM documents),
f(output_dir) AS (VALUES {VALUES([(r[5],) for r in dims.FORMATS])})
SELECT DISTINCT category, unnest(['/data/' || p || '/' || output_dir || '/GT', '/data/' || p || '/' || output_dir || '/LR', '/data/' || p || '/' || output_dir || '/LR_7frames', '/data/' || p || '/Val/GT', '/data/' || p || '/Val/LR']) AS directory FROM c, f"""),
    "c9_first_match_weight": (lambda s, d: titles(s, d).select("p_partkey", columns.first_match_weight(F.col("p_name"), RULES).alias("weight")), "SELECT p_partkey, CASE WHEN contains(lower(p_name), 'widget') THEN 1.0 WHEN contains(lower(p_name), 'bolt') THEN 0.5 WHEN contains(lower(p_name), 'red') THEN 0.25 ELSE 0.1 END::DOUBLE AS weight FROM part"),
    "c10_probe_defaults": (c10, """WITH t AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 OR p_size % 5 = 0 THEN NULL ELSE p_size * 1000 / 1001.0::DOUBLE END AS fps, CASE WHEN p_size % 11 = 0 THEN NULL ELSE p_retailprice END AS seconds FROM part)
SELECT p_partkey, round(CASE WHEN fps IS NULL OR seconds IS NULL THEN 23.976::DOUBLE ELSE fps END, 9) AS fps, CASE WHEN fps IS NULL OR seconds IS NULL THEN 3600.0::DOUBLE ELSE seconds END AS seconds FROM t"""),
    "p1_extraction_quota": (lambda s, d: sampling.extraction_quota(views.videos(s, d), 30).select("video_id", "quota"), sql("SELECT video_id, floor(cat_sum * 30)::INT AS quota FROM videos", "videos")),
    "p2_sample_grid": (lambda s, d: grid(s, d).select("video_id", "frame_idx", columns.round_double(F.col("ts"), 6).alias("ts")), sql(f"SELECT video_id, frame_idx, round(ts, 6) AS ts FROM ({GRID})", "videos")),
    "p3_retry_candidates": (lambda s, d: sampling.retry_candidates(grid(s, d), 4).select("video_id", "frame_idx", "attempt", columns.round_double(F.col("ts"), 6).alias("ts")), sql("", "videos") + f", grid AS ({GRID}) SELECT video_id, frame_idx, attempt, round(ts, 6) AS ts FROM ({TRIES})"),
    "p4_first_accepted": (p4, sql("", "videos") + f""", grid AS ({GRID}), t AS (SELECT *, (floor(ts)::BIGINT + video_id) % 3 = 0 AS ok FROM ({TRIES}))
SELECT video_id, frame_idx, coalesce(bool_or(ok), false) AS success, coalesce(min(attempt) FILTER (ok) + 1, 4) AS attempts, round(arg_min(ts, attempt) FILTER (ok), 6) AS ts FROM t GROUP BY 1, 2"""),
    "p5_frame_window": (p5, sql("SELECT a.video_id, a.frame_no AS frame_idx, max(b.frame_no) AS last_frame, count(*)::INT AS n_images FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_no BETWEEN a.frame_no AND a.frame_no + 6 GROUP BY 1, 2 HAVING count(*) = 7", "frames")),
    "p6_val_train_plan": (lambda s, d: sampling.val_train_plan(views.weighted_videos(s, d), 300).withColumn("ts", columns.round_double(F.col("ts"), 6)), sql("""SELECT video_id, 'Val' AS split, i::INT AS i, round(duration * 0.2::DOUBLE + i * (duration * 0.6::DOUBLE / n_val), 6) AS ts FROM (SELECT *, unnest(range(n_val)) AS i FROM limits)
UNION ALL SELECT video_id, 'Patches', i::INT, round(i * (duration / "limit"), 6) FROM (SELECT *, unnest(range(n_train)) AS i FROM limits)""", "videos", "weighted_videos", "limits")),
    "p7_weighted_interleave": (lambda s, d: sampling.weighted_interleave(views.weighted_videos(s, d), 300), sql("""SELECT video_id, i, i // chunk AS round, row_number() OVER (ORDER BY i // chunk, weight DESC, name, video_id, i) - 1 AS position FROM (SELECT *, unnest(range(n_train))::INT AS i FROM limits)""", "videos", "weighted_videos", "limits")),
    "p8_readiness": (p8, sql("SELECT *, done >= needed AS ready FROM (SELECT sum(n_val + least(chunk, n_train))::BIGINT AS needed, (SELECT count(*) FROM labels) AS done FROM limits)", "videos", "weighted_videos", "limits")),
    "p9_choose_format": (p9, sql(f"""SELECT video_id, frame_idx, category, CASE category WHEN 'R' THEN CASE WHEN d < 0.5 THEN 'small_540' WHEN d < 0.85 THEN 'medium_169' ELSE 'large_720' END WHEN 'A' THEN CASE WHEN d < 0.65 THEN 'small_540' ELSE 'medium_169' END ELSE 'small_540' END AS format
FROM (SELECT DISTINCT video_id, idx AS frame_idx, category, {DRAW.format('5, video_id, idx, category')} AS d FROM patches)""", "patches")),
    "p10_crop_offsets": (p10, sql(f"SELECT DISTINCT video_id, idx, floor({DRAW.format(chr(39) + '5' + chr(39) + ', ' + chr(39) + 'y' + chr(39) + ', video_id, idx')} * 676)::INT AS crop_y, floor({DRAW.format(chr(39) + '5' + chr(39) + ', ' + chr(39) + 'x' + chr(39) + ', video_id, idx')} * 1201)::INT AS crop_x FROM patches", "patches")),
    "p11_patch_name": (p11, sql(f"SELECT video_id, 'patch_' || regexp_replace({CLEAN}, '[^a-zA-Z0-9]', '_', 'g') || '_idx' || (video_id % 9) || '_large.png' AS filename FROM videos", "videos")),
    "p12_pending_work": (p12, sql("SELECT DISTINCT video_id, idx FROM patches WHERE video_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')", "patches")),
    "j1_pair_train": (lambda s, d: pairing.pair_train(views.names(s, d)[0], views.names(s, d)[1]), sql("SELECT filename FROM gt JOIN val_lr USING (filename)", "gt", "val_lr")),
    "j2_pair_val": (lambda s, d: pairing.pair_val(*views.names(s, d)), sql("SELECT * FROM pairs", "gt", "val_lr", "patch_lr", "pairs")),
    "j3_pairing_report": (lambda s, d: pairing.pairing_report(*views.names(s, d)), sql("SELECT count(*) AS found, count(*) FILTER (origin = 'Val') AS from_val, count(*) FILTER (origin = 'Patches') AS from_patches, count(*) FILTER (origin IS NULL) AS skipped, count(origin) AS loaded FROM pairs", "gt", "val_lr", "patch_lr", "pairs")),
    "j3_skipped_sample": (lambda s, d: pairing.skipped_sample(*views.names(s, d)), sql("SELECT filename FROM pairs WHERE origin IS NULL ORDER BY 1 LIMIT 15", "gt", "val_lr", "patch_lr", "pairs")),
    "j4_orphan_lr": (lambda s, d: pairing.orphan_lr(*views.names(s, d)[:2]), sql("SELECT filename FROM val_lr WHERE filename NOT IN (SELECT filename FROM gt)", "gt", "val_lr")),
    "a1_category_counts": (lambda s, d: progress.category_counts(views.patches(s, d), targets(s, d)), sql(COUNTS, "patches")),
    "a2_category_progress": (a2, sql(f"""SELECT category, round(CASE WHEN target > 0 THEN images / target * 100 ELSE 0 END::DOUBLE, 6) AS percent, round(images / 50.0::DOUBLE, 6) AS rate, round(CASE WHEN target - images <= 0 THEN 0 WHEN images > 0 THEN (target - images) / (images / 50.0::DOUBLE) END::DOUBLE, 6) AS eta,
CASE WHEN target - images <= 0 THEN 'Complete' WHEN images > 0 THEN 'Running' ELSE 'Calculating' END AS status FROM ({COUNTS})""", "patches")),
    "a3_overall_progress": (a3, """WITH t AS (SELECT count(*) AS total, count(*) FILTER (o_orderkey % 3 > 0) AS completed, sum(o_orderkey % 11)::BIGINT AS extractions, sum(o_orderkey % 11 + o_orderkey % 2)::BIGINT AS attempts FROM orders)
SELECT *, round(completed * 100.0::DOUBLE / total, 6) AS percent, round(3600.0::DOUBLE / completed, 6) AS seconds_a_video, round(3600.0::DOUBLE / completed * (total - completed), 6) AS eta, round(extractions / 3600.0::DOUBLE, 6) AS extraction_rate, round(extractions * 100.0::DOUBLE / attempts, 6) AS success_rate FROM t"""),
    "a4_storage_by_category": (lambda s, d: progress.storage_by_category(views.patches(s, d).withColumn("bytes", F.col("bytes") * 1000)), sql("SELECT category, grouping(category)::TINYINT AS is_total, round(sum(bytes * 1000) / 1073741824.0::DOUBLE, 2) AS gib FROM patches GROUP BY ROLLUP (category)", "patches")),
    "a5_progress_rollup": (a5, A5),
    "j5_shape_check": (j5, J5),
    "a6_checkpoint_status_counts": (lambda s, d: progress.checkpoint_status_counts(entries_of(s, d)), "SELECT count(*) AS entries, count(*) FILTER (event_id % 3 = 0) AS completed, count(*) FILTER (event_id % 3 = 1) AS in_progress FROM events"),
    "a7_resume_point": (a7, """WITH s AS (SELECT event_type AS run_id, max(user_id) AS current_video_index FROM events GROUP BY 1)
SELECT s.*, coalesce((SELECT max(event_id) FROM events e WHERE e.event_type = s.run_id AND e.user_id = s.current_video_index HAVING count(*) % 2 = 1), 0) AS last_frame_idx FROM s"""),
    "k1_parse_checkpoint_step": (lambda s, d: views.checkpoints(s, d).select("filename", columns.checkpoint_step(F.col("filename")).alias("parsed")), sql("SELECT filename, step AS parsed FROM checkpoints", "checkpoints")),
    "k2_checkpoint_type": (lambda s, d: views.checkpoints(s, d).select("filename", columns.checkpoint_type(F.col("filename"), F.col("step")).alias("type")), sql("SELECT filename, CASE WHEN o_orderstatus = 'F' THEN 'emergency' WHEN step % 10000 = 0 AND step > 0 THEN 'regular' ELSE 'best' END AS type FROM checkpoints", "checkpoints")),
    "k3_latest_checkpoint": (lambda s, d: registry.latest_checkpoint(views.checkpoints(s, d)), sql("SELECT filename, step FROM checkpoints ORDER BY step DESC, filename DESC LIMIT 1", "checkpoints")),
    "k4_checkpoint_registry": (k4, sql("""SELECT filename, c.step, CASE WHEN o_orderstatus = 'F' THEN 'emergency' WHEN c.step % 10000 = 0 AND c.step > 0 THEN 'regular' ELSE 'best' END AS type, quality, loss, bytes / 1048576.0::DOUBLE AS size_mb, c_custkey IS NOT NULL AS has_config_snapshot, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 5) / 1e4 END AS max_lr
FROM checkpoints c LEFT JOIN customer ON c_custkey = c.step""", "checkpoints")),
    "k5_best_history": (k5, sql("""SELECT run_id, step, quality, previous_best FROM (SELECT custkey % 7 AS run_id, step, quality, coalesce(max(quality) OVER (PARTITION BY custkey % 7 ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS previous_best FROM checkpoints WHERE step % 10000 BETWEEN 2000 AND 8000) WHERE quality > previous_best""", "checkpoints")),
    "k6_checkpoint_due": (lambda s, d: registry.checkpoint_due(views.checkpoints(s, d).select("step")), sql("SELECT step, step % 10000 = 0 AND step > 0 AS regular, step % 10000 BETWEEN 2000 AND 8000 AS best_check, step % 25000 = 0 AS milestone FROM checkpoints", "checkpoints")),
    "k7_cleanup_plan": (k7, sql("""SELECT folder, filename, CASE WHEN folder = 'active_run' THEN 'reset' WHEN filename LIKE '%.BAK' THEN 'keep' WHEN filename LIKE '%.pth' THEN 'back up and remove' ELSE 'remove' END AS action
FROM (SELECT CASE WHEN step % 10 = 0 THEN 'active_run' ELSE 'checkpoints' END AS folder, filename || CASE WHEN step % 7 = 0 THEN '.BAK' WHEN step % 5 = 0 THEN '.log' ELSE '' END AS filename FROM checkpoints)
UNION ALL SELECT 'checkpoints', 'link_' || filename, 'unlink' FROM checkpoints WHERE step % 21 = 0""", "checkpoints")),
    "k8_validate_params": (k8, K8),
    "k9_snapshot_list": (lambda s, d: registry.snapshot_list(views.snapshots(s, d)).drop("timestamp"), "SELECT c_nationkey AS run_id, c_custkey AS step, printf('runtime_config_step_%07d.json', c_custkey) AS file, NULL::DOUBLE AS plateau_safety_threshold, CASE WHEN c_custkey % 3 = 0 THEN (c_custkey % 5) / 1e4 END AS max_lr, NULL::DOUBLE AS l1_weight_target FROM customer"),
    "k10_snapshot_diff": (lambda s, d: registry.snapshot_diff(views.snapshots(s, d).withColumn("run_id", F.lit(0)), 6, 9), sql("""SELECT 0 AS run_id, param, o.value AS "old", n.value AS "new", count(*) OVER () AS changes FROM (SELECT * FROM entries WHERE step = 6) o FULL JOIN (SELECT * FROM entries WHERE step = 9) n USING (param) WHERE o.value IS DISTINCT FROM n.value""", "entries")),
    "k11_effective_config": (lambda s, d: registry.effective_config(views.snapshots(s, d).select("run_id", (F.col("step") + 3).alias("step")), views.snapshots(s, d)).select("run_id", "step", "config_step", F.size("config").alias("n")), """WITH s AS (SELECT c_nationkey AS run_id, c_custkey AS step FROM customer)
SELECT a.run_id, a.step + 3 AS step, b.step AS config_step, CASE WHEN b.step IS NULL THEN NULL WHEN b.step % 3 = 0 THEN 2 ELSE 1 END::INT AS n FROM s a ASOF LEFT JOIN s b ON a.run_id = b.run_id AND a.step + 3 >= b.step"""),
    "k12_config_changes": (lambda s, d: registry.config_changes(views.snapshots(s, d)), sql("""SELECT run_id, step, param, "old", value AS "new" FROM (SELECT *, lag(value) OVER w AS "old", row_number() OVER w AS nth FROM entries WINDOW w AS (PARTITION BY run_id, param ORDER BY step)) WHERE nth > 1 AND "old" IS DISTINCT FROM value""", "entries")),
    "k13_merge_defaults": (k13, f"SELECT c_custkey, CASE WHEN key = 'OTHER' THEN 11 ELSE 10 END::INT AS n, CASE WHEN key = 'MAX_STEPS' THEN value ELSE '100000' END AS max_steps, CASE WHEN key = 'OTHER' THEN value END AS other FROM ({USER})"),
    "k13_required_fields": (k13b, f"SELECT c_custkey, array_to_string(list_filter(['LR_EXPONENT', 'WEIGHT_DECAY', 'MAX_STEPS', 'VAL_STEP_EVERY', 'SAVE_STEP_EVERY', 'LOG_TBOARD_EVERY'], lambda x: x IS DISTINCT FROM key), ',') AS missing, false AS valid FROM ({USER})"),
    "k14_hparam_table": (k14, K14),
    "q1_improvement_history": (lambda s, d: history.improvement_history(views.stats(s, d)).select("run_id", "step", columns.round_double(F.col("improvement_pct"), 9).alias("improvement_pct"), columns.round_double(F.col("quality_pct"), 9).alias("quality_pct")), sql("SELECT run_id, step, round(improvement * 100, 9) AS improvement_pct, round(quality_ki * 100, 9) AS quality_pct FROM stats", "metrics", "stats")),
    "q2_best_quality_step": (lambda s, d: history.best_quality_step(views.stats(s, d)), sql("SELECT run_id, arg_max(step, struct_pack(q := quality_ki, s := -step)) AS step, max(quality_ki) AS quality_ki FROM stats GROUP BY 1", "metrics", "stats")),
    "q3_plateau_report": (lambda s, d: history.plateau_report(views.stats(s, d)), sql("SELECT run_id, step, plateau_counter, CASE WHEN boost_available THEN 'boost ready' ELSE 'cooling down' END AS boost FROM stats WHERE plateau_counter > 300", "metrics", "stats")),
    "q4_compare_runs": (lambda s, d: history.compare_runs(views.stats(s, d), "click-0", "view-0").select("step", *[columns.round_double(F.col(c), 9).alias(c) for c in ("improvement_1", "improvement_2", "difference")]), sql("SELECT step, round(a.improvement * 100, 9) AS improvement_1, round(b.improvement * 100, 9) AS improvement_2, round(b.improvement * 100 - a.improvement * 100, 9) AS difference FROM stats a JOIN stats b USING (step) WHERE a.run_id = 'click-0' AND b.run_id = 'view-0'", "metrics", "stats")),
}
