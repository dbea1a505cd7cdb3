"""Queries of the telemetry and image operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomframe.functions import columns
from loomframe.operators import images, telemetry
from loomframe.plans import views
from loomframe.plans.views import sql

SHAPE = (1, 8, 8)
LAYERS = 7


def rounded(df, *cols, places: int = 9):
    kinds = dict(df.dtypes)
    return df.withColumns({c: columns.round_double(F.col(c), places) if kinds[c] == "double" else F.round(c, places) for c in cols})


def series(spark, sf):
    return views.metrics(spark, sf).select("run_id", "tag", "step", "value")


def losses(spark, sf):
    return views.metrics(spark, sf).select("run_id", "step", F.col("value").alias("loss"), (F.pmod("event_id", F.lit(97)) / 100.0).alias("quality"))


def m5(spark, sf):
    out = telemetry.plateau_tracker(losses(spark, sf), 25, 80)
    return rounded(out.select("run_id", "step", "best_loss", "best_quality", "ema_loss", "ema_quality", "counter", "is_plateau", "steps_until_reset"), "best_loss", "best_quality", "ema_loss", "ema_quality")


M5 = """l AS MATERIALIZED (SELECT run_id, step, value AS loss, (event_id % 97) / 100.0::DOUBLE AS quality FROM metrics),
f AS (SELECT run_id, step, loss AS best_loss, quality AS best_quality, loss AS ema_loss, quality AS ema_quality, 0.0::DOUBLE AS counter FROM l WHERE step = 0
  UNION ALL
  SELECT run_id, step, CASE WHEN reset THEN least(best_loss, loss) ELSE best_loss END, CASE WHEN reset THEN greatest(best_quality, quality) ELSE best_quality END, el, eq,
    CASE WHEN reset THEN 0.0 WHEN counter > 0 AND (loss < best_loss * 1.002::DOUBLE OR quality > best_quality * 0.999::DOUBLE) THEN greatest(0, counter - 0.5::DOUBLE) ELSE counter + 1 END
  FROM (SELECT *, loss < best_loss * s OR quality > best_quality * 1.001::DOUBLE OR (el < best_loss * (s + 0.001::DOUBLE) AND eq > best_quality * 0.9995::DOUBLE) AS reset FROM (
    SELECT l.run_id, l.step, l.loss, l.quality, f.best_loss, f.best_quality, f.counter, 0.1::DOUBLE * l.loss + 0.9::DOUBLE * f.ema_loss AS el, 0.1::DOUBLE * l.quality + 0.9::DOUBLE * f.ema_quality AS eq,
      CASE WHEN l.loss < 0.015 THEN 0.999 WHEN l.loss < 0.02 THEN 0.998 WHEN l.loss < 0.03 THEN 0.997 WHEN l.loss < 0.05 THEN 0.995 ELSE 0.997 END::DOUBLE AS s
    FROM f JOIN l ON l.run_id = f.run_id AND l.step = f.step + 1)))"""
EMA = "e AS (SELECT run_id, tag, step, value, value AS ema FROM metrics WHERE step = 0 UNION ALL SELECT m.run_id, m.tag, m.step, m.value, 0.1::DOUBLE * m.value + 0.9::DOUBLE * e.ema FROM e JOIN metrics m ON m.run_id = e.run_id AND m.step = e.step + 1)"
CLIP = """p AS MATERIALIZED (SELECT *, CASE WHEN step >= 99 THEN quantile_cont(value, 0.95) OVER (PARTITION BY run_id ORDER BY step ROWS 499 PRECEDING) END AS p95 FROM metrics),
e AS (SELECT run_id, tag, step, value, p95, 1.5::DOUBLE AS clip FROM p WHERE step = 0 UNION ALL SELECT p.run_id, p.tag, p.step, p.value, p.p95, CASE WHEN p.p95 IS NULL THEN e.clip ELSE 0.9::DOUBLE * e.clip + 0.1::DOUBLE * p.p95 END FROM e JOIN p ON p.run_id = e.run_id AND p.step = e.step + 1)"""
SLOPE = "SELECT run_id, tag, step, value, CASE WHEN step >= 99 THEN regr_slope(value, step) OVER (PARTITION BY run_id ORDER BY step ROWS 99 PRECEDING) END AS slope FROM metrics"
STATUS = "CASE WHEN slope IS NULL THEN 'warming up' WHEN slope < -5e-5 THEN 'converging' WHEN abs(slope) < 5e-5 THEN 'plateauing' ELSE 'diverging' END"
TRUNK = "CASE WHEN layer_pos >= 6 THEN 'fusion' WHEN layer_pos < 3 THEN 'backward' ELSE 'forward' END"
SEVERITY = "CASE WHEN {0} > 2.0 THEN 'EXTREME' WHEN {0} > 1.5 THEN 'VERY HIGH' WHEN {0} > 1.0 THEN 'HIGH' WHEN {0} > 0.5 THEN 'MODERATE' ELSE 'NORMAL' END"
LABEL = "CASE WHEN score >= 80 THEN 'EXCELLENT' WHEN score >= 60 THEN 'GOOD' WHEN score >= 40 THEN 'MODERATE' ELSE 'NEEDS ATTENTION' END"


def m14(spark, sf, variant="slope"):
    m = telemetry.convergence(views.metrics(spark, sf))
    df = m.select("run_id", "step", "slope", (F.pmod("event_id", F.lit(101)).cast("double")).alias("quality"), F.pmod("event_id", F.lit(500)).cast("int").alias("plateau"), F.when(F.col("event_id") % 2 == 0, "Stable").otherwise("Aggressive").alias("mode"))
    return rounded(telemetry.training_score(df, variant).select("run_id", "step", "score", "label"), "score")


SCORED = f"WITH metrics AS ({views.SQL['metrics']}), c AS (SELECT m.run_id, m.step, slope, (event_id % 101)::DOUBLE AS q, (event_id % 500)::INT AS p, event_id % 2 = 0 AS stable FROM ({SLOPE}) s JOIN metrics m USING (run_id, step)), d AS (SELECT run_id, step, ({{trend}} + CASE WHEN q > 0 THEN q / 100 * 40 ELSE 0 END + {{stability}}) / (60 + CASE WHEN q > 0 THEN 40 ELSE 0 END)::DOUBLE * 100 AS score FROM c) SELECT run_id, step, round(score, 9) AS score, {LABEL} AS label FROM d"


def m17(spark, sf):
    m = series(spark, sf).withColumn("step", F.col("step") * 3)
    want = telemetry.expected_lr(F.col("step"), 1e-6, 1.5e-4, 1e-6, 1000, 100_000)
    return rounded(telemetry.lr_schedule_audit(m.withColumn("value", want * (1 + F.col("value")))).select("run_id", "step", "expected", "phase", "off"), "expected", places=12)


EXPECTED = "CASE WHEN s < 1000 THEN 1e-6 + (1.5e-4 - 1e-6) * (s / 1000) ELSE 1e-6 + (1.5e-4 - 1e-6) * 0.5 * (1 + cos(least(1.0, (s - 1000) / 99000) * pi())) END"


def m20(spark, sf):
    m = views.metrics(spark, sf)
    return telemetry.mode_intervals(m.select("run_id", "step", (F.floor(F.col("user_id") / 50) % 2 == 0).alias("aggressive")), 500, 100)


def m21(spark, sf, variant="package"):
    p = views.image_pairs(spark, sf).withColumn("flat", F.transform("a", lambda x: x * 0 + 0.5))
    p = images.ssim(p, SHAPE).withColumnRenamed("ssim", "ki_ssim").withColumn("ki_psnr", columns.psnr(F.col("a"), F.col("b")))
    p = images.ssim(p.withColumn("a0", F.col("a")).withColumn("a", F.col("flat")), SHAPE).withColumnRenamed("ssim", "lr_ssim").withColumn("lr_psnr", columns.psnr(F.col("flat"), F.col("b")))
    off = F.aggregate(F.zip_with("a0", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x) / F.size("b")
    out = telemetry.validation_rollup(p.select(F.col("label").alias("run_id"), F.lit(0).alias("step"), off.alias("loss"), "ki_psnr", "ki_ssim", "lr_psnr", "lr_ssim"), variant)
    return rounded(out, *[c for c in out.columns if c not in ("run_id", "step")], places=6)


def ssim_sql(p: str, out: str) -> str:
    """Tables ``{out}_s`` and ``out`` (vec_id, label, ssim) over the pixels ``p``."""
    return f"""{out}_s AS (SELECT vec_id, label, y, x, ma, mb, aa - ma * ma AS va, bb - mb * mb AS vb, ab - ma * mb AS vab FROM (
  SELECT p.vec_id, p.label, p.y, p.x, sum(q.a) / 121 AS ma, sum(q.b) / 121 AS mb, sum(q.a * q.a) / 121 AS aa, sum(q.b * q.b) / 121 AS bb, sum(q.a * q.b) / 121 AS ab
  FROM {p} p JOIN {p} q ON p.vec_id = q.vec_id AND abs(p.y - q.y) <= 5 AND abs(p.x - q.x) <= 5 GROUP BY ALL)),
{out} AS (SELECT vec_id, any_value(label) AS label, avg(((2 * ma * mb + 0.0001) * (2 * vab + 0.0009)) / ((ma * ma + mb * mb + 0.0001) * (va + vb + 0.0009))) AS ssim FROM {out}_s GROUP BY 1)"""


SSIM = ssim_sql("px", "v")
PSNR = "CASE WHEN avg((a - b) * (a - b)) < 1e-10 THEN 50 ELSE 20 * log10(1 / sqrt(avg((a - b) * (a - b)))) END"
PX = ("units", "image_pairs", "px")
QUALITY = {"package": "greatest(0, least(1, 0.7 * greatest(0, least(1, ({p} - 20) / 30)) + 0.3 * {s}))", "legacy": "0.5 * greatest(0, least(100, ({p} - 20) * 3.33::DOUBLE)) + 0.5 * (100 * {s})"}


def rollup_sql(variant: str) -> str:
    """Validation over labels: the model's image is ``a``, the input's a flat grey."""
    q = lambda p, s: QUALITY[variant].format(p=p, s=s)
    tables = f"fx AS (SELECT * REPLACE (0.5::DOUBLE AS a) FROM px), {ssim_sql('px', 'k')}, {ssim_sql('fx', 'l')}, i AS (SELECT k.label, k.ssim AS ks, l.ssim AS ls, kp, lp, loss FROM k JOIN l USING (vec_id) JOIN (SELECT vec_id, {PSNR} AS kp, avg(abs(a - b)) AS loss FROM px GROUP BY 1) USING (vec_id) JOIN (SELECT vec_id, {PSNR} AS lp FROM fx GROUP BY 1) USING (vec_id))"
    more = f"round(sum({q('kp', 'ks')} - {q('lp', 'ls')}), 6) AS improvement, round(sum({q('kp', 'ks')} - 1), 6) AS ki_to_gt, round(sum({q('lp', 'ls')} - 1), 6) AS lr_to_gt"
    if variant == "legacy":
        more = f"round({q('avg(kp)', 'avg(ks)')} - ({q('avg(lp)', 'avg(ls)')}), 6) AS improvement"
    return sql(f"SELECT label AS run_id, 0 AS step, round(avg(loss), 6) AS val_loss, round(avg(lp), 6) AS lr_psnr, round(avg(ls), 6) AS lr_ssim, round(avg(kp), 6) AS ki_psnr, round(avg(ks), 6) AS ki_ssim, round({q('avg(lp)', 'avg(ls)')}, 6) AS lr_quality, round({q('avg(kp)', 'avg(ks)')}, 6) AS ki_quality, {more} FROM i GROUP BY 1", *PX, recursive=tables)


RATES = """m AS MATERIALIZED (SELECT run_id, tag, step, value FROM metrics), f AS (SELECT run_id, step, value AS best, 0 AS counter, 0 AS rest, 1e-4::DOUBLE AS rate, NULL::VARCHAR AS event, NULL::DOUBLE AS old_rate, NULL::DOUBLE AS new_rate FROM m WHERE step = 0
UNION ALL SELECT run_id, step, CASE WHEN rest > 0 THEN best WHEN better OR div THEN value ELSE best END, CASE WHEN rest > 0 THEN counter WHEN better OR flat OR div THEN 0 ELSE counter + 1 END, CASE WHEN rest > 0 THEN rest - 1 WHEN better THEN 0 WHEN flat OR div THEN 100 ELSE 0 END,
  CASE WHEN rest > 0 OR better THEN rate WHEN div THEN greatest(r1 * 0.6::DOUBLE, 1e-6) ELSE r1 END, CASE WHEN rest > 0 OR better THEN NULL WHEN div THEN 'divergence' WHEN flat THEN 'plateau' END, CASE WHEN rest > 0 OR better THEN NULL WHEN div THEN r1 WHEN flat THEN rate END, CASE WHEN rest > 0 OR better THEN NULL WHEN div THEN greatest(r1 * 0.6::DOUBLE, 1e-6) WHEN flat THEN r1 END
FROM (SELECT *, value > best * 1.15::DOUBLE AND step + 1 > 50 AND greatest(r1 * 0.6::DOUBLE, 1e-6) < r1 AS div FROM (SELECT *, CASE WHEN flat THEN least(rate * 1.3::DOUBLE, 1e-3) ELSE rate END AS r1 FROM (
  SELECT f.run_id, m.step, m.value, f.best, f.counter, f.rest, f.rate, m.value < f.best * 0.997::DOUBLE AS better, f.counter + 1 >= 300 AND least(f.rate * 1.3::DOUBLE, 1e-3) > f.rate AS flat FROM f JOIN m ON m.run_id = f.run_id AND m.step = f.step + 1))))"""


def on_grid(spark, sf, every, first):
    """The whole series, logged at every so many steps."""
    return series(spark, sf).withColumn("step", F.col("step") * every + first)


GRIDS = "(SELECT run_id, step * 5 AS step, value FROM metrics) v ASOF LEFT JOIN (SELECT run_id, step * 3 + 1 AS step, value FROM metrics) m"


def m25(spark, sf):
    return telemetry.delayed_snapshot(on_grid(spark, sf, 5, 0), on_grid(spark, sf, 3, 1))


def m27(spark, sf):
    return rounded(telemetry.val_train_ratio(on_grid(spark, sf, 5, 0), on_grid(spark, sf, 3, 1)), "ratio")


def tagged(spark, sf):
    m = views.metrics(spark, sf)
    tag = F.element_at(F.array(*[F.lit(t) for t in telemetry.DASHBOARD]), (F.pmod("user_id", F.lit(8)) + 1).cast("int"))
    return m.select("run_id", tag.alias("tag"), "step", "value")


TAGGED = f"SELECT run_id, [{', '.join(repr(t) for t in telemetry.DASHBOARD)}][user_id % 8 + 1] AS tag, step, value FROM metrics"


def m28(spark, sf):
    c = views.checkpoints(spark, sf)
    files = c.select(F.col("custkey").alias("run_id"), (F.col("bytes") / 300).cast("bigint").alias("bytes"))
    pts = c.select((F.col("custkey") + 1).alias("run_id"), F.when(F.col("step") % 16 == 0, "a").otherwise("b").alias("tag"))
    return rounded(telemetry.dead_runs(files, pts, 2.0, 8.0, 2), "mb", places=6)


def m31(spark, sf):
    m = views.metrics(spark, sf)
    e = F.col("event_id")
    df = m.select("run_id", "step", F.pmod(e, F.lit(400)).alias("plateau"), F.pmod(e, F.lit(100)).alias("quality"), ((F.pmod(e, F.lit(9)) - 4) / 2000.0).alias("trend"), (e % 5 == 0).alias("validating"), (e % 3 == 0).alias("paused"), (e % 2 == 0).alias("active"))
    return telemetry.status_labels(df).select("run_id", "step", "plateau_band", "quality_band", "trend_label", "state")


def windows(spark, sf):
    f = views.frames(spark, sf)
    rows = f.alias("x").join(f.alias("y"), (F.col("x.video_id") == F.col("y.video_id")) & (F.col("y.frame_no") == F.col("x.frame_no") + 6))
    return rows.select(F.col("x.video_id"), F.col("x.frame_no"), F.col("x.image").alias("first"), F.col("y.image").alias("last"))


def whole_windows(spark, sf):
    from loomframe.operators.sampling import frame_window

    f = views.frames(spark, sf)
    starts = f.select("video_id", F.col("frame_no").alias("frame_idx"), F.col("frame_no").alias("start_frame"))
    w = frame_window(starts, f, 7, 10, (8, 8))
    return w.select("video_id", "frame_idx", "images", F.pmod("frame_idx", F.lit(3)).cast("int").alias("crop_y"), F.pmod("video_id", F.lit(3)).cast("int").alias("crop_x"), F.lit(6).alias("gt_h"), F.lit(6).alias("gt_w"))


def hexed(df, column):
    return F.lower(F.hex(F.col(f"{column}.data")))


CROP = "list_reduce(list_transform(list_filter(range(64), lambda i: i // 8 >= {y} AND i // 8 < {y} + 6 AND i % 8 >= {x} AND i % 8 < {x} + 6 {more}), lambda i: printf('%02x', {px}[i + 1])), lambda a, b: a || b)"
WINDOW = "w AS (SELECT a.video_id, a.frame_no AS frame_idx, (a.frame_no % 3)::INT AS y, (a.video_id % 3)::INT AS x, list(b.px ORDER BY b.frame_no) AS f FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_no BETWEEN a.frame_no AND a.frame_no + 6 GROUP BY a.video_id, a.frame_no HAVING count(*) = 7)"
SHRUNK = "AND (i // 8 - y) % 3 = 1 AND (i % 8 - x) % 3 = 1"


def stack_of(n: int) -> str:
    return " || ".join(CROP.format(y="y", x="x", more=SHRUNK, px=f"f[{k + 1}]") for k in range((7 - n) // 2, (7 - n) // 2 + n))


def stacked(n: int) -> str:
    return sql(f"SELECT video_id, frame_idx, {2 * n} AS height, {stack_of(n)} AS px FROM w", "frames", recursive=WINDOW)


def i4(spark, sf):
    w = images.split_stack(images.lr_stack(whole_windows(spark, sf)))
    return w.select("video_id", "frame_idx", F.size("frames").alias("n"), F.array_join(F.transform("frames", lambda f: F.lower(F.hex(f))), "|").alias("frames"))


def millionths(array) -> Column:
    """An array of numbers as text."""
    return F.array_join(F.transform(array, lambda x: F.floor(x * 1e6 + 0.5).cast("string")), ",")


#: The same in SQL, for the ``size`` values of {0} at {1}.
MILLIONTHS = "array_to_string(list_transform(range({size}), lambda k: floor({value} * 1e6 + 0.5)::BIGINT), ',')"


def i5(spark, sf):
    p = views.image_pairs(spark, sf)
    out = images.augment(p.select("vec_id", "a", "b"), 3, 1, "vec_id", ["a", "b"], SHAPE)
    return out.select("vec_id", "hflip", "vflip", "turns", millionths("a").alias("a"), millionths("b").alias("b"))


U5 = "('0x' || substr(md5(concat_ws('|', '3', '{0}', '1', vec_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
#: Where the pixel at (r, c) of the result comes from: a quarter turn takes (r, c) from (c, 7 - r), then the flips.
TURNED = "{0}[CASE WHEN v THEN 7 - {r} ELSE {r} END * 8 + CASE WHEN h THEN 7 - {c} ELSE {c} END + 1]"
TURNED_R, TURNED_C = "[k // 8, k % 8, 7 - k // 8, 7 - k % 8][t + 1]", "[k % 8, 7 - k // 8, 7 - k % 8, k // 8][t + 1]"
I5_A, I5_B = (MILLIONTHS.format(size=64, value=TURNED.format(c_, r=TURNED_R, c=TURNED_C)) for c_ in "ab")
I5 = f"""SELECT vec_id, h AS hflip, v AS vflip, t AS turns, {I5_A} AS a, {I5_B} AS b
FROM (
  SELECT vec_id, a, b, {U5.format('h')} < 0.5 AS h, {U5.format('v')} < 0.5 AS v, floor({U5.format('r')} * 4)::INT AS t FROM image_pairs)"""


def i6(spark, sf):
    f = views.frames(spark, sf)
    out = images.to_tensor(f, "image")
    out = out.select("video_id", "frame_no", F.aggregate("tensor", F.lit(0.0), lambda s, x: s + x).alias("total"), F.get("tensor", F.lit(9)).alias("tenth"))
    return rounded(rounded(out, "total", places=6), "tenth")


def pixel(spark, sf, variant):
    out = images.pixel_losses(views.image_pairs(spark, sf), SHAPE, variant).select("vec_id", "l1", "ms", "grad")
    return rounded(out, "l1", "ms", "grad")


def grads(legacy: bool, places: int = 9) -> str:
    d = "abs((q.a - p.a) - (q.b - p.b))" if legacy else "abs(abs(q.a - p.a) - abs(q.b - p.b))"
    one = lambda dy, dx: f"(SELECT p.vec_id, avg({d}) AS g FROM px p JOIN px q ON p.vec_id = q.vec_id AND q.y = p.y + {dy} AND q.x = p.x + {dx} GROUP BY 1)"
    return sql(
        f"""SELECT l.vec_id, round(l1, {places}) AS l1, round(ms{' / 2' if legacy else ''}, {places}) AS ms, round((gx.g + gy.g){'' if legacy else ' / 2'}, {places}) AS grad FROM (SELECT vec_id, avg(abs(a - b)) AS l1 FROM px GROUP BY 1) l
JOIN (SELECT vec_id, avg(abs(d)) AS ms FROM (SELECT vec_id, avg(a) - avg(b) AS d FROM px GROUP BY vec_id, y // 2, x // 2) GROUP BY 1) m USING (vec_id)
JOIN {one(0, 1)} gx USING (vec_id) JOIN {one(1, 0)} gy USING (vec_id)""",
        *PX,
    )


def i9(spark, sf):
    out = images.pixel_losses(views.image_pairs(spark, sf), SHAPE)
    w = F.when(F.col("vec_id") % 2 == 0, F.lit(0.5))
    total = columns.total_loss({"l1": (w, 0.6), "ms": (F.lit(None).cast("double"), 0.2), "grad": (F.lit(None).cast("double"), 0.2), "perceptual": (F.lit(0.1), 0.0)}, {"l1": F.col("l1"), "ms": F.col("ms"), "grad": F.col("grad"), "perceptual": F.lit(None).cast("double")})
    return rounded(out.select("vec_id", total.alias("total")), "total")


def i12(spark, sf, variant):
    p = images.ssim(images.psnr(views.image_pairs(spark, sf)), SHAPE)
    return rounded(p.select("vec_id", columns.quality_score(F.col("psnr"), F.col("ssim"), variant).alias("quality")), "quality", places=6)


def i13(spark, sf):
    return rounded(images.sharpness_ratio(views.image_pairs(spark, sf), SHAPE).select("vec_id", "ratio"), "ratio", places=6)


SHARP = """g AS (SELECT vec_id, avg(abs(da)) AS a, avg(abs(db)) AS b FROM (SELECT p.vec_id, q.a - p.a AS da, q.b - p.b AS db FROM px p JOIN px q ON p.vec_id = q.vec_id AND q.y = p.y AND q.x = p.x + 1) GROUP BY 1),
h AS (SELECT vec_id, avg(abs(da)) AS a, avg(abs(db)) AS b FROM (SELECT p.vec_id, q.a - p.a AS da, q.b - p.b AS db FROM px p JOIN px q ON p.vec_id = q.vec_id AND q.y = p.y + 1 AND q.x = p.x) GROUP BY 1)"""


def i14(spark, sf):
    out = images.bilinear_x3(views.image_pairs(spark, sf), "a", SHAPE)
    return out.select("vec_id", F.size("upscaled").alias("n"), millionths("upscaled").alias("upscaled"))


#: A result's row k lies (k + 2) % 3 thirds behind the source's row (k + 2) // 3 - 1; rows outside are the nearest inside.
AT = "a[greatest(0, least(7, (k // 24 + 2) // 3 - 1 + {0})) * 8 + greatest(0, least(7, (k % 24 + 2) // 3 - 1 + {1})) + 1] * (abs(1 - {0} - (k // 24 + 2) % 3 / 3.0::DOUBLE)) * (abs(1 - {1} - (k % 24 + 2) % 3 / 3.0::DOUBLE))"
I14 = f"SELECT vec_id, 576 AS n, {MILLIONTHS.format(size=576, value='(' + ' + '.join(AT.format(y, x) for y in (0, 1) for x in (0, 1)) + ')')} AS upscaled FROM image_pairs"


def i15(spark, sf):
    out = images.comparison_strip(views.image_pairs(spark, sf), ["a", "b", "a"], SHAPE)
    return out.select("vec_id", F.col("strip.height").alias("height"), F.col("strip.width").alias("width"), F.lower(F.hex("strip.data")).alias("data"))


ROW = "list_reduce(list_transform({0}[y * 8 + 1 : y * 8 + 8], lambda v: printf('%02x', floor(v * 255)::INT)), lambda p, q: p || q)"
STRIP = f"array_to_string(list_transform(range(8), lambda y: {ROW.format('a')} || '000000' || {ROW.format('b')} || '000000' || {ROW.format('a')}), '')"


def i16(spark, sf):
    e = views.table(spark, sf, "embeddings")
    return rounded(images.tensor_stats(e.select(F.col("label").alias("run_id"), F.lit(0).alias("step"), F.col("embedding").alias("values"))), "activity", "global_norm", "mean_norm", places=6)


W = "PARTITION BY run_id ORDER BY step"
def eta_sql(eta: str) -> str:
    whole = f"floor({eta})::BIGINT"
    return f"CASE WHEN paused THEN 'PAUSED' WHEN {eta} < 0 THEN 'N/A' WHEN floor({eta}) >= 86400 THEN printf('%dd %dh %dm', {whole} // 86400, {whole} % 86400 // 3600, {whole} % 3600 // 60) ELSE printf('%dh %dm', {whole} // 3600, {whole} % 3600 // 60) END"


M15 = sql(f"""SELECT run_id, step, t AS mean_step_time, paused, round(step / 150 * 100, 6) AS percent, round(eta, 6) AS eta, round(epoch_eta, 6) AS epoch_eta, round(CASE WHEN t > 0 THEN 1 / t ELSE 0 END, 6) AS rate,
500 - step % 500 AS to_validation, 10000 - step % 10000 AS to_save, {eta_sql("eta")} AS eta_text, {eta_sql("epoch_eta")} AS epoch_eta_text
FROM (SELECT run_id, step, value * 100 AS t, event_id % 5 = 0 AS paused, (150 - step) * (value * 100) AS eta, (1000 - step % 1000) * (value * 100) AS epoch_eta FROM metrics)""", "metrics")


QUERIES = {
    "m1_ema": (lambda s, d: rounded(telemetry.ema(series(s, d)), "ema"), sql("SELECT run_id, tag, step, value, round(ema, 9) AS ema FROM e", "metrics", recursive=EMA)),
    "m2_rolling_mean": (lambda s, d: rounded(telemetry.rolling_mean(series(s, d), 20), "rolling_mean"), sql(f"SELECT run_id, tag, step, value, round(avg(value) OVER ({W} ROWS 19 PRECEDING), 9) AS rolling_mean FROM metrics", "metrics")),
    "m3_trend_pct": (lambda s, d: rounded(telemetry.trend_pct(views.activity(s, d)), "trend", places=5), sql("SELECT run_id, step, layer_pos, value, round(CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) >= 20 THEN (avg(value) OVER (w ROWS 9 PRECEDING) - avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING)) / (avg(value) OVER (w ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) + 1e-8) * 100 ELSE 0 END::DOUBLE, 5) AS trend FROM activity WINDOW w AS (PARTITION BY run_id, layer_pos ORDER BY step)", "metrics", "activity")),
    "m4_convergence": (lambda s, d: rounded(telemetry.convergence(series(s, d)), "slope"), sql(f"SELECT run_id, tag, step, value, round(slope, 9) AS slope, {STATUS} AS status FROM ({SLOPE})", "metrics")),
    "m5_plateau_tracker": (m5, sql("SELECT run_id, step, round(best_loss, 9) AS best_loss, round(best_quality, 9) AS best_quality, round(ema_loss, 9) AS ema_loss, round(ema_quality, 9) AS ema_quality, counter, counter >= 25 AS is_plateau, greatest(0, 80 - floor(counter)::INT) AS steps_until_reset FROM f", "metrics", recursive=M5)),
    "m6_plateau_divergence_events": (lambda s, d: rounded(telemetry.plateau_divergence_events(series(s, d), 1e-4), "old_rate", "new_rate", places=12), sql("SELECT run_id, 'loss' AS tag, step, event, round(old_rate, 12) AS old_rate, round(new_rate, 12) AS new_rate FROM f WHERE event IS NOT NULL", "metrics", recursive=RATES)),
    "m7_adaptive_clip": (lambda s, d: rounded(telemetry.adaptive_clip(series(s, d)), "p95", "clip"), sql("SELECT run_id, tag, step, value, round(p95, 9) AS p95, round(clip, 9) AS clip FROM e", "metrics", recursive=CLIP)),
    "m8_peak_layer": (lambda s, d: telemetry.peak_layer(views.activity(s, d)), sql(f"SELECT run_id, step, layer_pos, value AS peak, {SEVERITY.format('value')} AS severity FROM (SELECT *, row_number() OVER (PARTITION BY run_id, step ORDER BY value DESC, layer_pos) AS k FROM activity) WHERE k = 1", "metrics", "activity")),
    "m9_relative_activity": (lambda s, d: telemetry.relative_activity(views.activity(s, d), LAYERS), sql(f"SELECT *, CASE WHEN m > 0 THEN trunc(value / m * 100)::INT ELSE 0 END AS percent, {TRUNK} AS trunk, {SEVERITY.format('value')} AS band FROM (SELECT *, max(value) OVER (PARTITION BY run_id, step) AS m FROM activity)", "metrics", "activity").replace("SELECT *, CASE WHEN m", "SELECT run_id, step, layer_pos, value, CASE WHEN m")),
    "m10_trunk_average": (lambda s, d: rounded(telemetry.trunk_average(views.activity(s, d), LAYERS), "mean", places=7), sql(f"SELECT run_id, step, {TRUNK} AS trunk, round(avg(value), 7) AS mean FROM activity GROUP BY ALL", "metrics", "activity")),
    "m11_rank_layers": (lambda s, d: telemetry.rank_layers(views.activity(s, d), LAYERS), sql(f"SELECT *, {TRUNK} AS trunk, row_number() OVER (PARTITION BY run_id, step, {TRUNK} ORDER BY value DESC, layer_pos) AS rank FROM activity", "metrics", "activity")),
    "m11_rank_layers_flat": (lambda s, d: telemetry.rank_layers(views.activity(s, d), LAYERS, False, "position"), sql(f"SELECT *, {TRUNK} AS trunk, row_number() OVER (PARTITION BY run_id, step ORDER BY layer_pos) AS rank FROM activity", "metrics", "activity")),
    "m12_weight_shares": (lambda s, d: rounded(telemetry.weight_shares(views.weights(s, d), ["l1", "ms", "grad"]).drop("perceptual"), "total", "l1_pct", "ms_pct", "grad_pct"), sql("SELECT run_id, step, l1, ms, grad, round(l1 + ms + grad, 9) AS total, round(l1 / (l1 + ms + grad) * 100, 9) AS l1_pct, round(ms / (l1 + ms + grad) * 100, 9) AS ms_pct, round(grad / (l1 + ms + grad) * 100, 9) AS grad_pct FROM weights", "metrics", "weights")),
    "m13_value_histogram": (lambda s, d: telemetry.value_histogram(views.activity(s, d).withColumn("tag", F.col("run_id"))), sql("SELECT tag, least(9, floor((value - lo) / (hi - lo) * 10))::INT AS bucket, count(*) AS n FROM (SELECT run_id AS tag, value, min(value) OVER (PARTITION BY run_id) AS lo, max(value) OVER (PARTITION BY run_id) AS hi FROM activity) GROUP BY ALL", "metrics", "activity")),
    "m14_training_score": (m14, SCORED.format(trend="CASE WHEN slope IS NULL THEN 15 WHEN slope < -5e-5 THEN 30 WHEN abs(slope) < 5e-5 THEN 20 ELSE 5 END", stability="CASE WHEN p < 150 THEN 30 WHEN p < 300 THEN 20 ELSE 10 END")),
    "m14_training_score_plateau": (lambda s, d: m14(s, d, "plateau"), SCORED.format(trend="CASE WHEN p < 150 THEN 30 WHEN p < 300 THEN 20 ELSE 10 END", stability="CASE WHEN stable OR p < 150 THEN 30 WHEN p < 300 THEN 20 ELSE 10 END")),
    "m15_progress_eta": (lambda s, d: rounded(telemetry.progress_eta(views.metrics(s, d).select("run_id", "step", (F.col("value") * 100).alias("mean_step_time"), (F.col("event_id") % 5 == 0).alias("paused")), 150), "percent", "eta", "epoch_eta", "rate", places=6), M15),
    "m16_cadence": (lambda s, d: telemetry.cadence(series(s, d), 100), sql("SELECT run_id, tag, step, value FROM metrics WHERE step % 100 = 0", "metrics")),
    "m17_lr_schedule_audit": (m17, sql(f"SELECT run_id, s AS step, round({EXPECTED}, 12) AS expected, CASE WHEN s < 1000 THEN 'warmup' ELSE 'cosine' END AS phase, abs({EXPECTED} * (1 + value) - {EXPECTED}) > 0.01 * {EXPECTED} AS off FROM (SELECT *, step * 3 AS s FROM metrics)", "metrics")),
    "m18_lr_boost_events": (lambda s, d: rounded(telemetry.lr_boost_events(series(s, d), 0.03, 20), "ratio"), sql(f"""SELECT run_id, tag, step, before, value, round(ratio, 9) AS ratio, ratio <= 3.000000001 AND value <= 0.03 AS allowed, step - lag(step) OVER ({W}) AS gap, coalesce(step - lag(step) OVER ({W}) <= 20, false) AS too_soon FROM (SELECT *, value / nullif(before, 0) AS ratio FROM (SELECT run_id, tag, step, value, lag(value) OVER ({W}) AS before FROM metrics)) WHERE ratio > 1.5""", "metrics")),
    "m19_weight_guard_audit": (lambda s, d: rounded(telemetry.weight_guard_audit(views.weights(s, d)), "value"), sql(f"""SELECT run_id, step, rule, round(value, 9) AS value FROM (
SELECT run_id, step, 'ms_floor' AS rule, ms AS value FROM weights WHERE ms < 0.05 - 1e-6 UNION ALL SELECT run_id, step, 'grad_floor', grad FROM weights WHERE grad < 0.05 - 1e-6 UNION ALL SELECT run_id, step, 'l1_range', l1 FROM weights WHERE NOT l1 BETWEEN 0.1 - 1e-6 AND 0.9 + 1e-6
UNION ALL SELECT run_id, step, 'sum', l1 + ms + grad FROM weights WHERE abs(l1 + ms + grad - 1) > 1e-6 UNION ALL SELECT run_id, step, 'perceptual_range', perceptual FROM weights WHERE NOT perceptual BETWEEN 0.05 - 1e-6 AND 0.25 + 1e-6
""" + "".join(f"UNION ALL SELECT run_id, step, '{c}_change', d FROM (SELECT run_id, step, abs({c} - lag({c}) OVER ({W})) AS d FROM weights) WHERE d > 0.01 + 1e-6 " for c in ("l1", "ms", "grad", "perceptual")) + ")", "metrics", "weights")),
    "m20_mode_intervals": (m20, sql(f"""SELECT run_id, interval, any_value(mode) AS mode, min(step) AS from_step, max(step) AS to_step, count(*) AS steps FROM (SELECT *, sum(n) OVER ({W}) ::BIGINT AS interval FROM (SELECT *, (lag(mode) OVER ({W}) IS DISTINCT FROM mode)::INT AS n FROM (
SELECT run_id, step, CASE WHEN step < 500 THEN 'Warmup' WHEN step < 600 THEN 'Settling' WHEN user_id // 50 % 2 = 0 THEN 'Aggressive' ELSE 'Stable' END AS mode FROM metrics))) GROUP BY 1, 2""", "metrics")),
    "m21_validation_rollup": (m21, rollup_sql("package")),
    "m21_validation_rollup_legacy": (lambda s, d: m21(s, d, "legacy"), rollup_sql("legacy")),
    "m22_sharpness_decision": (lambda s, d: rounded(telemetry.sharpness_decision(series(s, d).withColumn("value", F.col("value") * 40)), "mean"), sql(f"SELECT run_id, tag, step, v AS value, round(m, 9) AS mean, CASE WHEN step < 9 THEN 'wait' WHEN m < 0.75 THEN 'blurry' WHEN m > 0.92 THEN 'sharp' ELSE 'hold' END AS decision FROM (SELECT *, value * 40 AS v, avg(value * 40) OVER ({W} ROWS 19 PRECEDING) AS m FROM metrics)", "metrics")),
    "m23_perceptual_band": (lambda s, d: rounded(telemetry.perceptual_band(telemetry.ema(series(s, d))), "ema"), sql("SELECT run_id, tag, step, value, round(ema, 9) AS ema, CASE WHEN ema < 0.008 THEN 0.20 WHEN ema < 0.012 THEN 0.15 ELSE 0.10 END::DOUBLE AS cap, CASE WHEN ema < 0.010 THEN 'raise' WHEN ema > 0.018 THEN 'lower' ELSE 'hold' END AS direction FROM e", "metrics", recursive=EMA)),
    "m24_cooldown_flags": (lambda s, d: telemetry.cooldown_flags(views.metrics(s, d).select("run_id", "step", (F.col("event_id") % 150 == 0).alias("adjusted"))), sql(f"SELECT run_id, step, adjusted, coalesce(greatest(0, 80 - (step - l)), 0) AS remaining, coalesce(greatest(0, 80 - (step - l)), 0) > 0 AS cooling FROM (SELECT run_id, step, event_id % 150 = 0 AS adjusted, max(CASE WHEN event_id % 150 = 0 THEN step END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM metrics)", "metrics")),
    "m25_delayed_snapshot": (m25, sql(f"SELECT v.run_id, v.step AS val_step, m.step AS metric_step, m.value FROM {GRIDS} ON v.run_id = m.run_id AND v.step + 2 <= m.step", "metrics")),
    "m26_latest_state": (lambda s, d: telemetry.latest_state(tagged(s, d)).select("run_id", *[F.try_element_at("state", F.lit(t)).alias(t) for t in telemetry.DASHBOARD]), sql("SELECT run_id, " + ", ".join(f"max(v) FILTER (tag = '{t}') AS {t}" for t in telemetry.DASHBOARD) + f" FROM (SELECT run_id, tag, arg_max(value, step) AS v FROM ({TAGGED}) GROUP BY 1, 2) GROUP BY 1", "metrics")),
    "m27_val_train_ratio": (m27, sql(f"SELECT v.run_id, v.step, v.value AS val, m.value AS train, round(v.value / m.value, 9) AS ratio FROM {GRIDS} ON v.run_id = m.run_id AND v.step >= m.step", "metrics")),
    "m28_dead_runs": (m28, sql("""SELECT run_id, round(mb, 6) AS mb, coalesce(points, 0) AS points FROM (SELECT custkey AS run_id, sum(trunc(bytes / 300)::BIGINT) / 1048576.0::DOUBLE AS mb FROM checkpoints GROUP BY 1) LEFT JOIN
(SELECT run_id, arg_min(n, tag) AS points FROM (SELECT custkey + 1 AS run_id, CASE WHEN step % 16 = 0 THEN 'a' ELSE 'b' END AS tag, count(*) AS n FROM checkpoints GROUP BY 1, 2) GROUP BY 1) USING (run_id) WHERE mb < 2 OR mb <= 8 AND coalesce(points, 0) < 2""", "checkpoints")),
    "m29_core_dashboard": (lambda s, d: rounded(telemetry.core_dashboard(tagged(s, d)), *telemetry.DASHBOARD), sql("SELECT run_id, step, " + ", ".join(f"round(max(value) FILTER (tag = '{t}') * {k!r}::DOUBLE, 9) AS {t}" for t, k in telemetry.DASHBOARD.items()) + f" FROM ({TAGGED}) GROUP BY 1, 2", "metrics")),
    "m29_codes": (lambda s, d: views.checkpoints(s, d).select("filename", telemetry.code(columns.checkpoint_type(F.col("filename"), F.col("step")), telemetry.CHECKPOINTS).alias("code")), sql("SELECT filename, CASE WHEN o_orderstatus = 'F' THEN 3 WHEN step % 10000 = 0 AND step > 0 THEN 1 ELSE 2 END AS code FROM checkpoints", "checkpoints")),
    "m30_log_activity_score": (lambda s, d: series(s, d).select("run_id", "step", columns.log_activity_score(F.col("value") / 10).alias("score")), sql("SELECT run_id, step, greatest(0, least(100, trunc((log10(value / 10 + 1e-9) + 5) * 25)::INT)) AS score FROM metrics", "metrics")),
    "m31_status_labels": (m31, sql("""SELECT run_id, step, CASE WHEN event_id % 400 > 300 THEN 'warning' WHEN event_id % 400 > 150 THEN 'raised' ELSE 'normal' END AS plateau_band, CASE WHEN event_id % 100 >= 70 THEN 'good' WHEN event_id % 100 >= 50 THEN 'fair' ELSE 'poor' END AS quality_band,
CASE WHEN event_id % 9 - 4 > 2 THEN 'rising' WHEN event_id % 9 - 4 < -2 THEN 'falling' ELSE 'stable' END AS trend_label, CASE WHEN event_id % 5 = 0 THEN 'validating' WHEN event_id % 3 = 0 THEN 'paused' WHEN event_id % 2 = 0 THEN 'training' END AS state FROM metrics""", "metrics")),
    "i1_scene_diff": (lambda s, d: rounded(images.scene_diff(windows(s, d)).select("video_id", "frame_no", "diff", "stable"), "diff"), sql("SELECT a.video_id, a.frame_no, round(list_avg(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))), 9) AS diff, list_avg(list_transform(list_zip(a.px, b.px), lambda z: abs(z[1] - z[2]))) < 45 AS stable FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_no = a.frame_no + 6", "frames")),
    "i2_gt_crop": (lambda s, d: images.gt_crop(whole_windows(s, d)).select("video_id", "frame_idx", F.col("gt.height").alias("height"), hexed(None, "gt").alias("px")), sql(f"SELECT video_id, frame_idx, 6 AS height, {CROP.format(y='y', x='x', more='', px='f[4]')} AS px FROM w", "frames", recursive=WINDOW)),
    "i3_lr_stack": (lambda s, d: images.lr_stack(whole_windows(s, d)).select("video_id", "frame_idx", F.col("lr.height").alias("height"), hexed(None, "lr").alias("px")), stacked(5)),
    "i3_lr_stack_7": (lambda s, d: images.lr_stack(whole_windows(s, d), 7).select("video_id", "frame_idx", F.col("lr.height").alias("height"), hexed(None, "lr").alias("px")), stacked(7)),
    "i4_split_stack": (i4, sql(f"SELECT video_id, frame_idx, 5 AS n, {" || '|' || ".join(CROP.format(y='y', x='x', more=SHRUNK, px=f'f[{k}]') for k in range(2, 7))} AS frames FROM w", "frames", recursive=WINDOW)),
    "i5_augment": (i5, sql(I5, "units", "image_pairs")),
    "i6_to_tensor": (i6, sql("SELECT video_id, frame_no, round(list_sum(px) / 255.0::DOUBLE, 6) AS total, round(px[10] / 255.0::DOUBLE, 9) AS tenth FROM frames", "frames")),
    "i7_pixel_losses": (lambda s, d: pixel(s, d, "hybrid"), grads(False)),
    "i8_pixel_losses_legacy": (lambda s, d: pixel(s, d, "legacy"), grads(True)),
    "i9_total_loss": (i9, f"SELECT vec_id, round(CASE WHEN vec_id % 2 = 0 THEN 0.5 ELSE 0.6 END::DOUBLE * l1 + 0.2::DOUBLE * ms + 0.2::DOUBLE * grad, 9) AS total FROM ({grads(False, 15)})"),
    "i10_psnr": (lambda s, d: rounded(images.psnr(views.image_pairs(s, d)).select("vec_id", "psnr"), "psnr", places=6), sql(f"SELECT vec_id, round({PSNR}, 6) AS psnr FROM px GROUP BY 1", *PX)),
    "i11_ssim": (lambda s, d: rounded(images.ssim(views.image_pairs(s, d), SHAPE).select("vec_id", "ssim"), "ssim", places=6), sql("SELECT vec_id, round(ssim, 6) AS ssim FROM v", *PX, recursive=SSIM)),
    "i12_quality_score": (lambda s, d: i12(s, d, "package"), sql(f"SELECT v.vec_id, round(greatest(0, least(1, 0.7 * greatest(0, least(1, (p - 20) / 30)) + 0.3 * ssim)), 6) AS quality FROM v JOIN (SELECT vec_id, {PSNR} AS p FROM px GROUP BY 1) USING (vec_id)", *PX, recursive=SSIM)),
    "i12_quality_score_legacy": (lambda s, d: i12(s, d, "legacy"), sql(f"SELECT v.vec_id, round(0.5 * greatest(0, least(100, (p - 20) * 3.33::DOUBLE)) + 0.5 * (100 * ssim), 6) AS quality FROM v JOIN (SELECT vec_id, {PSNR} AS p FROM px GROUP BY 1) USING (vec_id)", *PX, recursive=SSIM)),
    "i13_sharpness_ratio": (i13, sql("SELECT g.vec_id, round(CASE WHEN g.b + h.b > 0 THEN (g.a + h.a) / (g.b + h.b) ELSE 1 END, 6) AS ratio FROM g JOIN h USING (vec_id)", *PX, recursive=SHARP)),
    "i14_bilinear_x3": (i14, sql(I14, "units", "image_pairs")),
    "i15_comparison_strip": (i15, sql(f"SELECT vec_id, 8 AS height, 30 AS width, {STRIP} AS data FROM image_pairs", "units", "image_pairs")),
    "i16_tensor_stats": (i16, """SELECT label AS run_id, 0 AS step, round(avg(m), 6) AS activity, round(sqrt(sum(n * n)), 6) AS global_norm, round(avg(n), 6) AS mean_norm FROM (SELECT label, list_avg(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) GROUP BY 1"""),
}
