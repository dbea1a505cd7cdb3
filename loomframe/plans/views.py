"""The operators' inputs as views over the benchmark tables, in Spark and (``SQL``) as common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomframe.functions import columns
from loomframe.functions.ranks import placed


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def run_of(user: str = "user_id") -> Column:
    """The run of an event: its type and a block of users, so that runs keep their length as the table grows."""
    return F.concat_ws("-", "event_type", F.floor(F.col(user) / 150).cast("string"))


#: The same in SQL.
RUN = "event_type || '-' || (user_id // 150)"


def metrics(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("run_id", run_of())
    step = F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "event_id")).cast("bigint") - 1
    return e.select("run_id", F.lit("loss").alias("tag"), step.alias("step"), (F.col("value") / 10000).alias("value"), F.col("ts").cast("timestamp").alias("wall_time"), "event_id", "user_id")


def weights(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda base, k: (F.lit(base) + F.pmod(F.col("event_id"), F.lit(k)) / 100.0)
    m = metrics(spark, sf)
    return m.select("run_id", "step", part(0.5, 41).alias("l1"), part(0.03, 37).alias("ms"), part(0.04, 31).alias("grad"), part(0.0, 29).alias("perceptual"))


def activity(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf)
    return m.groupBy("run_id", F.floor(F.col("step") / 10).cast("bigint").alias("step"), F.pmod("user_id", F.lit(7)).cast("int").alias("layer_pos")).agg(columns.round_double(F.avg(F.col("value") * 100), 9).alias("value"))


def videos(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    name = F.concat(F.col("source"), F.lit(" {edition-"), "lang", F.lit("} "), F.pmod("doc_id", F.lit(7)).cast("string"), F.lit(".mkv"))
    priority = F.when(F.pmod("doc_id", F.lit(5)) > 0, F.pmod("doc_id", F.lit(5)) * 60).cast("int")
    cat = F.col("lang")
    m = lambda *kv: F.create_map(*[F.lit(x) for x in kv])
    cats = F.when(cat == "en", m("general", 0.3, "space", 0.4, "toon", 0.3)).when(cat == "de", m("space", 1.0)).when(cat == "fr", m("toon", 0.5)).otherwise(m("general", 1.0))
    return d.select(F.col("doc_id").alias("video_id"), name.alias("name"), F.concat(F.lit("/media/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").cast("double").alias("duration"), priority.alias("priority"), cats.alias("categories"))


def weighted_videos(spark: SparkSession, sf: str) -> DataFrame:
    return videos(spark, sf).select("video_id", "name", "duration", (F.lit(0.1) + F.pmod("video_id", F.lit(4)) / 10.0).alias("weight"))


def bytes_of(values: Column) -> Column:
    """Numbers in 0-1 as unsigned bytes."""
    one = lambda x: F.lpad(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + 0.5)) * 255).cast("long")), 2, "0")
    return F.unhex(F.array_join(F.transform(values, one), ""))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """8 x 8 grey frames: video_id (label), frame_no, image, bytes, height, width."""
    e = placed(table(spark, sf, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id")
    img = F.struct(F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("nChannels"), bytes_of(F.col("embedding")).alias("data"))
    return e.select(F.col("label").alias("video_id"), F.col("place").alias("frame_no"), img.alias("image"), F.lit(64).alias("bytes"), F.lit(8).alias("height"), F.lit(8).alias("width"))


def image_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each 8 x 8 image beside the next: vec_id, a, b in 0-1."""
    e = table(spark, sf, "embeddings")
    unit = F.transform("embedding", lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") + 0.5)))
    rows = e.select("vec_id", "label", unit.alias("a"))
    return rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")


def patches(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("video_id"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("format"), F.col("l_extendedprice").cast("bigint").alias("bytes"), F.col("l_linenumber").alias("idx"))


def names(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Targets, validation inputs and patch inputs by file name."""
    o, c, li = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "lineitem")
    val = c.select((F.col("c_custkey") * 11).alias("filename"))
    return o.select(F.col("o_orderkey").alias("filename")), val, li.select(F.col("l_orderkey").alias("filename")).distinct()


def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    name = F.concat(F.format_string("checkpoint_step_%07d", "o_orderkey"), F.when(F.col("o_orderstatus") == "F", "_emergency").otherwise(""), F.lit(".pth"))
    return o.select(name.alias("filename"), F.col("o_orderkey").alias("step"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("quality"), (F.col("o_totalprice") / 1e6).alias("loss"), (F.col("o_totalprice") * 1024).cast("bigint").alias("bytes"), F.col("o_orderdate").alias("timestamp"), F.col("o_custkey").alias("custkey"))


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """run_id (nation), step, timestamp, config of one or two parameters."""
    c = table(spark, sf, "customer")
    second = F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.create_map(F.lit("max_lr"), (F.pmod("c_custkey", F.lit(5)) / 1e4))).otherwise(F.create_map().cast("map<string,double>"))
    return c.select(F.col("c_nationkey").alias("run_id"), F.col("c_custkey").alias("step"), F.col("c_custkey").cast("double").alias("timestamp"), F.map_concat(F.create_map("c_mktsegment", "c_acctbal"), second).alias("config"))


def stats(spark: SparkSession, sf: str) -> DataFrame:
    m = metrics(spark, sf)
    q = F.least(F.lit(1.0), F.col("value") * 25)
    rows = m.select("run_id", ((F.col("step") + 1) * 500).alias("step"), q.alias("quality_ki"), F.pmod("event_id", F.lit(500)).cast("int").alias("plateau_counter"), (F.pmod("event_id", F.lit(3)) == 0).alias("boost_available"))
    before = F.lag("quality_ki").over(Window.partitionBy("run_id").orderBy("step"))
    return rows.withColumn("improvement", F.coalesce(F.col("quality_ki") - before, F.lit(0.0)))


#: The same views in SQL, in an order in which later ones may use earlier ones.
SQL = {
    "metrics": f"SELECT {RUN} AS run_id, 'loss' AS tag, row_number() OVER (PARTITION BY {RUN} ORDER BY ts, event_id) - 1 AS step, value / 10000 AS value, ts AS wall_time, event_id, user_id FROM events",
    "weights": "SELECT run_id, step, 0.5::DOUBLE + (event_id % 41) / 100.0::DOUBLE AS l1, 0.03::DOUBLE + (event_id % 37) / 100.0::DOUBLE AS ms, 0.04::DOUBLE + (event_id % 31) / 100.0::DOUBLE AS grad, 0.0::DOUBLE + (event_id % 29) / 100.0::DOUBLE AS perceptual FROM metrics",
    "activity": "SELECT run_id, step // 10 AS step, (user_id % 7)::INT AS layer_pos, round(avg(value * 100), 9) AS value FROM metrics GROUP BY ALL",
    "videos": """SELECT doc_id AS video_id, source || ' {edition-' || lang || '} ' || (doc_id % 7) || '.mkv' AS name, '/media/' || lang || '/' || doc_id AS path, n_chars::DOUBLE AS duration,
        CASE WHEN doc_id % 5 > 0 THEN (doc_id % 5 * 60)::INT END AS priority, lang,
        CASE lang WHEN 'en' THEN ['general', 'space', 'toon'] WHEN 'de' THEN ['space'] WHEN 'fr' THEN ['toon'] ELSE ['general'] END AS cats,
        CASE lang WHEN 'fr' THEN 0.5 ELSE 1.0 END::DOUBLE AS cat_sum FROM documents""",
    "weighted_videos": "SELECT video_id, name, duration, 0.1::DOUBLE + (video_id % 4) / 10.0::DOUBLE AS weight FROM videos",
    "limits": """SELECT *, greatest(1, floor("limit" * 0.01::DOUBLE)::INT) AS n_val, greatest(0, "limit" - greatest(1, floor("limit" * 0.01::DOUBLE)::INT)) AS n_train, greatest(1, floor(weight * 20)::INT) AS chunk FROM (SELECT *, floor(weight * 300)::INT AS "limit" FROM weighted_videos)""",
    "frames": """SELECT label AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_no, list_transform(embedding, lambda x: floor(greatest(0, least(1, x::DOUBLE + 0.5)) * 255)::INT) AS px FROM embeddings""",
    "units": "SELECT vec_id, label, list_transform(embedding, lambda x: greatest(0.0, least(1.0, x::DOUBLE + 0.5))::DOUBLE) AS a FROM embeddings",
    "image_pairs": "SELECT x.vec_id, x.label, x.a, y.a AS b FROM units x JOIN units y ON y.vec_id = x.vec_id + 1",
    "px": "SELECT vec_id, label, i // 8 AS y, i % 8 AS x, a[i + 1] AS a, b[i + 1] AS b FROM image_pairs, (SELECT unnest(range(64)) AS i)",
    "patches": "SELECT l_orderkey AS video_id, l_returnflag AS category, l_linestatus AS format, trunc(l_extendedprice)::BIGINT AS bytes, l_linenumber AS idx FROM lineitem",
    "gt": "SELECT o_orderkey AS filename FROM orders",
    "val_lr": "SELECT c_custkey * 11 AS filename FROM customer",
    "patch_lr": "SELECT DISTINCT l_orderkey AS filename FROM lineitem",
    "pairs": "SELECT filename, CASE WHEN filename IN (SELECT filename FROM val_lr) THEN 'Val' WHEN filename IN (SELECT filename FROM patch_lr) THEN 'Patches' END AS origin FROM gt",
    "checkpoints": "SELECT printf('checkpoint_step_%07d', o_orderkey) || CASE WHEN o_orderstatus = 'F' THEN '_emergency' ELSE '' END || '.pth' AS filename, o_orderkey AS step, o_orderstatus, least(1.0, o_totalprice / 500000) AS quality, o_totalprice / 1e6 AS loss, trunc(o_totalprice * 1024)::BIGINT AS bytes, o_orderdate AS timestamp, o_custkey AS custkey FROM orders",
    "entries": "SELECT c_nationkey AS run_id, c_custkey AS step, c_mktsegment AS param, c_acctbal AS value FROM customer UNION ALL SELECT c_nationkey, c_custkey, 'max_lr', (c_custkey % 5) / 1e4 FROM customer WHERE c_custkey % 3 = 0",
    "stats": """SELECT *, coalesce(quality_ki - lag(quality_ki) OVER (PARTITION BY run_id ORDER BY step), 0) AS improvement FROM (
        SELECT run_id, (step + 1) * 500 AS step, least(1.0, value * 25) AS quality_ki, (event_id % 500)::INT AS plateau_counter, event_id % 3 = 0 AS boost_available FROM metrics)""",
}


def sql(body: str, *names_: str, recursive: str = "") -> str:
    """``body`` after the views that it names."""
    known = [f"{n} AS ({q})" for n, q in SQL.items() if n in names_]
    if recursive:
        return "WITH RECURSIVE " + ", ".join([*known, recursive]) + " " + body
    return "WITH " + ", ".join(known) + " " + body if known else body
