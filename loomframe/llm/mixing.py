"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words by weight. A source whose share passes the cap (a number of epochs) is clamped there,
and what it leaves is shared again among the others by weight, until none is above its cap. The fill level of a round
needs only two sums over the table of sources, so each round is one aggregation.

Repetitions are whole and fractional: every document is taken ``floor(target / size)`` times, and the rest of the
target by a seeded draw without replacement. Documents above a hundredth of their source (at most a hundred in each)
are visited in the order of their draws and taken while they fit into their share of the rest; what they leave open
passes to the small ones, which are taken below a threshold on the draw. The threshold comes from a histogram of the
draws in 1,024 buckets, so no source is ever gathered or sorted, however large.

Built-in functions only. Defined cases: a null text has no words; a null source is a source of its own and comes last;
rows equal in doc_id, source and size are drawn together; a source without words has target zero; an empty table gives
an empty result; identifiers of any type do; further columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import WORD, bounded, draw, numbered, stored, table

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, 17
BUCKETS, BIG = 1024, 100


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: float, epochs: int = EPOCHS) -> DataFrame:
    """``sources`` (stored; source_size, weight) with ``target``: shares of ``budget`` by weight, clamped and refilled."""
    cap = (F.col("source_size") * epochs).cast("double")
    total = sources.agg(F.sum("weight").alias("w")).first().w or 1
    level, clamped = budget / total, 0
    while True:
        over = cap < F.col("weight") * F.lit(level)
        now = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap)).alias("caps"), F.sum(F.when(~over, F.col("weight"))).alias("w")).first()
        if now.n == clamped or not now.w:
            return sources.withColumn("target", F.when(over, cap).otherwise(F.col("weight") * F.lit(level)))
        level, clamped = (budget - now.caps) / now.w, now.n


def plan(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """For a stored table (doc_id, source, size, u): what each source takes, and what its big documents do.

    The first has source, source_size, target, whole, theta; the second source, doc_id, size, extra.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = numbered(sizes, F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("ordinal") % len(weights) + 1).cast("int"))
    sources = stored(ranked.select("source", "source_size", cycle.alias("weight")), "sources")
    budget = (sources.agg(F.sum("source_size").alias("s")).first().s or 0) * share
    filled = stored(
        water_fill(sources, budget, epochs)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    rows = sized.join(bounded(filled.withColumnRenamed("source", "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    is_big = F.col("size") * BIG > F.col("source_size")
    big = stored(_big(rows.where(is_big)), "big-documents")
    small = rows.where(~is_big & (F.col("size") > 0)).groupBy("source", F.floor(F.col("u") * BUCKETS).alias("bucket")).agg(F.sum("size").alias("words"))
    taken = big.groupBy("source").agg(F.sum(F.col("size") * F.col("extra") * F.col("n")).alias("big_words"))
    left = filled.join(taken.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        *filled.columns, (F.col("rest") - F.coalesce("big_words", F.lit(0))).alias("left")
    )
    upto = Window.partitionBy("source").orderBy("bucket")  # at most 1,024 rows
    before = small.select("source", "bucket", "words", (F.sum("words").over(upto) - F.col("words")).alias("before"))
    cut = (F.col("bucket") + F.least(F.lit(1.0), (F.col("left") - F.col("before")) / F.col("words"))) / BUCKETS
    theta = (
        left.join(before.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left")
        .groupBy("source", "source_size", "target", "whole")
        .agg(F.coalesce(F.max(F.when(F.col("before") < F.col("left"), cut)), F.lit(0.0)).alias("theta"))
    )
    return stored(theta, "mix"), big


def _big(rows: DataFrame) -> DataFrame:
    """Big documents of each source (at most a hundred) in the order of their draws, taken while they fit."""
    units = rows.groupBy("source", "source_size", "rest", "doc_id", "size", "u").agg(F.count("*").alias("n"))
    lists = units.groupBy("source", "source_size", "rest").agg(F.sort_array(F.collect_list(F.struct("u", "doc_id", "size", "n"))).alias("docs"), F.sum(F.col("size") * F.col("n")).alias("all"))
    goal = F.col("rest") * F.col("all") / F.col("source_size")
    kind = dict(rows.dtypes)["doc_id"]
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast(f"array<struct<doc_id:{kind},size:bigint,n:bigint,extra:int>>").alias("out"))

    def visit(acc: Column, d: Column) -> Column:
        fits = acc["sum"] + d["size"] * d["n"] <= goal
        row = F.struct(d["doc_id"].alias("doc_id"), d["size"].alias("size"), d["n"].alias("n"), fits.cast("int").alias("extra"))
        return F.struct(F.when(fits, acc["sum"] + d["size"] * d["n"]).otherwise(acc["sum"]).alias("sum"), F.concat(acc["out"], F.array(row)).alias("out"))

    return lists.select("source", F.inline(F.aggregate("docs", start, visit)["out"]))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), draw(seed, F.col("doc_id")).alias("u"))


def _copies(rows: DataFrame, mix: DataFrame, big: DataFrame, k: str) -> DataFrame:
    """``rows`` (with doc_id, source, size, u under the prefix ``k``) with source_size, target and copies under it."""
    c = lambda name: F.col(f"{k}_{name}")
    mix = bounded(mix.select(*[F.col(n).alias(f"{k}_mix_{n}") for n in mix.columns]))
    big = bounded(big.select(*[F.col(n).alias(f"{k}_big_{n}") for n in ("source", "doc_id", "size", "extra")]))
    on = c("source").eqNullSafe(c("big_source")) & c("doc_id").eqNullSafe(c("big_doc_id")) & (c("size") == c("big_size"))
    extra = F.coalesce(c("big_extra"), ((c("size") * BIG <= c("mix_source_size")) & (c("u") < c("mix_theta"))).cast("int"))
    return rows.join(mix, c("source").eqNullSafe(c("mix_source"))).join(big, on, "left").withColumn(f"{k}_copies", (c("mix_whole") + extra).cast("long"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it."""
    k = "m" + uuid.uuid4().hex
    known = stored(sized(docs, seed), "sizes")
    own = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": words(F.col("text")), "u": draw(seed, F.col("doc_id"))}
    rows = docs.select("*", *[c.alias(f"{k}_{n}") for n, c in own.items()])
    out = _copies(rows, *plan(known, weights, share, epochs), k)
    each = F.explode(F.array_repeat(F.lit(0), F.col(f"{k}_copies").cast("int")))
    return out.where(f"{k}_copies > 0").withColumn(f"{k}_copies", each).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: what the mix takes of every document."""
    known = stored(sized(table(spark, sf_dir, "documents")), "sizes")
    rows = known.select(*[F.col(c).alias(f"m_{c}") for c in known.columns])
    out = _copies(rows, *plan(known), "m")
    return out.select(
        F.col("m_doc_id").alias("doc_id"),
        F.col("m_size").alias("size"),
        F.col("m_mix_source_size").alias("source_size"),
        F.col("m_mix_target").alias("target"),
        (F.col("m_size") * F.col("m_copies")).alias("taken"),
    )


SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', '17', doc_id)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0 * sum(size)::DOUBLE AS cap,
         [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w
  FROM sized GROUP BY source
), ordered AS (
  SELECT *, (SELECT 1.5 * sum(source_size)::DOUBLE FROM sources) AS budget,
         coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws,
         row_number() OVER (ORDER BY cap / w, source NULLS LAST) AS k
  FROM sources
), level AS (
  SELECT arg_min((budget - caps) / ws, k) AS l FROM ordered WHERE w * ((budget - caps) / ws) <= cap
), filled AS (
  SELECT source, source_size, CASE WHEN cap < w * l THEN cap ELSE w * l END AS target,
         CASE WHEN source_size > 0 THEN floor((CASE WHEN cap < w * l THEN cap ELSE w * l END) / source_size) ELSE 0 END AS whole
  FROM sources, level
), rows_ AS (
  SELECT d.*, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest, d.size * 100 > f.source_size AS big
  FROM sized d JOIN filled f ON d.source IS NOT DISTINCT FROM f.source
), units AS (
  SELECT source, doc_id, size, count(*) AS n, any_value(rest) * (sum(sum(size)) OVER (PARTITION BY source))::DOUBLE / any_value(source_size) AS goal,
         row_number() OVER (PARTITION BY source ORDER BY u, doc_id, size) AS k
  FROM rows_ WHERE big GROUP BY source, doc_id, size, u
), visit AS (
  SELECT source, doc_id, size, n, k, goal, (size * n <= goal)::INT AS extra, CASE WHEN size * n <= goal THEN size * n ELSE 0 END AS s FROM units WHERE k = 1
  UNION ALL
  SELECT u.source, u.doc_id, u.size, u.n, u.k, u.goal, (v.s + u.size * u.n <= u.goal)::INT, CASE WHEN v.s + u.size * u.n <= u.goal THEN v.s + u.size * u.n ELSE v.s END
  FROM visit v JOIN units u ON u.source IS NOT DISTINCT FROM v.source AND u.k = v.k + 1
), left_ AS (
  SELECT f.source, f.target - f.whole * f.source_size - coalesce((SELECT max(s) FROM visit v WHERE v.source IS NOT DISTINCT FROM f.source), 0) AS remaining FROM filled f
), buckets AS (
  SELECT source, floor(u * 1024) AS bucket, sum(size)::DOUBLE AS words FROM rows_ WHERE NOT big AND size > 0 GROUP BY 1, 2
), before_ AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) - words AS before FROM buckets
), theta AS (
  SELECT l.source, coalesce(max(CASE WHEN before < remaining THEN (bucket + least(1.0, (remaining - before) / words)) / 1024 END), 0) AS theta
  FROM left_ l LEFT JOIN before_ b ON l.source IS NOT DISTINCT FROM b.source GROUP BY l.source
)
SELECT r.doc_id, r.size, r.source_size, r.target,
       (r.size * (r.whole + CASE WHEN r.big THEN v.extra ELSE (r.u < t.theta)::INT END))::BIGINT AS taken
FROM rows_ r JOIN theta t ON r.source IS NOT DISTINCT FROM t.source
LEFT JOIN visit v ON r.big AND r.source IS NOT DISTINCT FROM v.source AND r.doc_id IS NOT DISTINCT FROM v.doc_id AND r.size = v.size
"""
