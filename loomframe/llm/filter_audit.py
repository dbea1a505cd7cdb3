"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Every document is told by which filters it fails. Per part (language) the documents, the good and the toxic ones are
counted by these five flags: three contingency tables of 2 x 2 x 2 x 2 x 2. One ``einsum`` contracts a table with
selectors that take pass, fail or all along each axis; an order and step of the chain is one row of selectors, so all 600
of them come from one contraction, and no document is read again for an order.

Texts are read once. Copies are found from digests: rows are counted by digest, part and label first, so that a large
group of copies is a few rows before its smallest doc_id is looked for.

Defined cases: a null text is empty, a null lang the part '' (with any empty lang); a document without labels is neither
good nor toxic, with several it is what any of them says; rows that repeat a doc_id count each, and are no copies of each
other alone; a row with a null doc_id counts, is no copy and has no label; labels of unknown documents are harmless; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import string
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomframe.llm.common import WORD, stored, table
from loomframe.session import ship

#: Counts by kind of document, in the order of the tables' first axis.
KINDS = ("n", "good", "toxic")


def text_rules(text: Column) -> dict[str, Column]:
    """Failures that the text alone decides: few words, repetitive, shouting, symbols."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": n < 100,
        "B": distinct * 100 < n * 80,
        "C": capitals * 100 > F.length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def flags(docs: DataFrame, rules=text_rules) -> DataFrame:
    """doc_id, part, digest of the text, and ``mask``, the failures of ``rules`` as bits, the first the highest."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), F.array(*rules(text).values()).alias("fails"))
    mask = F.aggregate("fails", F.lit(0), lambda acc, x: acc * 2 + x.cast("int"))
    return read.select("doc_id", "part", "digest", mask.alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, rules=text_rules) -> DataFrame:
    """Counts by part and ``mask``, whose lowest bit is the failure of being a copy of a smaller doc_id's text."""
    rows = stored(flags(docs, rules), "flags")
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))])
    named = rows.where("doc_id is not null").join(said, "doc_id", "left").na.fill(0, ["good", "toxic"])
    keys = ["digest", "part", "mask", "good", "toxic"]
    one = named.groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    nameless = rows.where("doc_id is null").withColumns({"good": F.lit(0), "toxic": F.lit(0)}).groupBy("doc_id", *keys).agg(F.count("*").alias("n"))
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    alike = one.unionByName(nameless).groupBy(*keys).agg(first.alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"))
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))  # rows of a digest: its parts and labels
    kept = F.col("nameless") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    split = F.explode(F.array(F.struct((F.col("mask") * 2).alias("mask"), F.col("kept").alias("n")), F.struct((F.col("mask") * 2 + 1).alias("mask"), (F.col("n") - F.col("kept")).alias("n"))))
    out = alike.withColumn("least", least).withColumn("kept", kept).select("part", "good", "toxic", split.alias("s")).select("part", "good", "toxic", "s.*")
    return out.groupBy("part", "mask").agg(*[F.sum(F.col("n") if k == "n" else F.col("n") * F.col(k)).alias(k) for k in KINDS])


def selectors(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every (order, step), and for each measure its rows of selectors (step, axis, take pass, take fail)."""
    steps = [("".join(order), k) for order in permutations(filters) for k in range(1, len(order) + 1)]
    every, ok, bad = (1, 1), (1, 0), (0, 1)

    def rows(pick) -> np.ndarray:
        return np.array([[pick(order.index(f) - (k - 1)) for f in filters] for order, k in steps], np.int64)

    return steps, {
        "kept": rows(lambda at: ok if at <= 0 else every),
        "removed": rows(lambda at: ok if at < 0 else bad if at == 0 else every),
        "failing": rows(lambda at: bad if at == 0 else every),
        "unique_fails": rows(lambda at: bad if at == 0 else ok),
    }


def contracted(counts: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``counts`` (kind, 2, 2, ...) by ``chosen`` (row, axis, 2): what each row of selectors takes, by kind."""
    axes = string.ascii_lowercase[: chosen.shape[1]]
    terms = ",".join(f"z{a}" for a in axes)
    return np.einsum(f"y{axes},{terms}->yz", counts, *chosen.transpose(1, 0, 2), optimize=True)


def audit(cells: DataFrame, filters: str) -> DataFrame:
    """Every part, order and step of the chain ``filters`` over ``cells`` (part, mask, n, good, toxic)."""
    ship(cells.sparkSession)
    steps, chosen = selectors(filters)

    def of(part: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((len(KINDS), 2 ** len(filters)), np.int64)
        counts[:, part["mask"]] = part[list(KINDS)].to_numpy().T
        counts = counts.reshape(len(KINDS), *(2,) * len(filters))
        got = {name: contracted(counts, rows) for name, rows in chosen.items()}
        out = pd.DataFrame(steps, columns=["filter_order", "step"]).assign(part=part["part"].iloc[0])
        out = out.assign(kept=got["kept"][0], removed=got["removed"][0], redundant=got["failing"][0] - got["removed"][0], unique_fails=got["unique_fails"][0])
        out = out.assign(good_lost=got["removed"][1], toxic_lost=got["removed"][2])
        letter = [order[k - 1] for order, k in steps]
        return out.assign(shapley=out["removed"].groupby(letter).transform("sum"))

    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return cells.groupBy("part").applyInPandas(of, "filter_order string, step int, part string, " + ", ".join(f"{m} long" for m in measures))


def query(spark, sf_dir: str) -> DataFrame:
    """op13: the chain A to E over all documents."""
    return audit(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "ABCDE")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), f AS (
  SELECT doc_id, part, len(words) < 100 AS A, len(list_distinct(words)) * 100 < len(words) * 80 AS B,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) * 100 > length(text) * 10 AS C, regexp_matches(text, '[#$%&*|]') AS D,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS E
  FROM d
), said AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY 1
), cells AS (
  SELECT part, MAP {'A': A, 'B': B, 'C': C, 'D': D, 'E': E} AS fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM f LEFT JOIN said USING (doc_id) GROUP BY part, A, B, C, D, E
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, unnest(range(1, 6)) AS step
  FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), hits AS (
  SELECT part, filter_order, step, n, good, toxic, fails[filter_order[step]] AS here,
         len(list_filter(string_split(filter_order[1:step - 1], ''), lambda x: x <> '' AND fails[x])) > 0 AS before,
         len(list_filter(map_values(fails), lambda x: x)) AS failing
  FROM cells, orders
), steps AS (
  SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT before AND NOT here), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT before AND here), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (before AND here), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (here AND failing = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (NOT before AND here), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (NOT before AND here), 0)::BIGINT AS toxic_lost
  FROM hits GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM steps
"""
