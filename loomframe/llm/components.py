"""Connected components by rounds of contraction.

In each round every node moves to the neighbour with the smallest priority, if that is smaller than its own; priorities
are hashes of node and round, so a constant share of the nodes is expected to vanish each round whatever the graph
looks like. Edges between moved nodes form the next graph. Each round's tables are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the stored ``edges`` (a, b); nodes without an edge do not appear."""
    labels, step = None, 0
    while not edges.isEmpty():
        rank = lambda c: F.xxhash64(F.lit(step), F.col(c))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("p"), F.col("b"))).alias("m"))
        moved = stored(
            best.select(F.col("a").alias("node"), F.when(F.struct(rank("a").alias("p"), F.col("a")) < F.struct("m.p", F.col("m.b").alias("a")), F.col("a")).otherwise(F.col("m.b")).alias("root")),
            "moves",
        )
        to_a, to_b = (moved.select(F.col("node").alias(c), F.col("root").alias(f"{c}2")) for c in "ab")
        ends = edges.join(to_a, "a").join(to_b, "b").where("a2 <> b2")
        if labels is None:
            labels = moved
        else:
            on = moved.select(F.col("node").alias("root"), F.col("root").alias("next"))
            labels = stored(labels.join(on, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "labels")
        edges = stored(ends.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges")
        step += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
