"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is one shuffle of the edges by node; its result is written to the shared folder, so a lost executor costs
a task and not the history, and neither edges nor components reach the driver. A node's neighbours are never
gathered: a step needs only their least, which the map side aggregates in part, so a hub costs one partial row for
each task, and the edges meet that minimum in a join whose large partitions Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quelora.llm.common import materialize


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the least of its neighbours and itself."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least(both).withColumn("m", F.least("m", "u"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of each node, and the node, to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, part) for each node of the edges (a long, b long); part is the least node of its component."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = _state(now)
    while before[0]:
        now = materialize(_small_star(_large_star(now)), "components")
        after = _state(now)
        if after == before:
            break
        before = after
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("part"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("part"))).distinct()
