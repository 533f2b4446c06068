"""Connected components by alternating large and small stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.llm.common import written


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """Hang the neighbours of each node on its least neighbour (or itself).

    The large star moves the greater neighbours; the small star moves the node and its
    smaller ones. Either keeps the components and shortens the paths.
    """
    pairs = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = pairs.groupBy("a").agg(F.min("b").alias("_least")).withColumn("_least", F.least("a", "_least"))
    met = pairs.join(least, "a")
    if small:
        # Here b < a always: the smaller neighbours and the node itself go to the least of them.
        moved = met.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionByName(
            least.select("a", F.col("_least").alias("b"))
        )
    else:
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    return moved.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``: the least node it is connected with.

    Rounds are written tables and go on until a round changes nothing. A node with a third
    of all edges is a key that Spark splits in the join, and one row after the minimum.
    """
    edges = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "components-0"
    )
    seen, number = None, 0
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen, number = tuple(state), number + 1
        large = written(_starred(edges, False), f"components-{number}-large")
        edges = written(_starred(large, True), f"components-{number}")
    # Stars: each node hangs on its root.
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
