"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is an aggregation to the least neighbour (with map-side partial
aggregation, so a hub is one row a task) and a join of edges to these minima,
whose skewed partitions adaptive execution splits. No neighbourhood is ever
collected. Edges are written to the shared folder after each round; the number
of rounds grows with the logarithm of a component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import Scratch


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (a, b: long, no nulls) the least node it reaches.

    Loops (a = b) only say that a node is there. Repeated edges count once.
    """
    scratch = Scratch(edges.sparkSession)
    pairs = scratch.save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    first = pairs
    for _ in range(most):
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: each larger neighbour of a node is hung on the least of its neighbours and itself
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = scratch.save(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: each smaller neighbour, and the node itself, is hung on the least neighbour
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        new = scratch.save(small, "edges")
        # done when every node hangs on one root and no root hangs on another node
        moving = new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count() or new.select("b").join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()
        scratch.drop(large)
        if pairs is not first:
            scratch.drop(pairs)
        pairs = new
        if not moving:
            break
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    nodes = first.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    return nodes.join(pairs.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
