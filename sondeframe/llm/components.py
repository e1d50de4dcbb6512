"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondeframe.llm.common import materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is its smallest node.

    Each round replaces every edge twice: large-star ties a node's larger
    neighbours to the smallest node it sees, small-star does the same with its
    smaller ones.  Both keep components and shorten them, so that a number of
    rounds like the logarithm of the longest path leaves only stars.  Rows stay
    on the executors; each step is cut with a checkpoint, which also lets the
    joins be dealt anew where the neighbours of one node are many.
    """
    now = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct()
    )
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        centre = materialise(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
        large = materialise(
            both.filter("v > u").join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        )
        low = materialise(large.groupBy("u").agg(F.min("v").alias("m")))
        small = (
            large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        )
        now = materialise(small)
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if (row["n"], row["x"]) == state:
            break
        state = (row["n"], row["x"])
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
