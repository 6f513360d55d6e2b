"""Connected components by alternating large-star and small-star steps.

Each step replaces the edges by stars around smallest neighbours; the components stay the same and every node
ends at the smallest node of its component after a logarithmic number of steps in practice.  The smallest
neighbour of a node is a mergeable aggregate, so a node with any number of neighbours is combined before the
shuffle.  Steps are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans.materialize import stored


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b): the smallest node it is connected to."""
    current = stored(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(lowest, "u")
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        current = stored(small.filter("u > v").distinct(), "edges")
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
