"""Connected components by alternating large-star and small-star steps.

Native DataFrame work on an edge table of longs; every step is a partial
aggregation of minima plus an equi-join, so a hub that holds a third of all edges
is pre-aggregated before its shuffle and AQE can split its join.  No component
is ever collected: each step is written to the shared folder and read again.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.shared import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable.

    Nodes without an edge to another node are absent.  Null ends are ignored;
    self-loops and repeated edges have no effect; an empty table gives none.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.write(e, "edges")
    n = e.count()
    while True:
        # large star: each larger neighbour points to the smallest of the neighbourhood
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = scratch.write(low, "low")  # so that the join is between plain exchanges, which AQE can split
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                     .where("u <> v").distinct())
        large = scratch.write(large, "large")
        # small star: a node and its smaller neighbours point to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u")
                      .select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                                                F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
                      .select("s.u", "s.v").where("u <> v").distinct())
        small = scratch.write(small, "small")
        before, n = n, small.count()
        same = before == n and small.exceptAll(e).isEmpty()
        scratch.drop(e, low, large)
        e = small
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
