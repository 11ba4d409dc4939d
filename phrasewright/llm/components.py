"""Connected components of links, as DataFrames: large-star and small-star steps until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one edge, to a root that has none: then the edges are the answer."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").isEmpty()


def connected_components(links: DataFrame, tasks: int | None = None) -> DataFrame:
    """links: a long, b long. Returns node long, component long (the smallest node reachable) for every linked node.

    Each round is two aggregations by key with map-side combining and two joins; rounds grow with the logarithm of
    the longest chain. Both sides of a join are read from tables, never from the aggregation of the same exchange: so the rows of
    a star's centre, one key, can be split between tasks where adaptive execution finds them skewed. Rounds are written to the shared
    folder, by so many tasks at most, so no lineage builds up. Null ends and self-links are left out; repeated links count
    once; no links give no rows.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = materialise(links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links", tasks)
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least", tasks)
        # a node passes its least neighbour to the larger ones, and a smaller one needs nothing from it
        large = materialise(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large", tasks)
        lower = materialise(large.groupBy("u").agg(F.min("v").alias("m")), "lower", tasks)
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialise(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "small", tasks)
        for done in (edges, least, large, lower):
            discard(done)
        edges = new
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
