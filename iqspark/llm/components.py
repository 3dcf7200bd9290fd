"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node with more edges than this, and than one in HOT_SHARE of all, is a hub: its edges are joined where they stand.
HOT_EDGES, HOT_SHARE = 500, 10_000


def to_least(edges: DataFrame, key: str, least: DataFrame, total: int) -> DataFrame:
    """edges with m, the value of least(u, m, c) where key = u (every key has one). Edges of hubs meet a broadcast table
    of at most 2 * HOT_SHARE rows, as c counts edges; so no task holds a hub's edges together, and all others shuffle."""
    hot = F.col("c") > max(HOT_EDGES, 2 * total // HOT_SHARE)
    hubs = least.where(hot).select(F.col("u").alias("hub"), F.col("m").alias("hub_m"))
    marked = edges.join(F.broadcast(hubs), F.col(key) == F.col("hub"), "left")
    rest = marked.where("hub IS NULL").drop("hub", "hub_m").join(least.where(~hot).select("u", "m"), F.col(key) == F.col("u")).drop("u")
    return marked.where("hub IS NOT NULL").withColumn("m", F.col("hub_m")).drop("hub", "hub_m").unionByName(rest)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge joins to another one.

    edges: two columns of one orderable type, any direction; nulls, self-loops and repeated rows are ignored. Nodes
    without an edge are not returned. Every round is a few joins and map-side combined minima, written to the shared
    folder in place of the round before; rounds go on until one moves no edge, which each edge says of itself. Nothing
    but counts reaches the driver, no group is gathered in one task, and the edges of a hub are not brought together.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    stars = materialize(edges.where(F.col(a) != F.col(b)).select(hi.alias("a"), lo.alias("b")).distinct().withColumn("moved", F.lit(True)), "edges")
    while True:
        count = stars.agg(F.count("*").alias("n"), F.count_if("moved").alias("moved")).first()
        if not count["moved"]:
            break
        # Large star: the larger neighbours of u move to the least of u and its neighbours.
        both = stars.select("a", "b").union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("u")).agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("c"))
        moved = F.max(F.col("m") != F.col("b")).alias("moved")
        large = to_least(stars.select("a", "b"), "b", least, count["n"]).groupBy("a", F.col("m").alias("b_")).agg(moved).withColumnRenamed("b_", "b")
        large = materialize(large, "large")
        # Small star: u and its smaller neighbours move to the least of them.
        small = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count("*").alias("c"), F.max("moved").alias("moved"))
        again = to_least(large.select("a", "b"), "a", small, count["n"]).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"), F.lit(True).alias("moved"))
        after = materialize(again.union(small.select("u", "m", "moved")).groupBy("a", "b").agg(F.max("moved").alias("moved")), "edges")
        discard(stars, large)
        stars = after
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
