"""Connected components of an edge table, by alternating star contractions.

``large star`` joins every larger neighbour of a node to the least node of its
neighbourhood, ``small star`` joins a node and its smaller neighbours to the least of them.
Both are one aggregate with map-side combining and one join on the node; the edges
shrink to stars whose centre is the least node of the component. A node with very many
neighbours is one row on the aggregated side of the join, and its edges are a
skewed partition that Spark splits. Every round is a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shared, write_shared


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.where(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``edges`` (columns u, v, of one orderable type); root is its least node.

    Loops and nulls are dropped; edges may repeat and point either way.
    """
    now = write_shared(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                       .distinct(), name)

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = state(now)
    while seen[0]:
        mid = write_shared(_large_star(now), name)
        new = write_shared(_small_star(mid), name)
        drop_shared(now)
        drop_shared(mid)
        now, last = new, seen
        seen = state(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
