"""Connected components of an edge table, by contraction: each round every node points to its neighbour of
least random rank, and edges are drawn anew between the nodes pointed to. The nodes shrink by a constant factor a
round, whatever the graph's shape; each round is a written table, so nothing is collected and no lineage grows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """id, component for each node of edges (a, b: long; most: a bound on their number): the smallest id that it reaches."""
    edges = written(edges.where("a <> b").select("a", "b").distinct(), "edges-0", most)
    maps = []
    while left := edges.count():
        n = len(maps)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(n)).alias("h"), F.col(c).alias("id"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        to = written(least.select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("to")), f"map-{n}", 2 * left)
        maps.append(to)
        moved = edges.join(to, edges.a == to.node).select(F.col("to").alias("a"), "b").join(to.withColumnRenamed("to", "other"), F.col("b") == F.col("node")).select("a", F.col("other").alias("b"))
        edges = written(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"edges-{n + 1}", left)
    if not maps:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    nodes = maps[0].count()
    roots = maps[-1].select("node", F.col("to").alias("root"))
    for to in reversed(maps[:-1]):
        # A node that was pointed to lives on in the next round; one that wasn't, takes its target's root.
        roots = written(to.join(roots.withColumnRenamed("node", "next"), F.col("to") == F.col("next"), "left").select("node", F.coalesce("root", "to").alias("root")), "roots", nodes)
    least = written(roots.groupBy("root").agg(F.min("node").alias("component")), "least", nodes)
    least = least.withColumn("component", F.least("component", "root"))
    return roots.join(least, "root").select(F.col("node").alias("id"), "component")
