"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headroom.sources.shared import cut_lineage


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node hangs on one root: no node has two edges upwards, and no root has one."""
    roots = edges.select(F.col("v").alias("u")).distinct().withColumn("root", F.lit(True))
    nodes = edges.groupBy("u").agg(F.count("*").alias("n")).join(roots, "u", "left")
    return nodes.where("n > 1 OR root").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of its component, for every node that has an edge (u, v).

    Large-star and small-star steps by turns: each links a node's neighbours to its smallest one, until all
    trees are stars. All work is grouped minima and joins on a node, so a node with very many neighbours
    is split, and a round's edges are stored, so a lost executor repeats one round at most.
    """
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = cut_lineage(now, "edges")
    while not _is_forest(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut_lineage(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut_lineage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
    smallest = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(smallest)
