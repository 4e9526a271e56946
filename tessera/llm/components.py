"""Connected components of a graph given as edges, by alternating large and small stars; every step is joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) of each node that has an edge; label is the least node of its component. Null ends and loops are ignored."""
    # u is the greater end of each edge
    now = scratch.write(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        ends = now.select("u", "v", F.lit(1).alias("down")).unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit(0).alias("down")))
        near = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum("down").alias("down"), F.sum(1 - F.col("down")).alias("up"))
        near = scratch.write(near, "near")
        # done when all is stars: a node points at one other, and then none points at it
        if near.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") > 0))).agg(F.count(F.lit(1))).first()[0] == 0:
            return scratch.write(near.select(F.col("u").alias("node"), F.col("m").alias("label")), "labels")
        # large star: a node's greater neighbours are tied to the least of it and its neighbours
        large = now.select(F.col("v").alias("at"), F.col("u").alias("far")).join(near.select(F.col("u").alias("at"), "m"), "at")
        large = scratch.write(large.select(F.col("far").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: a node and its smaller neighbours are tied to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, scratch.write(tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small")
        scratch.drop(before, near, large)
