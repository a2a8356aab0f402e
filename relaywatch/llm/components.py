"""Connected components of an edge table, by alternating star contraction.

Each round rewires every node to the smallest node it has seen, first over all
its neighbours (large star), then over its smaller ones (small star), until the
edges are stars around the smallest node of each component. Rounds grow with
the logarithm of the longest path. Every round is written to the shared folder,
so a lost executor repeats one round's tasks only.

A star's centre holds one edge for each member. Those edges are dealt by
(node, salt of the other end), and the minimum of each node is copied to the
salts, so no task gets a whole hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaywatch.llm.common import Scratch

SALTS = 8


def _rewire(edges: DataFrame, smallest: DataFrame) -> DataFrame:
    """edges(u, v) with the smallest neighbour m of u, dealt by u and a salt of v."""
    salts = F.array(*[F.lit(i) for i in range(SALTS)])
    spread = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    copies = smallest.select("u", "m", F.explode(salts).alias("salt"))
    return spread.join(copies, ["u", "salt"]).select("u", "v", "m")


def connected_components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component_id) for every node of ``edges(a, b)``; others are their own.

    Null ends, self links and repeated edges are allowed and mean nothing more.
    """
    edges = scratch.write(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = _rewire(both.filter("v > u"), smallest).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large)
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _rewire(large, smallest).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = scratch.write(small.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    centres = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component_id")).unionByName(centres)
