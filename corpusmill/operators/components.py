"""Connected components of an edge table, by alternating large and small stars.

Each round rewires edges towards the least neighbour; rounds grow with the logarithm of the number of nodes. A round is a
min per node, combined before its shuffle, and a join whose other side has one row a node, so a hub's edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.sources.scratch import written


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.toDF("u", "v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v: longs, in any order, repeated or not): the least node reachable.

    Loops and nulls are left out; a node without other edges is not in the result. An empty table gives an empty one.
    """
    e = written(edges.dropna().filter("u <> v").select("u", "v").distinct())
    state = None
    while True:
        e = written(_small(_large(e)))
        now = e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
