"""Connected components by alternating stars.

Each round hangs every node's larger neighbours on the least of its neighbourhood, and then its smaller neighbours and
the node itself; rounds repeat until the edges no longer change, when every node hangs on the least node of its
component. A round is two aggregations and two joins; a node with very many edges is one side of an equi-join
with one row for each key, which adaptive execution splits. Rounds are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans import scratch

MOST_ROUNDS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have a < b; every b keeps its least a, which b's other neighbours hang on."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    others = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).filter("a <> b")
    return others.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge; component is the least node. Loops and nulls are ignored."""
    own = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    state, path = scratch.table(own, "edges")
    spark = edges.sparkSession
    seen = None
    for _ in range(MOST_ROUNDS):
        mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == seen:
            break
        seen = mark
        following, new_path = scratch.table(_small_star(_large_star(state)), "edges")
        scratch.drop(spark, path)
        state, path = following, new_path
    else:
        raise RuntimeError("components did not settle")
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(state.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
