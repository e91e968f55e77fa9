"""Iterative traversals: neighbourhoods, blast radius, shortest paths, import cycles.

A step joins the frontier with the adjacency by equi-join and removes what has been visited by anti-join; steps are bounded
by a depth, and the state is written to the shared folder after each, so plans stay short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans import scratch

# Relations along which a change spreads.
DEPENDENCIES = ["calls", "indirect_call", "references", "imports", "imports_from", "dynamic_import", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "requires"]


def symmetric(pairs: DataFrame) -> DataFrame:
    """(src, dst) both ways, loops once."""
    return pairs.select(F.col("lo").alias("src"), F.col("hi").alias("dst")).unionByName(pairs.filter("lo <> hi").select(F.col("hi").alias("src"), F.col("lo").alias("dst")))


def reach(adjacency: DataFrame, seeds: DataFrame, depth: int, blocked: DataFrame | None = None) -> DataFrame:
    """(id, distance) within ``depth`` steps of the seeds (id); nodes in ``blocked`` (id) are reached, not expanded, unless seeds."""
    visited = scratch.save(seeds.select("id").distinct().withColumn("distance", F.lit(0)), "visited")
    for step in range(1, depth + 1):
        frontier = visited.filter(F.col("distance") == step - 1)
        if step > 1 and blocked is not None:
            frontier = frontier.join(blocked, "id", "left_anti")
        found = adjacency.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()
        fresh = found.join(visited.select("id"), "id", "left_anti").withColumn("distance", F.lit(step))
        visited = scratch.save(visited.unionByName(fresh), "visited")
    return visited


def induced(pairs: DataFrame, visited: DataFrame) -> DataFrame:
    """Edges between visited nodes, without loops."""
    ids = visited.select("id")
    return pairs.filter("lo <> hi").join(ids.withColumnRenamed("id", "lo"), "lo", "left_semi").join(ids.withColumnRenamed("id", "hi"), "hi", "left_semi")


def affected(edges: DataFrame, seed: str, depth: int = 2) -> DataFrame:
    """(id, depth, relation): what a change of the seed, or of what it contains, can reach backwards; the least relation of those that reach first."""
    spark = edges.sparkSession
    members = edges.filter((F.col("source") == seed) & F.col("relation").isin("method", "contains")).select(F.col("target").alias("id"))
    start = spark.createDataFrame([(seed,)], "id string").unionByName(members).distinct()
    visited = scratch.save(start.select("id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("relation")), "affected")
    back = edges.filter(F.col("relation").isin(DEPENDENCIES)).select(F.col("source").alias("id"), "target", "relation")
    for step in range(1, depth + 1):
        frontier = visited.filter(F.col("depth") == step - 1).select(F.col("id").alias("target"))
        found = back.join(frontier, "target", "left_semi").groupBy("id").agg(F.min("relation").alias("relation"))
        fresh = found.join(visited.select("id"), "id", "left_anti").select("id", F.lit(step).alias("depth"), "relation")
        visited = scratch.save(visited.unionByName(fresh), "affected")
    return visited.filter("depth > 0")


def shortest_path(arcs: DataFrame, source: str, target: str, most: int = 8) -> DataFrame:
    """(hop, id) along a shortest path over (src, dst); of equal paths the one whose nodes, from the end back, are least."""
    spark = arcs.sparkSession
    visited = scratch.save(spark.createDataFrame([(source, 0, None)], "id string, distance int, parent string"), "path")
    for step in range(1, most + 1):
        if visited.filter(F.col("id") == target).limit(1).count():
            break
        frontier = visited.filter(F.col("distance") == step - 1).select(F.col("id").alias("src"))
        found = arcs.join(frontier, "src", "left_semi").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        fresh = found.join(visited.select("id"), "id", "left_anti").select("id", F.lit(step).alias("distance"), "parent")
        visited = scratch.save(visited.unionByName(fresh), "path")
    # Back from the target, one bounded lookup for each hop.
    rows, at = [], target
    while at is not None:
        r = visited.filter(F.col("id") == at).first()
        if r is None:
            return spark.createDataFrame([], "hop int, id string")
        rows.append((r.distance, r.id))
        at = r.parent
    return spark.createDataFrame(rows, "hop int, id string")


def cycles(arcs: DataFrame, longest: int = 5) -> DataFrame:
    """(length, path) of the simple cycles of up to ``longest`` arcs (src, dst), each from its least node on."""
    own = arcs.select("src", "dst").distinct()
    found = own.filter("src = dst").select(F.lit(1).alias("length"), F.array("src").alias("path"))
    walks = own.filter("src < dst").select(F.array("src", "dst").alias("path"), F.col("dst").alias("at"))
    for n in range(2, longest + 1):
        closing = walks.join(own.select(F.col("src").alias("at"), F.col("dst").alias("home")), "at").filter("home = path[0]")
        found = found.unionByName(closing.select(F.lit(n).alias("length"), "path"))
        if n < longest:
            longer = walks.join(own.select(F.col("src").alias("at"), F.col("dst").alias("next")), "at").filter("next > path[0] and not array_contains(path, next)")
            walks = scratch.save(longer.select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("at")), "walks")
    return found


def neighbours(edges: DataFrame, node: str, relation: str | None = None) -> DataFrame:
    """(direction, id, relation, confidence) of a node's edges."""
    own = edges if relation is None else edges.filter(F.col("relation") == relation)
    out = own.filter(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "relation", "confidence")
    return out.unionByName(own.filter(F.col("target") == node).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "relation", "confidence"))
