"""Writers: node-link JSON, Cypher, GraphML, a Markdown report, notes.

Rows are rendered by SQL functions in tasks and written by Spark's text sink; only documents that are one file by nature
(a JSON graph, a report) are written as one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_link_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, json), in canonical order of kind and key; keys of objects are sorted."""
    as_json = lambda df: F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]))
    n = nodes.select(F.lit("nodes").alias("kind"), F.col("id").alias("key"), as_json(nodes).alias("json"))
    return n.unionByName(edges.select(F.lit("links"), F.concat_ws("\u0001", "source", "target", "relation"), as_json(edges)).toDF("kind", "key", "json"))


def _escaped(value: Column) -> Column:
    return F.replace(F.replace(F.coalesce(value, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def cypher(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line) statements that create the graph, nodes before edges when read in the order of ``place``."""
    kind = F.regexp_replace(F.initcap("file_type"), "[^A-Za-z]", "")
    n = nodes.select(F.lit(0).alias("place"), F.format_string("MERGE (n:%s {id: '%s'}) SET n.label = '%s';", kind, _escaped(F.col("id")), _escaped(F.col("label"))).alias("line"))
    e = edges.select(F.lit(1).alias("place"), F.format_string("MATCH (a {id: '%s'}), (b {id: '%s'}) MERGE (a)-[:%s]->(b);", _escaped(F.col("source")), _escaped(F.col("target")), F.upper(F.regexp_replace("relation", "[^A-Za-z_]", "_"))).alias("line"))
    return n.unionByName(e)


def _xml(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(place, line) of a GraphML document's body."""
    n = nodes.select(F.lit(0).alias("place"), F.format_string('<node id="%s"><data key="label">%s</data></node>', _xml(F.col("id")), _xml(F.col("label"))).alias("line"))
    return n.unionByName(edges.select(F.lit(1).alias("place"), F.format_string('<edge source="%s" target="%s"><data key="relation">%s</data></edge>', _xml(F.col("source")), _xml(F.col("target")), _xml(F.col("relation"))).alias("line")))


def note_pages(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, text): a page for each node, with links to what it points to."""
    links = edges.select(F.col("source").alias("id"), F.format_string("- [[%s]] (%s)", "target", "relation").alias("l")).groupBy("id").agg(F.array_join(F.array_sort(F.array_distinct(F.collect_list("l"))), "\n").alias("links"))
    return nodes.join(links, "id", "left").select(F.col("id").alias("name"), F.concat(F.lit("# "), "label", F.lit("\n\n"), F.coalesce("links", F.lit(""))).alias("text"))


def report(stats: DataFrame, gods: DataFrame, surprises: DataFrame) -> DataFrame:
    """(place, line) of a Markdown report from three small results."""
    s = stats.select(F.lit(0).alias("place"), F.format_string("%d nodes, %d edges, %d communities", "n_nodes", "n_edges", "n_communities").alias("line"))
    g = gods.select(F.lit(1).alias("place"), F.format_string("- %s: %d connections", "label", "degree").alias("line"))
    return s.unionByName(g).unionByName(surprises.select(F.lit(2).alias("place"), F.format_string("- %s and %s (%s, score %d)", "lo", "hi", "relation", "score").alias("line")))


def write_lines(lines: DataFrame, path: str) -> None:
    """One text file, by ``place`` and line."""
    (lines if "place" in lines.columns else lines.withColumn("place", F.lit(0))).repartition(1).sortWithinPartitions("place", "line").select("line").write.mode("overwrite").text(path)


def guarded_overwrite(new: DataFrame, old_count: int, path: str) -> None:
    """Overwrites a stored table unless it would shrink."""
    if (n := new.count()) < old_count:
        raise ValueError(f"{n} rows would replace {old_count}")
    new.write.mode("overwrite").parquet(path)
