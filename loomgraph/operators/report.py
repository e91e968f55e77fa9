"""Roll-ups for reports: directory trees, diagrams, explanations, pull requests, token economy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import symmetric


def directory_totals(files: DataFrame, path: str = "path") -> DataFrame:
    """(dir, depth, total) of all directories above files; the root is ''."""
    parts = F.split(F.col(path), "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))
    return files.select(F.explode(prefixes).alias("p")).groupBy("p.dir", "p.depth").agg(F.count("*").alias("total"))


def section_edges(edges: DataFrame, sections: DataFrame) -> DataFrame:
    """(a, b, n) edges from one section to another, of (id, section)."""
    s = edges.join(sections.select(F.col("id").alias("source"), F.col("section").alias("a")), "source").join(sections.select(F.col("id").alias("target"), F.col("section").alias("b")), "target")
    return s.filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))


def extension_histogram(files: DataFrame, top: int = 3) -> DataFrame:
    ext = F.regexp_extract("path", r"(\.[^./]+)$", 1)
    return files.groupBy(F.lower(ext).alias("extension")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "extension").limit(top)


def edge_scores(edges: DataFrame) -> DataFrame:
    """Edges with a score of their use in a diagram."""
    r = F.col("relation")
    bonus = F.when(r.isin("calls", "uses", "method"), 1.0).when(r.isin("imports", "imports_from"), 0.6).when(r == "contains", -0.2).when(r == "rationale_for", -0.6).otherwise(0.0)
    return edges.withColumn("score", F.coalesce("confidence_score", F.lit(1.0)) + F.when(F.col("confidence") == "EXTRACTED", 2.0).otherwise(0.0) + bonus)


def node_scores(edges: DataFrame) -> DataFrame:
    """(id, score) summed over both ends of scored edges."""
    return edge_scores(edges).select(F.explode(F.array("source", "target")).alias("id"), "score").groupBy("id").agg(F.sum("score").alias("score"))


def community_samples(nodes: DataFrame, gods: DataFrame, top: int = 8) -> DataFrame:
    """(community, labels): up to ``top`` distinct labels, the most connected nodes' first, then by id."""
    clean = F.substring(F.regexp_replace(F.trim("label"), r"^[()]+|[()]+$", ""), 1, 60)
    own = nodes.join(F.broadcast(gods.select("id").withColumn("_god", F.lit(0))), "id", "left").select("community", "id", clean.alias("name"), F.coalesce("_god", F.lit(1)).alias("g")).filter("name <> ''")
    first = own.groupBy("community", F.lower("name").alias("key")).agg(F.min(F.struct("g", "id", "name")).alias("m"))
    ranked = first.withColumn("k", F.row_number().over(Window.partitionBy("community").orderBy("m.g", "m.id"))).filter(F.col("k") <= top)
    return ranked.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m.name"))), lambda x: x["name"]), ", ").alias("labels"))


def explain(edges: DataFrame, degrees: DataFrame, node: str, top: int = 20) -> DataFrame:
    """(part, direction, id, file, n): the connections to the most connected neighbours, and counts by direction and file of the rest."""
    out = edges.filter(F.col("source") == node).select(F.lit("out").alias("direction"), F.col("target").alias("id"), "source_file", "seq")
    both = out.unionByName(edges.filter((F.col("target") == node) & (F.col("source") != node)).select(F.lit("in").alias("direction"), F.col("source").alias("id"), "source_file", "seq"))
    file = F.when(F.col("source_file") == "", "(unknown file)").otherwise(F.col("source_file"))
    first = both.join(degrees, "id").orderBy(F.desc("degree"), "id", "seq").limit(top)
    shown = first.select(F.lit("shown").alias("part"), "direction", "id", F.col("source_file").alias("file"), F.lit(1).cast("long").alias("n"))
    # The rest is what all connections count for less what is shown, so they need no ranking.
    counts = both.select("direction", file.alias("file"), F.lit(1).alias("n")).unionByName(first.select("direction", file.alias("file"), F.lit(-1).alias("n")))
    rest = counts.groupBy("direction", "file").agg(F.sum("n").alias("n")).filter("n > 0")
    return shown.unionByName(rest.select(F.lit("rest").alias("part"), "direction", F.lit(None).cast("string").alias("id"), "file", "n"))


def pull_request_impact(changed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pr, n_nodes, communities) of changed files (pr, file): files match if one path ends with the other. Joined on the file name first."""
    name = lambda c: F.regexp_extract(c, r"([^/]*)$", 1)
    files = nodes.filter("source_file <> ''").groupBy("source_file").agg(F.count("*").alias("n"), F.collect_set("community").alias("cs")).withColumn("name", name("source_file"))
    joined = changed.withColumn("name", name("file")).join(files, "name")
    same = (F.col("file") == F.col("source_file")) | F.col("source_file").endswith(F.concat(F.lit("/"), "file")) | F.col("file").endswith(F.concat(F.lit("/"), "source_file"))
    matched = joined.filter(same).select("pr", "source_file", "n", "cs").distinct()
    return matched.groupBy("pr").agg(F.sum("n").alias("n_nodes"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("cs")))), ",").alias("communities"))


def pull_request_conflicts(impact: DataFrame) -> DataFrame:
    """(community, prs) that several pull requests touch."""
    each = impact.select("pr", F.explode(F.split("communities", ",")).alias("community"))
    return each.groupBy("community").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("pr")), ",").alias("prs")).filter("n > 1").select("community", "prs")


def question_tokens(nodes: DataFrame, pairs: DataFrame, visited: DataFrame) -> DataFrame:
    """One row: characters of the visited nodes' lines over four."""
    line = F.format_string("NODE %s src=%s loc=%s", "label", F.coalesce("source_file", F.lit("")), F.coalesce("source_location", F.lit("")))
    return nodes.join(visited, "id", "left_semi").agg(F.floor(F.sum(F.length(line) + 1) / 4).alias("tokens"), F.count("*").alias("n_nodes"))


def meta_graph(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n): the graph of communities, for views that cannot show every node."""
    c = nodes.select("id", "community")
    both = symmetric(pairs).join(c.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    return both.filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
