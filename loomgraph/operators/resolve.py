"""Which node a name means: calls across files, twins, ghosts, canonical groups, evidence.

Every rule binds a name only if exactly one candidate is left; ambiguity never picks a first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text


def is_test(path: Column) -> Column:
    return F.coalesce(path, F.lit("")).rlike(r"(?i)(^|/)tests?/|(^|/)test_[^/]*$|_test\.[^/]*$|\.(test|spec)\.[^/]*$")


def common_directories(a: Column, b: Column) -> Column:
    """How many leading directories two paths share."""
    dirs = lambda p: F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    differ = F.zip_with(dirs(a), dirs(b), lambda x, y: x.eqNullSafe(y))
    return F.when(F.array_position(differ, F.lit(False)) > 0, F.array_position(differ, F.lit(False)) - 1).otherwise(F.size(differ).cast("long"))


def calls(raw: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """(source, target, source_file) of raw calls (source, callee, source_file) by bare label.

    Of several candidates: code that is no test may not call tests; a test prefers its own file, then tests. What is left
    must be one candidate, or one that shares more leading directories with the call than all others. Loops and
    pairs that are known (source, target) are left out.
    """
    label = F.lower(text.bare_label(F.col("label")))
    index = nodes.select(F.col("id").alias("target"), F.regexp_replace(label, r"^\.", "").alias("name"), F.col("source_file").alias("target_file"))
    one = raw.withColumn("call", F.xxhash64("source", "callee", "source_file")).dropDuplicates(["source", "callee", "source_file"])
    found = one.join(index, F.lower("callee") == F.col("name"))
    found = found.withColumns({"from_test": is_test(F.col("source_file")), "to_test": is_test(F.col("target_file")), "same": F.col("source_file") == F.col("target_file")})
    w = Window.partitionBy("call")
    n = F.count("*").over(w)
    tests = F.sum(F.col("to_test").cast("int")).over(w)
    own = F.sum((F.col("to_test") & F.col("same")).cast("int")).over(w)
    allowed = F.when(n == 1, True).when(~F.col("from_test"), ~F.col("to_test")).when(own == 1, F.col("to_test") & F.col("same")).when(tests > 0, F.col("to_test")).otherwise(True)
    left = found.withColumn("ok", allowed).filter("ok").withColumn("near", common_directories(F.col("source_file"), F.col("target_file")))
    best = left.groupBy("call").agg(F.count("*").alias("n"), F.max("near").alias("top"))
    ranked = left.join(best, "call").filter((F.col("n") == 1) | ((F.col("near") == F.col("top")) & (F.col("top") > 0)))
    single = ranked.groupBy("call").agg(F.count("*").alias("m"), F.first("source").alias("source"), F.min("target").alias("target"), F.first("source_file").alias("source_file")).filter("m = 1")
    return single.filter("source <> target").select("source", "target", "source_file").join(known.select("source", "target"), ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min("source_file").alias("source_file"))


def document_twins(nodes: DataFrame) -> DataFrame:
    """(old, new): a document's bare node and the ``_doc`` node of the same file that takes its place."""
    docs = nodes.filter("file_type = 'document' and source_file <> ''").select("id", "source_file")
    long = docs.filter(F.col("id").endswith("_doc")).select(F.regexp_replace("id", "_doc$", "").alias("old"), F.col("id").alias("new"), "source_file")
    return long.join(docs.withColumnRenamed("id", "old"), ["old", "source_file"]).select("old", "new")


def ghosts(nodes: DataFrame, structural: Column) -> DataFrame:
    """(old, new): a node without a place and the one structural node of its file and label; keys with several are left alone."""
    own = nodes.filter("label <> '' and source_file <> ''").withColumn("_s", F.coalesce(structural, F.lit(False)))
    anchors = own.filter("_s").groupBy("source_file", "label").agg(F.count("*").alias("n"), F.min("id").alias("new")).filter("n = 1").drop("n")
    return own.filter("not _s").join(anchors, ["source_file", "label"]).select(F.col("id").alias("old"), "new")


def canonical_groups(nodes: DataFrame) -> DataFrame:
    """(old, new) of nodes with one label: the least by (source file, place, id) stays."""
    best = nodes.groupBy("label").agg(F.min(F.struct(F.coalesce("source_file", F.lit("")).alias("f"), F.coalesce("source_location", F.lit("")).alias("l"), "id")).alias("m"))
    return nodes.join(best.select("label", F.col("m.id").alias("new")), "label").filter("id <> new").select(F.col("id").alias("old"), "new")


def unverified(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """(id) of code nodes none of whose identifiers occurs in the text of their file (source_file, text)."""
    words = F.filter(F.regexp_extract_all(F.lower(F.concat_ws(" ", F.split("label", r"\(")[0], "id")), F.lit("[a-z_][a-z0-9_]*"), F.lit(0)), lambda w: F.length(w) >= 3)
    own = nodes.filter("file_type = 'code' and source_file <> ''").withColumn("words", F.array_distinct(words)).filter(F.size("words") > 0)
    joined = own.join(sources.select("source_file", F.lower("text").alias("body")), "source_file")
    return joined.filter(~F.exists("words", lambda w: F.contains(F.col("body"), w))).select("id")


def cost(usage: DataFrame, prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Usage (model, input_tokens, output_tokens) with its cost at prices a million tokens; unknown models cost nothing."""
    p = F.create_map(*[x for m, (i, o) in prices.items() for x in (F.lit(m), F.struct(F.lit(float(i)).alias("i"), F.lit(float(o)).alias("o")))])
    own = F.try_element_at(p, F.col("model"))
    return usage.withColumn("cost", F.coalesce((F.col("input_tokens") * own["i"] + F.col("output_tokens") * own["o"]) / 1e6, F.lit(0.0)))


def add_repository(whole: DataFrame, nodes: DataFrame, repo: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of all repositories with one replaced or added, and (old, new) for its externals that others have by label."""
    kept = whole.filter(F.col("repo") != repo)
    externals = kept.filter("source_file = '' and label <> ''").groupBy("label").agg(F.min("id").alias("new"))
    remap = nodes.filter("source_file = ''").join(externals, "label").select(F.col("id").alias("old"), "new")
    fresh = nodes.join(remap.select(F.col("old").alias("id")), "id", "left_anti").withColumn("repo", F.lit(repo))
    return kept.unionByName(fresh.select(*kept.columns)), remap
