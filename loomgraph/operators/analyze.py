"""Measures of a simple graph: degrees, hubs, surprises, cohesion, gaps, differences, integrity.

``pairs`` are the distinct unordered pairs (lo, hi) of a collapsed graph; a loop counts twice in a degree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text


def pairs_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).distinct()


def degrees(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, degree) of every node, isolated ones included."""
    ends = pairs.select(F.explode(F.array("lo", "hi")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(ends, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))


def is_file_node(label: Column, source_file: Column, degree: Column) -> Column:
    base = F.regexp_extract(source_file, r"([^/]*)$", 1)
    file_label = (source_file != "") & ((label == base) | (label.contains("/") & F.concat(F.lit("/"), source_file).endswith(F.concat(F.lit("/"), label))))
    stub = (label.startswith(".") & label.endswith("()")) | (label.endswith("()") & (degree <= 1))
    return F.coalesce((label != "") & (file_label | stub), F.lit(False))


def is_concept_node(source_file: Column) -> Column:
    s = F.coalesce(source_file, F.lit(""))
    return (s == "") | ~F.regexp_extract(s, r"([^/]*)$", 1).contains(".")


def is_json_key(label: Column, source_file: Column) -> Column:
    return F.lower(F.coalesce(source_file, F.lit(""))).endswith(".json") & F.lower(F.trim(label)).isin(text.JSON_LABELS)


def described(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Nodes with degree and the predicates that keep them out of rankings."""
    d = nodes.join(degrees(nodes, pairs), "id")
    return d.withColumns({
        "is_file": is_file_node(F.col("label"), F.col("source_file"), F.col("degree")),
        "is_concept": is_concept_node(F.col("source_file")),
        "is_noise": is_json_key(F.col("label"), F.col("source_file")) | F.col("label").isin(text.BUILTIN_LABELS),
    })


def percentile_degree(deg: DataFrame, percent: float) -> DataFrame:
    """One row (threshold): the degree at place max(0, int(n * percent / 100) - 1) in ascending order.

    Counted over the histogram of degrees, which has far fewer rows than there are nodes.
    """
    counts = deg.groupBy("degree").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    place = F.greatest(F.lit(0), F.floor(F.col("all") * F.lit(percent) / 100) - 1)
    return upto.filter(F.col("upto") > place).agg(F.min("degree").alias("threshold"))


def expansion_threshold(deg: DataFrame) -> DataFrame:
    """One row (threshold): max(50, the degree at place int(0.99 * n)); nodes from it on are not expanded in a traversal."""
    counts = deg.groupBy("degree").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.orderBy("degree"))).withColumn("all", F.sum("n").over(Window.partitionBy()))
    return upto.filter(F.col("upto") > F.floor(F.col("all") * 0.99)).agg(F.greatest(F.lit(50).cast("long"), F.min("degree")).alias("threshold"))


def god_nodes(nodes: DataFrame, pairs: DataFrame, top: int = 10, exclude_percent: float | None = None) -> DataFrame:
    """The most connected entities: id, label, degree."""
    d = described(nodes, pairs)
    if exclude_percent is not None:
        d = d.join(F.broadcast(percentile_degree(degrees(nodes, pairs), exclude_percent)), F.col("degree") <= F.col("threshold"))
    real = d.filter(~F.col("is_file") & ~F.col("is_concept") & ~F.col("is_noise"))
    return real.select("id", "label", "degree").orderBy(F.desc("degree"), "id").limit(top)


def surprises(nodes: DataFrame, collapsed: DataFrame, top: int = 20) -> DataFrame:
    """Edges between files ranked by how little they are to be expected: lo, hi, relation, confidence, score."""
    pairs = collapsed.select("lo", "hi")
    d = described(nodes, pairs).select("id", "source_file", "community", "degree", "is_file", "is_concept")
    u = d.select(*[F.col(c).alias(f"u_{c}") for c in d.columns])
    v = d.select(*[F.col(c).alias(f"v_{c}") for c in d.columns])
    own = collapsed.filter(~F.col("relation").isin("imports", "imports_from", "contains", "method"))
    e = own.join(u, F.col("lo") == F.col("u_id")).join(v, F.col("hi") == F.col("v_id"))
    e = e.filter("not u_is_concept and not v_is_concept and not u_is_file and not v_is_file and u_source_file <> '' and v_source_file <> '' and u_source_file <> v_source_file")
    cu, cv = text.category(F.col("u_source_file")), text.category(F.col("v_source_file"))
    code_doc = ((cu == "code") & (cv == "doc")) | ((cu == "doc") & (cv == "code"))
    quiet = (F.col("confidence") == "INFERRED") & F.col("relation").isin("calls", "uses") & (text.cross_language(F.col("u_source_file"), F.col("v_source_file")) | code_doc)
    base = F.when(quiet, 0).otherwise(F.when(F.col("confidence") == "AMBIGUOUS", 3).when(F.col("confidence") == "INFERRED", 2).otherwise(1))
    bonus = lambda cond, n: F.when(cond & ~quiet, n).otherwise(0)
    score = base + bonus(cu != cv, 2) + bonus(text.top_dir(F.col("u_source_file")) != text.top_dir(F.col("v_source_file")), 2) + bonus(F.coalesce(F.col("u_community") != F.col("v_community"), F.lit(False)), 1)
    score = F.when(F.col("relation") == "semantically_similar_to", F.floor(score * 1.5)).otherwise(score)
    far = (F.least("u_degree", "v_degree") <= 2) & (F.greatest("u_degree", "v_degree") >= 5)
    return e.withColumn("score", (score + far.cast("int")).cast("long")).select("lo", "hi", "relation", "confidence", "score").orderBy(F.desc("score"), "lo", "hi").limit(top)


def with_communities(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs with the communities of both ends (cu, cv)."""
    c = nodes.select("id", "community")
    return pairs.join(c.select(F.col("id").alias("lo"), F.col("community").alias("cu")), "lo").join(c.select(F.col("id").alias("hi"), F.col("community").alias("cv")), "hi")


def cohesion(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(community, n_nodes, cohesion): edges inside over those possible."""
    inside = with_communities(nodes, pairs).filter("cu = cv and lo <> hi").groupBy(F.col("cu").alias("community")).agg(F.count("*").alias("m"))
    sizes = nodes.groupBy("community").agg(F.count("*").alias("n_nodes"))
    n = F.col("n_nodes")
    return sizes.join(inside, "community", "left").select("community", "n_nodes", F.when(n <= 1, 1.0).otherwise(F.coalesce("m", F.lit(0)) / (n * (n - 1) / 2)).alias("cohesion"))


def signatures(nodes: DataFrame) -> DataFrame:
    """(community, signature) of the sorted members: a hash that streams over them, so no community is collected."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, h, out = None, False, hashlib.sha256(), []
        for b in batches:
            for c, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not known or c != at:
                    if known:
                        out.append((at, h.hexdigest()[:16]))
                    at, known, h = c, True, hashlib.sha256()
                h.update(i.encode() + b"\0")
        if known:
            out.append((at, h.hexdigest()[:16]))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.string())], ["community", "signature"])

    own = nodes.filter("id is not null").select(F.col("community").cast("int"), "id").repartition("community").sortWithinPartitions("community", "id")
    return own.mapInArrow(of, "community int, signature string")


def hub_labels(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(community, label) of the member with the highest degree, the least id among equals, less one trailing ()."""
    d = nodes.join(degrees(nodes, pairs), "id")
    return d.groupBy("community").agg(F.regexp_replace(F.min_by("label", F.struct(-F.col("degree"), F.col("id"))), r"\(\)$", "").alias("label"))


def community_edges(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, n) edges between two communities, a < b."""
    return with_communities(nodes, pairs).filter("cu <> cv").groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count("*").alias("n"))


def confidence_by_community(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    c = nodes.select(F.col("id").alias("source"), "community")
    count = lambda v: F.sum((F.col("confidence") == v).cast("long")).alias(f"n_{v.lower()}")
    return edges.join(c, "source").groupBy("community").agg(count("EXTRACTED"), count("INFERRED"), count("AMBIGUOUS"))


def graph_stats(nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """One row of sizes and confidence percentages, rounded half to even."""
    n = nodes.agg(F.count("*").alias("n_nodes"), F.countDistinct("community").alias("n_communities"))
    share = lambda v: F.bround(F.sum((F.col("confidence") == v).cast("double")) * 100 / F.count("*"), 0).cast("long").alias(f"pct_{v.lower()}")
    return n.join(collapsed.agg(F.count("*").alias("n_edges"), share("EXTRACTED"), share("INFERRED"), share("AMBIGUOUS")))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counters: loops, dangling ends, duplicates, variants within one pair of ends."""
    ids = nodes.select("id").distinct()
    flagged = edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("_s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("_t")), "target", "left")
    sound = F.col("_s").isNotNull() & F.col("_t").isNotNull()
    per_relation = flagged.filter(sound).groupBy("source", "target", "relation").agg(
        F.count("*").alias("n"), F.countDistinct(F.coalesce("source_file", F.lit(""))).alias("files"), F.countDistinct(F.coalesce("source_location", F.lit(""))).alias("places"), F.countDistinct(F.coalesce("context", F.lit(""))).alias("contexts")
    )
    per_pair = per_relation.groupBy("source", "target").agg(
        F.sum("n").alias("n"), F.count("*").alias("relations"), *[F.sum((F.col(c) > 1).cast("long")).alias(c) for c in ("files", "places", "contexts")]
    )
    both = per_pair.groupBy(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi")).agg(
        F.sum("n").alias("n"), F.count("*").alias("directed"), F.sum((F.col("n") > 1).cast("long")).alias("groups"), F.sum((F.col("relations") > 1).cast("long")).alias("relations"), *[F.sum(c).alias(c) for c in ("files", "places", "contexts")]
    )
    whole = both.agg(
        F.sum("n").alias("valid_edges"), F.sum("directed").alias("directed_pairs"), F.count("*").alias("undirected_pairs"), F.sum("groups").alias("same_endpoint_groups"),
        F.sum("relations").alias("relation_variants"), F.sum("files").alias("file_variants"), F.sum("places").alias("location_variants"), F.sum("contexts").alias("context_variants"),
        F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n")).otherwise(0)).alias("self_loops"),
    )
    return whole.join(flagged.agg(F.count("*").alias("raw_edges"), F.sum((~sound).cast("long")).alias("dangling_edges")))


def duplicated_pairs(nodes: DataFrame, edges: DataFrame, top: int = 5) -> DataFrame:
    """The pairs of ends with most edges, with the values that those have."""
    values = lambda c: F.array_join(F.array_sort(F.collect_set(F.coalesce(c, F.lit("")))), ",")
    grouped = edges.groupBy("source", "target").agg(F.count("*").alias("edge_count"), values("relation").alias("relations"), values("context").alias("contexts"))
    known = nodes.select("id").distinct()
    sound = grouped.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    return sound.filter("edge_count > 1").select("source", "target", "edge_count", "relations", "contexts").orderBy(F.desc("edge_count"), "source", "target").limit(top)


def isolated(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Real nodes with one neighbour at most: (id, degree)."""
    return described(nodes, pairs).filter("degree <= 1 and not is_file and not is_concept and file_type <> 'rationale'").select("id", "degree")


def verify_candidates(nodes: DataFrame, collapsed: DataFrame, top: int = 5) -> DataFrame:
    """Of the nodes with the highest degree those with at least two inferred edges: (id, degree, inferred)."""
    d = described(nodes, collapsed.select("lo", "hi")).filter("not is_file").select("id", "degree").orderBy(F.desc("degree"), "id").limit(top)
    ends = collapsed.filter("confidence = 'INFERRED'").select(F.explode(F.array_distinct(F.array("lo", "hi"))).alias("id"))
    return ends.join(F.broadcast(d), "id").groupBy("id", "degree").agg(F.count("*").alias("inferred")).filter("inferred >= 2")


def bridges_between(nodes: DataFrame, collapsed: DataFrame) -> DataFrame:
    """For each pair of communities one edge, the least certain first: (a, b, lo, hi, confidence)."""
    e = with_communities(nodes, collapsed.select("lo", "hi", "confidence")).filter("cu <> cv")
    e = e.withColumns({"a": F.least("cu", "cv"), "b": F.greatest("cu", "cv")})
    order = F.when(F.col("confidence") == "AMBIGUOUS", 0).when(F.col("confidence") == "INFERRED", 1).otherwise(2)
    return e.groupBy("a", "b").agg(F.min(F.struct(order.alias("o"), "lo", "hi", "confidence")).alias("m")).select("a", "b", "m.lo", "m.hi", "m.confidence")


def interleave(rows: DataFrame, kind: str, order: list[str], kinds: list[str], top: int) -> DataFrame:
    """Rows of all kinds in turn, each kind in its own order, kinds as listed."""
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    w = Window.partitionBy(kind).orderBy(*order)
    first = rows.withColumn("turn", F.row_number().over(w)).filter(F.col("turn") <= top)  # more of a kind cannot be shown
    return first.withColumn("kind_place", place).orderBy("turn", "kind_place").limit(top)


def diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """(change, *key): rows only in new (added) or only in old (removed)."""
    added = new.select(*key).distinct().join(old.select(*key), key, "left_anti").withColumn("change", F.lit("added"))
    removed = old.select(*key).distinct().join(new.select(*key), key, "left_anti").withColumn("change", F.lit("removed"))
    return added.unionByName(removed)


def community_overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_cid, new_cid, overlap) of two assignments (id, cid)."""
    return old.select("id", F.col("cid").alias("old_cid")).join(new.select("id", F.col("cid").alias("new_cid")), "id").groupBy("old_cid", "new_cid").agg(F.count("*").alias("overlap"))


def greedy_remap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(new_cid, final_cid): one-to-one by descending overlap, fresh ids by size for the rest.

    The overlap table has a row for each pair of communities that meet; communities are few against nodes, and the
    matching is sequential by definition, so it runs on the driver.
    """
    spark = new.sparkSession
    taken, final = set(), {}
    for r in community_overlap(old, new).orderBy(F.desc("overlap"), "old_cid", "new_cid").toLocalIterator():
        if r.old_cid not in taken and r.new_cid not in final:
            final[r.new_cid] = r.old_cid
            taken.add(r.old_cid)
    free = 0
    rest = new.groupBy("cid").agg(F.count("*").alias("n"), F.min("id").alias("first")).orderBy(F.desc("n"), "first")
    for r in rest.toLocalIterator():
        if r.cid not in final:
            while free in taken:
                free += 1
            final[r.cid] = free
            taken.add(free)
    return spark.createDataFrame(sorted(final.items()), "new_cid long, final_cid long")
