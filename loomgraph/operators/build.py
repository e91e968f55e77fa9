"""Reconciling fragments to one graph: endpoints, stubs, duplicates, collapse of parallel edges.

Nodes have at least (id, label, file_type, source_file); edges (source, target, relation, confidence, seq).
All joins are equi-joins on ids; what a rule needs in order is decided by windows and ordered aggregates.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text

# Fixed values.
GENERIC_RELATIONS = ["references", "uses", "mentions"]
IMPORT_RELATIONS = ["imports", "imports_from", "re_exports"]
CONFIDENCE_RANK = {"AMBIGUOUS": 1, "INFERRED": 2, "EXTRACTED": 3}
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]


def resolve_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints that are no node id are looked up by normal form; forms that several nodes have resolve to none."""
    ids = nodes.select(F.col("id")).distinct()
    forms = text.with_id(ids, "id", "form").groupBy("form").agg(F.min("id").alias("found"), F.count("*").alias("n")).filter("n = 1").select("form", "found")
    for end in ("source", "target"):
        known = ids.withColumnRenamed("id", end).withColumn("_known", F.lit(True))
        named = text.with_id(edges.join(known, end, "left"), end, "form").join(forms, "form", "left")
        edges = named.withColumn(end, F.when(F.col("_known"), F.col(end)).otherwise(F.coalesce("found", end))).drop("form", "found", "_known")
    return edges


def stubs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """External nodes minted for targets of imports whose source is a node: (id, label, file_type, source_file)."""
    ids = nodes.select("id")
    wanted = edges.filter(F.col("relation").isin(IMPORT_RELATIONS)).join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    missing = wanted.join(ids.withColumnRenamed("id", "target"), "target", "left_anti").select(F.col("target").alias("id")).distinct()
    return missing.select("id", F.col("id").alias("label"), F.lit("concept").alias("file_type"), F.lit("").alias("source_file"))


def prune_dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both endpoints are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")


def last_nodes(nodes: DataFrame, seq: str = "seq") -> DataFrame:
    """Of nodes with one id the last."""
    w = Window.partitionBy("id").orderBy(F.desc(seq))
    return nodes.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def first_edges(edges: DataFrame) -> DataFrame:
    """Of edges with one source, target and relation the first."""
    w = Window.partitionBy("source", "target", "relation").orderBy("seq")
    return edges.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


_CARRIED = ["source", "target", "relation", "confidence", "confidence_score", "weight", "context", "source_file", "source_location"]
_COLLAPSED = "lo string, hi string, source string, target string, relation string, confidence string, confidence_score double, weight double, context string, source_file string, source_location string"


def _passed_over(a: list, x: tuple) -> bool:
    """Whether edge x leaves the edge a that its pair has so far as it is."""
    same = a[2] == x[2]
    if same and a[0] == x[1] and a[1] == x[0]:
        return True  # the same relation, reversed
    if x[2] in GENERIC_RELATIONS and a[2] not in GENERIC_RELATIONS:
        return True
    if not same:
        return False
    ra, rx = CONFIDENCE_RANK.get(a[3], 0), CONFIDENCE_RANK.get(x[3], 0)
    if ra != rx:
        return ra > rx
    return bool(a[8] and not x[8]) or (a[4] is not None and x[4] is not None and a[4] > x[4])


def collapse(edges: DataFrame) -> DataFrame:
    """One edge for each unordered pair of nodes.

    Edges of a pair are folded in the order (source, target, relation, seq): a reversed edge of the same relation is
    passed over; a generic relation never replaces a specific one; of one relation the higher confidence, then
    the one with a location, then the higher score stays; otherwise the later edge wins, and attributes that it lacks
    stay. The rule depends on all earlier edges, so it is a fold: pairs are dealt out and sorted by Spark (which
    spills) and stream through tasks that hold one edge, so no pair is ever collected, however many edges it has.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, edge, out = None, None, []
        for b in batches:
            for lo, hi, *x in zip(*(c.to_pylist() for c in b.columns)):
                if (lo, hi) != at:
                    if at:
                        out.append((*at, *edge))
                    at, edge = (lo, hi), x
                elif not _passed_over(edge, x):
                    edge = [*x[:3], *(e if v is None else v for v, e in zip(x[3:], edge[3:]))]
            if len(out) >= 5000:
                yield _rows(out)
                out = []
        if at:
            out.append((*at, *edge))
        yield _rows(out)

    pair = edges.select(F.least("source", "target").alias("lo"), F.greatest("source", "target").alias("hi"), *_CARRIED, "seq")
    ordered = pair.repartition("lo", "hi").sortWithinPartitions("lo", "hi", "source", "target", "relation", "seq").drop("seq")
    return ordered.mapInArrow(fold, _COLLAPSED)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 6 + [pa.float64()] * 2 + [pa.string()] * 3
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["lo", "hi", *_CARRIED])


def sanitise(edges: DataFrame) -> DataFrame:
    """Finite weights and scores, never negative."""
    return edges.withColumns({c: F.when(F.col(c).isNull(), F.col(c)).otherwise(text.sane_number(F.col(c))) for c in ("weight", "confidence_score")})


def backfill_source(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge without a source file takes its source node's, else its target's, else ''."""
    files = nodes.select("id", F.when(F.col("source_file") != "", F.col("source_file")).alias("f"))
    s, t = files.select(F.col("id").alias("source"), F.col("f").alias("_s")), files.select(F.col("id").alias("target"), F.col("f").alias("_t"))
    own = F.when(F.col("source_file") != "", F.col("source_file"))
    return edges.join(s, "source", "left").join(t, "target", "left").withColumn("source_file", F.coalesce(own, "_s", "_t", F.lit(""))).drop("_s", "_t")


def drop_cross_language(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Without inferred calls between families, and without imports and references between two known ones."""
    files = nodes.select("id", text.family(F.col("source_file")).alias("f"), text.extension(F.col("source_file")).alias("e"))
    joined = edges.join(files.select(F.col("id").alias("source"), F.col("f").alias("_fs"), F.col("e").alias("_es")), "source").join(files.select(F.col("id").alias("target"), F.col("f").alias("_ft"), F.col("e").alias("_et")), "target")
    calls = (F.col("relation") == "calls") & (F.col("confidence") == "INFERRED") & (F.col("_es") != "") & (F.col("_et") != "") & ~F.col("_fs").eqNullSafe(F.col("_ft"))
    others = F.col("relation").isin("imports", "imports_from", "references") & F.coalesce(F.col("_fs") != F.col("_ft"), F.lit(False))
    return joined.filter(~calls & ~others).drop("_fs", "_es", "_ft", "_et")


def drop_import_loops(edges: DataFrame) -> DataFrame:
    return edges.filter(~((F.col("source") == F.col("target")) & F.col("relation").isin(IMPORT_RELATIONS)))


def violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, problem) of all broken rules: required fields, enumerations, endpoints."""
    found = []
    for c in ("id", "label", "file_type", "source_file"):
        found.append(nodes.filter(F.col(c).isNull()).select(F.lit("node").alias("kind"), F.coalesce("id", F.lit("")).alias("key"), F.lit(f"missing {c}").alias("problem")))
    found.append(nodes.filter(~F.col("file_type").isin(FILE_TYPES)).select(F.lit("node"), "id", F.lit("unknown file_type")))
    key = F.concat_ws(">", "source", "target")
    for c in ("source", "target", "relation", "confidence", "source_file"):
        found.append(edges.filter(F.col(c).isNull()).select(F.lit("edge"), key, F.lit(f"missing {c}")))
    found.append(edges.filter(~F.col("confidence").isin([*CONFIDENCE_RANK])).select(F.lit("edge"), key, F.lit("unknown confidence")))
    ids = nodes.select("id")
    for end in ("source", "target"):
        found.append(edges.filter(F.col(end).isNotNull()).join(ids.withColumnRenamed("id", end), end, "left_anti").select(F.lit("edge"), key, F.lit(f"unmatched {end}")))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def shortest_unique_suffix(paths: DataFrame, path: str = "path") -> DataFrame:
    """(path, label): the shortest run of last segments that no other path ends with."""
    own = paths.select(F.col(path).alias("path")).distinct()
    parts = F.split("path", "/")
    ends = own.withColumn("k", F.explode(F.sequence(F.lit(1), F.size(parts)))).withColumn("label", F.array_join(F.slice(parts, -F.col("k"), F.col("k")), "/"))
    unique = ends.groupBy("label").agg(F.count("*").alias("n"), F.min("path").alias("path"), F.min("k").alias("k")).filter("n = 1")
    best = unique.groupBy("path").agg(F.min_by("label", "k").alias("label"))
    return own.join(best, "path", "left").withColumn("label", F.coalesce("label", "path"))


def compact_hyperedges(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(hid, nodes): known members in their order, each once; hyperedges without any go."""
    known = members.join(nodes.select(F.col("id").alias("node")), "node", "left_semi").groupBy("hid", "node").agg(F.min("pos").alias("pos"))
    return known.groupBy("hid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda m: m["node"]).alias("nodes"))


def rewire(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Endpoints moved to survivors (old, new); loops that this makes are dropped, earlier ones stay."""
    s, t = remap.select(F.col("old").alias("source"), F.col("new").alias("_s")), remap.select(F.col("old").alias("target"), F.col("new").alias("_t"))
    moved = edges.join(s, "source", "left").join(t, "target", "left").withColumns({"_was": F.col("source") == F.col("target"), "source": F.coalesce("_s", "source"), "target": F.coalesce("_t", "target")})
    return moved.filter((F.col("source") != F.col("target")) | F.col("_was")).drop("_s", "_t", "_was")
