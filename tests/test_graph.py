"""The graph engine: every query with SQL against DuckDB, and rules on small graphs."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import analyze, build, feedback, incremental, quads, retrieve, traverse
from loomgraph.plans.components import components
from loomgraph.plans.queries import ORACLE_SQL, QUERIES
from loomgraph.streaming import changes

EDGE = "source string, target string, relation string, confidence string, confidence_score double, weight double, context string, source_file string, source_location string, seq long"
NODE = "id string, label string, file_type string, source_file string, source_location string, rationale string, community int"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    assert compare(spark, name, QUERIES[name], ORACLE_SQL[name], "sf0.001") is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() >= 0


def edges(spark, rows):
    return spark.createDataFrame([(s, t, r, c, score, 1.0, None, "f.py", loc, k) for k, (s, t, r, c, score, loc) in enumerate(rows)], EDGE)


def nodes(spark, ids):
    return spark.createDataFrame([(i, i, "code", f"src/{i}.py", None, None, 0) for i in ids], NODE)


def test_collapse_rules(spark):
    out = build.collapse(edges(spark, [
        ("a", "b", "calls", "EXTRACTED", None, "L1"), ("a", "b", "references", "EXTRACTED", None, "L2"),  # generic does not replace specific
        ("c", "d", "calls", "INFERRED", 0.5, "L1"), ("c", "d", "calls", "EXTRACTED", 0.1, None),  # higher confidence wins, location stays
        ("e", "f", "calls", "EXTRACTED", None, "L1"), ("f", "e", "calls", "EXTRACTED", None, "L9"),  # reversed of one relation is passed over
        ("g", "h", "calls", "INFERRED", 0.9, "L1"), ("g", "h", "calls", "INFERRED", 0.2, "L2"),  # higher score stays
        ("i", "i", "calls", "EXTRACTED", None, "L1"),
    ])).collect()
    got = {(r.lo, r.hi): r for r in out}
    assert len(got) == 5
    assert got["a", "b"].relation == "calls"
    assert (got["c", "d"].confidence, got["c", "d"].source_location) == ("EXTRACTED", "L1")
    assert (got["e", "f"].source, got["e", "f"].source_location) == ("e", "L1")
    assert got["g", "h"].confidence_score == 0.9


def test_collapse_does_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), rng.choice("abc"), rng.choice(["calls", "uses", "references"]), rng.choice(["EXTRACTED", "INFERRED"]), rng.random(), rng.choice([None, "L1"])) for _ in range(60)]
    df = edges(spark, rows)
    first = sorted(map(tuple, build.collapse(df).collect()), key=str)
    for n in (1, 7):
        assert sorted(map(tuple, build.collapse(df.repartition(n, "seq")).collect()), key=str) == first


def test_degree_counts_loops_twice(spark):
    e = edges(spark, [("a", "a", "calls", "EXTRACTED", None, None), ("a", "b", "calls", "EXTRACTED", None, None), ("b", "a", "uses", "EXTRACTED", None, None)])
    assert {r.id: r.degree for r in analyze.degrees(nodes(spark, "abc"), analyze.pairs_of(e)).collect()} == {"a": 3, "b": 1, "c": 0}


def test_cohesion_of_a_clique(spark):
    e = edges(spark, [(x, y, "calls", "EXTRACTED", None, None) for x in "abcd" for y in "abcd" if x <= y])
    assert analyze.cohesion(nodes(spark, "abcd"), analyze.pairs_of(e)).first().cohesion == 1.0


def test_resolution_needs_one_candidate(spark):
    n = spark.createDataFrame([("my_id", "", "", ""), ("twice_x", "", "", ""), ("twice-x", "", "", "")], "id string, label string, file_type string, source_file string")
    e = spark.createDataFrame([("My ID", "TWICE X", 1)], "source string, target string, seq long")
    assert tuple(build.resolve_endpoints(e, n).select("source", "target").first()) == ("my_id", "TWICE X")


def test_cycles(spark):
    arcs = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d"), ("c", "e")], "src string, dst string")
    assert sorted(tuple(r.path) for r in traverse.cycles(arcs).collect()) == [("a", "b"), ("a", "b", "c"), ("d",)]


def test_affected(spark):
    e = edges(spark, [("caller", "svc", "calls", "EXTRACTED", None, None), ("far", "caller", "imports", "EXTRACTED", None, None), ("farther", "far", "calls", "EXTRACTED", None, None), ("svc", "m", "method", "EXTRACTED", None, None), ("user", "m", "uses", "EXTRACTED", None, None), ("x", "svc", "contains", "EXTRACTED", None, None)])
    assert {(r.id, r.depth) for r in traverse.affected(e, "svc").collect()} == {("caller", 1), ("user", 1), ("far", 2)}


def test_shortest_path(spark):
    arcs = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "e")], "src string, dst string")
    assert [r.id for r in traverse.shortest_path(arcs, "a", "e").orderBy("hop").collect()] == ["a", "b", "d", "e"]
    assert traverse.shortest_path(arcs, "e", "a").count() == 0


def test_hubs_are_reached_but_not_expanded(spark):
    adj = spark.createDataFrame([("s", "h"), ("h", "x"), ("s", "n"), ("n", "y")], "src string, dst string")
    got = traverse.reach(adj, spark.createDataFrame([("s",)], "id string"), 2, spark.createDataFrame([("h",)], "id string")).collect()
    assert {r.id: r.distance for r in got} == {"s": 0, "h": 1, "n": 1, "y": 2}


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in rows:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    loops = {a for a, b in rows if a == b} - {x for a, b in rows if a != b for x in (a, b)}
    assert got == {x: root(x) for r in rows for x in r if x not in loops}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=30))
def test_normal_ids(s):
    n = text.normalize_id(s)
    assert text.normalize_id(n) == n and text.normalize_id(s.casefold()) == n and not n.startswith("_")


def test_string_metrics():
    assert round(text.jaro("lantern", "rantern"), 4) == 0.9048
    assert round(text.jaro_winkler("lantern", "lantrn"), 4) == 0.9714
    assert text.damerau("ca", "abc") == 2 and text.damerau("ab", "ba") == 1
    assert text.jaro("", "a") == 0 and text.jaro("", "") == 1


def test_non_ascii_goes_through_the_udf(spark):
    df = spark.createDataFrame([("Größe-Maß",), ("Plain Text",), (None,)], "s string")
    assert {r.s: r.o for r in text.with_id(df, "s", "o").collect()} == {"Größe-Maß": "grösse_mass", "Plain Text": "plain_text", None: None}
    assert {r.o for r in text.with_fold(df, "s", "o").collect()} == {"Große-Maß", "Plain Text", ""}


def test_query_terms():
    assert retrieve.query_terms("How does the Graph engine work?") == ["graph", "engine"]
    assert retrieve.query_terms("how does it work") == ["how", "does", "work"]
    assert "图谱" in retrieve.query_terms("知识图谱")


def test_budget_keeps_the_first_line(spark):
    lines = spark.createDataFrame([(1, "x" * 50), (2, "y")], "place int, line string")
    assert [r.place for r in retrieve.within_budget(lines, 5).collect()] == [1]


def test_lessons(spark):
    rows = [("n1", "useful", "2024-01-31"), ("n1", "useful", "2024-01-30"), ("n2", "useful", "2024-01-01"), ("n3", "useful", "2024-01-01"), ("n3", "dead_end", "2024-01-31"), ("n4", "dead_end", "2024-01-31"), ("n5", None, "2024-01-31")]
    memory = spark.createDataFrame(rows, "node string, outcome string, d string").withColumn("ts", F.to_timestamp("d"))
    got = {r.node: (r.kind, r.verdict) for r in feedback.lessons(memory, "2024-02-01 00:00:00").collect()}
    assert got == {"n1": ("preferred", None), "n2": ("tentative", None), "n3": ("contested", "dead end")}


def test_precedence(spark):
    q = spark.createDataFrame([("raw:a", "s", "p", "1"), ("wiki:b", "s", "p", "2"), ("raw:c", "t", "p", "1"), ("raw:a", "t", "p", "2")], "g string, s string, p string, o string")
    g = spark.createDataFrame([("raw:a", "a", "raw", "2024", "1", None), ("wiki:b", "b", "wiki", "2023", "1", "a"), ("raw:c", "c", "raw", "2024", "2", None)], "g string, source string, layer string, date string, version_key string, override_of string")
    assert {(r.s, r.g) for r in quads.winners(q, g).collect()} == {("s", "wiki:b"), ("t", "raw:c")}


def test_replacement_is_idempotent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "source_file string, v int")
    new = spark.createDataFrame([("b", 3)], "source_file string, v int")
    once = incremental.replace_sources(old, new, ["source_file"])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, incremental.replace_sources(once, new, ["source_file"]).collect())) == [("a", 1), ("b", 3)]


def test_stream_of_changes(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:00:00", "a"), (1, "2024-01-01 00:00:02", "b"), (1, "2024-01-01 00:01:00", "c")], "user_id long, t string, event_type string").select("user_id", F.to_timestamp("t").alias("ts"), "event_type").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    got = []
    changes.maintain(stream, lambda df, _: got.extend(changes.sessions(df, "3 seconds").collect()), str(tmp_path / "cp")).awaitTermination(60)
    assert sorted(r.n for r in got) == [1, 2]
