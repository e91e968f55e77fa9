"""Readers, writers, entity merging, clusters and reports on small inputs."""

import json
import random
from collections import Counter

from pyspark.sql import functions as F

from loomgraph.operators import analyze, cluster, entities, export, report, resolve, slicing
from loomgraph.sources import files

NODE = "id string, label string, file_type string, source_file string, source_location string, rationale string, community int"


def test_scan(spark, tmp_path):
    for name, body in {"a/x.py": "one two", "a/node_modules/y.js": "no", ".env": "SECRET=1", "b.md": "# t\nw", "p.pdf": "x"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    got = {r.path: (r.category, r.words) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a/x.py": ("code", 2), "b.md": ("doc", 3), "p.pdf": ("paper", 1)}


def test_ignore_rules(spark):
    paths = ["a.log", "keep.log", "src/a.log", "build/x.py", "src/build/y.py", "docs/a/b/c.md", "docs/c.md", "x.py"]
    got = {r.path: r.ignored for r in files.ignored(spark.createDataFrame([(p,) for p in paths], "path string"), ["*.log", "!keep.log", "/build/", "docs/**/c.md"]).collect()}
    assert {p for p, i in got.items() if i} == {"a.log", "src/a.log", "build/x.py", "docs/a/b/c.md", "docs/c.md"}


def test_graph_json_round_trip(spark, tmp_path):
    doc = {"nodes": [{"id": "a", "label": "A"}, {"id": "b", "label": "B"}], "links": [{"source": "a", "target": "b", "relation": "calls"}]}
    (tmp_path / "g.json").write_text(json.dumps(doc, indent=1))
    nodes, edges = files.graph_json(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and edges.first().relation == "calls"
    rows = export.node_link_rows(nodes, edges).orderBy(F.desc("kind"), "key").collect()
    assert [json.loads(r.json) for r in rows if r.kind == "nodes"] == doc["nodes"]


def test_symbols(spark):
    kind = "path string, symbols array<struct<symbol: string, kind: string, relationships: array<struct<symbol: string, is_implementation: boolean>>>>"
    rows = [("a.ts", [("pkg/I#", "class", []), ("pkg/C#", "class", [("pkg/I#", True), ("pkg/D#", False)])]), ("b.ts", [("pkg/D#", "class", [])]), ("c.ts", [("pkg/D#", "class", [])])]
    nodes, edges = files.symbols(spark.createDataFrame(rows, kind))
    assert {r.label for r in nodes.collect()} == {"I", "C", "D"}
    assert [tuple(r) for r in edges.select("source", "target", "relation").collect()] == [("pkg/C#", "pkg/I#", "implements")]


def test_manifests(spark):
    rows = [("pyproject.toml", '[project]\nname = "app"\ndependencies = ["numpy>=1", \'pandas\']\n'), ("x/Cargo.toml", '[package]\nname = "c"\n[dependencies]\nserde = "1"\nrand = { version = "1" }\n'), ("go.mod", "module example.com/m\nrequire github.com/a/b v1.2.0\n")]
    got = {tuple(r) for r in files.manifest_packages(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {("app", "numpy"), ("app", "pandas"), ("c", "serde"), ("c", "rand"), ("example.com/m", "github.com/a/b")}


def test_tool_servers(spark):
    text = json.dumps({"mcpServers": {"fs": {"command": "npx", "args": ["-y", "server-fs"], "env": {"ROOT": "/x"}}, "t": {"command": "run"}}})
    got = {r.server: (r.command, r.package, r.variable) for r in files.tool_servers(spark.createDataFrame([(text,)], "text string")).collect()}
    assert got == {"fs": ("npx", "server-fs", "ROOT"), "t": ("run", None, None)}


def test_notes(spark):
    text = '---\nquestion: "why?"\ndate: 2024-01-01\noutcome: useful\nsource_nodes: ["a", "b c"]\n---\nbody'
    r = files.notes(spark.createDataFrame([("n.md", text)], "path string, text string")).first()
    assert (r.question, r.date, r.outcome, r.source_nodes, r.correction) == ("why?", "2024-01-01", "useful", ["a", "b c"], None)


def test_sql_lineage(spark):
    text = "-- from nothing\nCREATE TABLE orders (id int, c int REFERENCES customers(id));\nCREATE OR REPLACE VIEW v AS SELECT 'from x' FROM orders o JOIN \"customers\" c ON 1=1; SELECT * FROM z;"
    got = {tuple(r)[1:] for r in files.sql_lineage(spark.createDataFrame([("a.sql", text)], "path string, text string")).collect()}
    assert got == {("orders", "table", "references", "customers"), ("v", "view", "reads_from", "orders"), ("v", "view", "reads_from", "customers")}


def test_markdown(spark):
    text = "# Title\n```\n# no\n```\n[a](b.md) and [[Page|x]] and `f()`\n## Two  "
    got = {(r.kind, r.value) for r in files.markdown(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got == {("heading", "Title"), ("heading", "Two"), ("link", "b.md"), ("wiki", "Page"), ("code", "f()")}


def test_writers_escape(spark, tmp_path):
    nodes = spark.createDataFrame([("a'b", 'x<"&', "code", "f", None, None, 0)], NODE)
    edges = spark.createDataFrame([("a'b", "c", "calls")], "source string, target string, relation string")
    assert any("a\\'b" in r.line for r in export.cypher(nodes, edges).collect())
    assert any("x&lt;&quot;&amp;" in r.line for r in export.graphml(nodes, edges).collect())
    export.write_lines(export.cypher(nodes, edges), str(tmp_path / "c"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert lines[0].startswith("MERGE (n") and lines[1].startswith("MATCH")
    assert export.note_pages(nodes, edges).first().text.startswith("# x")


def test_guard_against_shrinking(spark, tmp_path):
    import pytest

    df = spark.range(3)
    export.guarded_overwrite(df, 3, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        export.guarded_overwrite(df, 4, str(tmp_path / "t"))


def nodes(spark, rows):
    return spark.createDataFrame([(i, label, kind, f, None, None, 0) for i, label, kind, f in rows], NODE)


def test_survivors(spark):
    df = spark.createDataFrame([("src_app_run", "run() extended", "code", "src/app.py", "L1", None, 0), ("src_app_run", "run()", "document", "docs/notes.md", None, "why", 0), ("src_app_run", "run() ext", "code", "src/app.py", None, "kept", 0)], NODE)
    r = entities.survivors(df, ["rationale", "source_location"]).collect()
    assert len(r) == 1 and (r[0].label, r[0].source_location, r[0].rationale) == ("run() ext", "L1", "kept")


def test_entities(spark):
    df = nodes(spark, [("a", "User Manager", "concept", "x.md"), ("b", "user-manager", "concept", "x.md"), ("c", "Authentication Service Layer", "concept", "x.md"), ("d", "Authentication Servise Layer", "concept", "x.md"),
                       ("e", "Chapter 1 of the long story", "concept", "x.md"), ("f", "Chapter 2 of the long story", "concept", "x.md"), ("g", "User Manager", "code", "x.py")])
    exact = {tuple(r) for r in entities.exact_pairs(df).collect()}
    assert exact == {("a", "b")}
    similar = {(r.a, r.b) for r in entities.similar_pairs(df).collect()}
    assert ("c", "d") in similar and ("e", "f") not in similar
    merged = {(r.old, r.new) for r in entities.merged(df, entities.exact_pairs(df).unionByName(entities.similar_pairs(df).select("a", "b"))).collect()}
    assert merged == {("b", "a"), ("d", "c")}


def test_guards():
    assert entities.numbers_differ("adr 11", "adr 13") and not entities.numbers_differ("v 09", "v 9")
    assert entities.swaps_content("river crossing plan", "river clearing plan", entities.FILLERS)
    assert not entities.swaps_content("the harbour lantern", "a harbour lantrn", entities.FILLERS)
    assert entities.similarity("graph", "graphs", False, False, entities.FILLERS) == 0


def test_protected_components(spark):
    found = spark.createDataFrame([("a", "a"), ("b", "a"), ("p", "a"), ("q", "a"), ("z", "z")], "id string, component string")
    got = {r.id: r.component for r in entities.protected_split(found, spark.createDataFrame([("p",), ("q",)], "id string")).collect()}
    assert got == {"a": "p", "b": "p", "p": "p", "q": "q", "z": "z"}


def test_communities(spark):
    rng = random.Random(1)
    pairs = {tuple(sorted((f"{g}{i}", f"{g}{j}"))) for g in "abc" for i in range(8) for j in range(8) if i != j and rng.random() < 0.7} | {("a0", "b0"), ("b1", "c1")}
    ids = spark.createDataFrame([(f"{g}{i}",) for g in "abc" for i in range(8)] + [("lone",)], "id string")
    df = spark.createDataFrame(sorted(pairs), "lo string, hi string")
    found = cluster.communities(ids, df)
    rows = found.collect()
    assert len(rows) == 25 and cluster.modularity(found, df) > 0.5
    sizes = Counter(r.cid for r in rows)
    assert [sizes[c] for c in sorted(sizes)] == sorted(sizes.values(), reverse=True)


def _moved(spark, ids, pairs, rounds=12):
    """The rule of cluster.communities, node by node: the members of each community by size and least member."""
    hashed = spark.createDataFrame([(x,) for x in ids], "id string").select("id", F.xxhash64("id").alias("h"), *[(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0).alias(f"r{r}") for r in range(rounds)])
    rows = {r.id: r for r in hashed.collect()}
    near = {x: set() for x in ids}
    for a, b in pairs:
        if a != b and a in near and b in near:
            near[a].add(b)
            near[b].add(a)
    total, at = sum(map(len, near.values())), {x: x for x in ids}
    for r in range(rounds):
        volume = Counter()
        for x in ids:
            volume[at[x]] += len(near[x])
        following = dict(at)
        for x in (x for x in ids if near[x] and rows[x][f"r{r}"]):
            links = Counter(at[y] for y in near[x]) + Counter()
            gains = {c: round(links[c] - len(near[x]) * (volume[c] - (len(near[x]) if c == at[x] else 0)) / total, 9) for c in [*links, at[x]]}
            following[x] = max(gains, key=lambda c: (gains[c], c == at[x], rows[c].h))
        at = following
    groups = {}
    for x in ids:
        groups.setdefault(at[x], []).append(x)
    return [sorted(g) for g in sorted(groups.values(), key=lambda g: (-len(g), min(g)))]


def test_communities_by_the_rule(spark):
    rng = random.Random(7)
    ids = [f"n{i}" for i in range(60)]
    pairs = [(f"n{i}", f"n{j}") for i in range(56) for j in range(56) if i < j and rng.random() < (0.5 if i % 4 == j % 4 else 0.03)] + [("n0", f"n{i}") for i in range(1, 56)]
    given = pairs + [(b, a) for a, b in pairs[::3]] + pairs[::5] + [("n1", "n1"), ("n2", "elsewhere"), ("n3", None)]
    found = cluster.communities(spark.createDataFrame([(x,) for x in ids], "id string"), spark.createDataFrame(given, "lo string, hi string")).collect()
    got = {}
    for r in found:
        got.setdefault(r.cid, []).append(r.id)
    assert [sorted(got[c]) for c in sorted(got)] == _moved(spark, ids, pairs) and sorted(got) == list(range(len(got)))
    alone = cluster.communities(spark.createDataFrame([("b",), ("a",)], "id string"), spark.createDataFrame([], "lo string, hi string"))
    assert {(r.id, r.cid) for r in alone.collect()} == {("a", 0), ("b", 1)}


def test_communities_deal_out_an_edge_once_a_round(spark):
    rng = random.Random(3)
    ids = spark.createDataFrame([(f"n{i}",) for i in range(300)], "id string")
    pairs = spark.createDataFrame(sorted({tuple(sorted((f"n{i}", f"n{rng.randrange(300)}"))) for i in range(300) for _ in range(60)}), "lo string, hi string").filter("lo <> hi")
    store, lists = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm.java.util.ArrayList()
    dealt = lambda: sum(s.shuffleWriteRecords() for s in _seq(store.stageList(lists, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), lists)))
    before, threshold = dealt(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with many nodes
    try:
        cluster.communities(ids, pairs, rounds=8).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    n = pairs.count()
    assert dealt() - before < 8 * 2 * n


def _seq(s):
    return [s.apply(i) for i in range(s.size())]


def test_betweenness_of_a_path(spark):
    ids = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    got = {r.id: r.score for r in cluster.betweenness(ids, spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "lo string, hi string")).collect()}
    assert {k: round(v, 4) for k, v in got.items()} == {"a": 0, "b": 0.6667, "c": 0.6667, "d": 0}


def test_slices_cover():
    rng = random.Random(2)
    for _ in range(200):
        t = "".join(rng.choice(["\n", "# ", "word ", "\n\n", "\n#"]) for _ in range(rng.randint(0, 80)))
        cuts = slicing.slices(t, 30)
        assert "".join(t[a:b] for a, b in cuts) == t and all(b - a <= 30 for a, b in cuts)


def test_call_resolution(spark):
    defs = spark.createDataFrame([("n1", "run()", "src/a/x.py"), ("n2", "run()", "src/b/y.py"), ("n3", "run()", "tests/test_x.py"), ("n4", ".only()", "lib/z.py")], "id string, label string, source_file string")
    raw = spark.createDataFrame([("c1", "run", "src/a/main.py"), ("c2", "run", "other/main.py"), ("c3", "only", "other/main.py"), ("c4", "run", "tests/test_x.py"), ("n4", "only", "lib/z.py")], "source string, callee string, source_file string")
    got = {(r.source, r.target) for r in resolve.calls(raw, defs, spark.createDataFrame([("c3", "n9")], "source string, target string")).collect()}
    assert got == {("c1", "n1"), ("c3", "n4"), ("c4", "n3")}


def test_report_views(spark):
    df = nodes(spark, [("a", "A()", "code", "src/x.py"), ("b", "B", "code", "src/y/z.py")])
    tree = {r.dir: r.total for r in report.directory_totals(df.select(F.col("source_file").alias("path"))).collect()}
    assert tree == {"": 2, "src": 2, "src/y": 1}
    gods = analyze.god_nodes(df, spark.createDataFrame([("a", "b")], "lo string, hi string"))
    assert report.community_samples(df, gods).first().labels in ("A, B", "B, A")
