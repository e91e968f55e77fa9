"""The registered queries of the graph engine with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text
from loomgraph.operators import analyze, build, cluster, entities, feedback, incremental, quads, report, resolve, retrieve, slicing, traverse
from loomgraph.plans.components import components
from loomgraph.sources import files
from loomgraph.sources.tables import table, view, with_views
from loomgraph.streaming import changes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *names: str):
    """Registers a query, and SQL over the named projections."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = with_views(sql, *names) if names else sql
        return f

    return register


def graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, sound edges, pairs."""
    nodes = view(spark, d, "nodes")
    edges = build.prune_dangling(view(spark, d, "edges"), nodes)
    return nodes, edges, analyze.pairs_of(edges)


SOUND = "WITH sound AS (SELECT e.* FROM edges e WHERE source IN (SELECT id FROM nodes) AND target IN (SELECT id FROM nodes))"
PAIRS = SOUND + ", pairs AS (SELECT DISTINCT least(source, target) AS lo, greatest(source, target) AS hi FROM sound)"
DEGREE = PAIRS + """, ends AS (SELECT lo AS id FROM pairs UNION ALL SELECT hi FROM pairs),
    degree AS (SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN ends e ON e.id = n.id GROUP BY n.id)"""
FLAGS = DEGREE + """, flags AS (SELECT n.*, degree, split_part(source_file, '/', -1) AS base,
        label <> '' AND ((source_file <> '' AND (label = split_part(source_file, '/', -1) OR (contains(label, '/') AND ends_with('/' || source_file, '/' || label))))
            OR (starts_with(label, '.') AND ends_with(label, '()')) OR (ends_with(label, '()') AND degree <= 1)) AS is_file,
        source_file = '' OR NOT contains(split_part(source_file, '/', -1), '.') AS is_concept FROM nodes n JOIN degree USING (id))"""
_RANK = "CASE {}.confidence WHEN 'EXTRACTED' THEN 3 WHEN 'INFERRED' THEN 2 WHEN 'AMBIGUOUS' THEN 1 ELSE 0 END"
COLLAPSED = """, packed AS (SELECT least(source, target) AS lo, greatest(source, target) AS hi, list(struct_pack(source := source, target := target, relation := relation, seq := seq, confidence := confidence,
        confidence_score := confidence_score, weight := weight, context := context, source_file := source_file, source_location := source_location) ORDER BY source, target, relation, seq) AS l FROM sound GROUP BY 1, 2),
    folded AS (SELECT lo, hi, list_reduce(l, lambda a, x: CASE WHEN (a.relation = x.relation AND a.source = x.target AND a.target = x.source)
            OR (x.relation IN ('references', 'uses', 'mentions') AND a.relation NOT IN ('references', 'uses', 'mentions'))
            OR (a.relation = x.relation AND (RA > RX OR (RA = RX AND ((coalesce(a.source_location, '') <> '' AND coalesce(x.source_location, '') = '') OR coalesce(a.confidence_score > x.confidence_score, false)))))
        THEN a ELSE struct_pack(source := x.source, target := x.target, relation := x.relation, seq := x.seq, confidence := coalesce(x.confidence, a.confidence), confidence_score := coalesce(x.confidence_score, a.confidence_score),
            weight := coalesce(x.weight, a.weight), context := coalesce(x.context, a.context), source_file := coalesce(x.source_file, a.source_file), source_location := coalesce(x.source_location, a.source_location)) END) AS e FROM packed),
    collapsed AS (SELECT lo, hi, e.source, e.target, e.relation, e.confidence, e.confidence_score, e.weight, e.context, e.source_file, e.source_location FROM folded)""".replace("RA", _RANK.format("a")).replace("RX", _RANK.format("x"))
N, E = "nodes", "edges"

# --- scalar functions -----------------------------------------------------------------------------------------------


@query("SELECT url, trim(regexp_replace(regexp_replace(lower(url), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '_') AS id FROM pages")
def p1_normalize_id(spark, d):
    return text.with_id(table(spark, d, "pages").select("url"), "url", "id").select("url", "id")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM part")
def p2_label_norm(spark, d):
    return text.with_norm(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", "norm").select("p_partkey", "norm")


@query("SELECT doc_id, sha256(strip_accents(text)) AS folded FROM documents")
def p3_fold_diacritics(spark, d):
    docs = text.with_fold(table(spark, d, "documents").select("doc_id", "text"), "text", "folded")
    return docs.select("doc_id", F.sha2(F.col("folded").cast("binary"), 256).alias("folded"))


@query("SELECT id, array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS tokens FROM nodes", N)
def p4_search_tokens(spark, d):
    return view(spark, d, "nodes").select("id", F.array_join(text.tokens(F.col("label")), " ").alias("tokens"))


@query("""SELECT id, coalesce(round((SELECT -sum(c / n * log2(c / n)) FROM (SELECT count(*)::DOUBLE AS c, sum(count(*)) OVER ()::DOUBLE AS n
          FROM (SELECT unnest(string_split(norm, '')) AS ch) WHERE ch <> '' GROUP BY ch)), 6), 0.0) AS bits
          FROM (SELECT id, trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g')) AS norm FROM nodes)""", N)
def p6_entropy(spark, d):
    return text.with_norm(view(spark, d, "nodes"), "label", "norm").select("id", F.round(text.entropy(F.col("norm")), 6).alias("bits"))


@query("""SELECT id, array_to_string(list_sort(list_distinct(CASE WHEN length(label) < 3 THEN [label] ELSE [label[i:i+2] FOR i IN range(1, length(label) - 1)] END)), '|') AS grams FROM nodes""", N)
def p7_shingles(spark, d):
    return view(spark, d, "nodes").select("id", F.array_join(F.array_sort(text.shingles(F.col("label"))), "|").alias("grams"))


@query(FLAGS + " SELECT id, degree, is_file, is_concept FROM flags", N, E)
def p9_node_predicates(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.described(nodes, pairs).select("id", "degree", "is_file", "is_concept")


@query("""SELECT doc_id, CASE regexp_extract(path, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'python' END AS family,
          CASE regexp_extract(path, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'code' WHEN '.json' THEN 'code' WHEN '.pdf' THEN 'paper' WHEN '.png' THEN 'image' ELSE 'doc' END AS category,
          split_part(path, '/', 1) AS top_dir FROM files""", "files")
def p12_path_classes(spark, d):
    p = F.col("path")
    return view(spark, d, "files").select("doc_id", text.family(p).alias("family"), text.category(p).alias("category"), text.top_dir(p).alias("top_dir"))


@query("SELECT doc_id, regexp_matches(path, '(^|/)tests?/') AS is_test FROM files", "files")
def p14_test_paths(spark, d):
    return view(spark, d, "files").select("doc_id", F.col("path").rlike("(^|/)tests?/").alias("is_test"))


_NAMES = "SELECT p_partkey, lower(p_name) AS a, lower(lead(p_name) OVER (ORDER BY p_partkey)) AS b FROM part"


@query(f"""SELECT p_partkey, round(jaro_similarity(a, b), 6) AS jaro, round(jaro_winkler_similarity(a, b), 6) AS jaro_winkler, CAST(damerau_levenshtein(a, b) AS BIGINT) AS damerau,
          CAST(levenshtein(a, b) AS BIGINT) AS edits FROM ({_NAMES}) WHERE b IS NOT NULL""")
def p16_string_metrics(spark, d):
    part = table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("a"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return part.join(after, "p_partkey").select(
        "p_partkey", F.round(text.jaro_udf("a", "b"), 6).alias("jaro"), F.round(text.jaro_winkler_udf("a", "b"), 6).alias("jaro_winkler"), text.damerau_udf("a", "b").alias("damerau"), F.levenshtein("a", "b").cast("long").alias("edits")
    )


@query("""SELECT p_partkey, array_to_string(list_sort([CASE WHEN ltrim(x, '0') = '' THEN '0' ELSE ltrim(x, '0') END FOR x IN regexp_extract_all(p_brand || p_name || p_size, '[0-9]+')]), ',') AS numbers FROM part""")
def p15_numeric_tokens(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.digit_runs(F.concat("p_brand", "p_name", F.col("p_size").cast("string"))), ",").alias("numbers"))


@query("SELECT id, regexp_replace(label, '\\(\\)$', '') AS label FROM nodes", N)
def p19_hub_label(spark, d):
    return view(spark, d, "nodes").select("id", F.regexp_replace("label", r"\(\)$", "").alias("label"))


# --- sources --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, CAST(len([x FOR x IN string_split_regex(text, '[ \\t\\n\\r\\f\\v]+') IF x <> '']) AS BIGINT) AS words FROM documents")
def s7_word_count(spark, d):
    return table(spark, d, "documents").select("doc_id", text.word_count(F.col("text")).alias("words"))


_SIGNAL_SQL = " + ".join("CAST(regexp_matches(substr(text, 1, 3000), '{}') AS INT)".format(p.replace("'", "''")) for p in text.PAPER_SIGNALS)


@query(f"SELECT doc_id, CAST({_SIGNAL_SQL} AS INT) AS signals, ({_SIGNAL_SQL}) >= 3 AS is_paper FROM documents")
def s3_paper_heuristic(spark, d):
    s = text.paper_signals(F.col("text"))
    return table(spark, d, "documents").select("doc_id", s.cast("int").alias("signals"), (s >= 3).alias("is_paper"))


@query("""SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.pdf([?#]|$)') THEN 'pdf' WHEN regexp_matches(lower(url), '\\.(png|jpg|jpeg|webp|gif)([?#]|$)') THEN 'image' ELSE 'webpage' END AS kind FROM pages""")
def s10_url_type(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_type(F.col("url")).alias("kind"))


@query("""SELECT page_id, sha256(substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')), 1, 8000)) AS visible FROM pages""")
def s11_html_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.html_text(F.col("html")).cast("binary"), 256).alias("visible"))


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages")
def e4_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))


@query("SELECT doc_id, CAST(floor(length(text) / 4) AS BIGINT) AS tokens FROM documents")
def e11_token_estimate(spark, d):
    return table(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 4).alias("tokens"))


# --- build ----------------------------------------------------------------------------------------------------------


@query("""SELECT e.seq, CASE WHEN s.id IS NOT NULL THEN source ELSE coalesce(fs.id, source) END AS source, CASE WHEN t.id IS NOT NULL THEN target ELSE coalesce(ft.id, target) END AS target
          FROM (SELECT seq, CASE WHEN seq % 3 = 0 THEN upper(source) ELSE source END AS source, target FROM edges) e LEFT JOIN nodes s ON s.id = source LEFT JOIN nodes t ON t.id = target
          LEFT JOIN nodes fs ON fs.id = lower(source) LEFT JOIN nodes ft ON ft.id = lower(target)""", N, E)
def j1_resolve_endpoints(spark, d):
    edges = view(spark, d, "edges").withColumn("source", F.when(F.col("seq") % 3 == 0, F.upper("source")).otherwise(F.col("source")))
    return build.resolve_endpoints(edges.select("seq", "source", "target"), view(spark, d, "nodes")).select("seq", "source", "target")


@query("""SELECT DISTINCT target AS id, target AS label, 'concept' AS file_type, '' AS source_file FROM (SELECT source, CASE WHEN seq % 5 = 0 THEN 'external_' || target ELSE target END AS target, relation FROM edges)
          WHERE relation IN ('imports', 'imports_from', 're_exports') AND source IN (SELECT id FROM nodes) AND target NOT IN (SELECT id FROM nodes)""", N, E)
def j2_external_stubs(spark, d):
    edges = view(spark, d, "edges").withColumn("target", F.when(F.col("seq") % 5 == 0, F.concat(F.lit("external_"), "target")).otherwise(F.col("target")))
    return build.stubs(edges, view(spark, d, "nodes"))


@query(SOUND + " SELECT seq, source, target FROM sound", N, E)
def j3_prune_dangling(spark, d):
    return build.prune_dangling(view(spark, d, "edges"), view(spark, d, "nodes")).select("seq", "source", "target")


@query("""SELECT label, min(id) AS id FROM nodes GROUP BY label HAVING count(*) = 1""", N)
def j12_unique_definitions(spark, d):
    return view(spark, d, "nodes").groupBy("label").agg(F.min("id").alias("id"), F.count("*").alias("n")).filter("n = 1").select("label", "id")


@query("""SELECT a.id AS a, b.id AS b FROM nodes a JOIN nodes b ON a.label = b.label AND a.file_type = b.file_type AND a.community < b.community""", N)
def j14_shared_types(spark, d):
    n = view(spark, d, "nodes").withColumn("repo", F.col("community"))
    return incremental.shared_types(n)


@query(SOUND + COLLAPSED + " SELECT lo, hi, source, target, relation, confidence, confidence_score, weight, context, source_file, source_location FROM collapsed", N, E)
def w4_collapse_edges(spark, d):
    _, edges, _ = graph(spark, d)
    return build.collapse(edges)


@query("SELECT source, target, relation, seq, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, target, relation ORDER BY seq) AS k FROM edges) WHERE k = 1", E)
def w5_first_edges(spark, d):
    return build.first_edges(view(spark, d, "edges")).select("source", "target", "relation", "seq", "confidence")


@query("""WITH p AS (SELECT DISTINCT source_file AS path FROM nodes WHERE source_file <> ''),
          s AS (SELECT path, k, array_to_string(string_split(path, '/')[-k:], '/') AS label FROM p, unnest(range(1, len(string_split(path, '/')) + 1)) AS u(k)),
          u AS (SELECT label, min(path) AS path, min(k) AS k FROM s GROUP BY label HAVING count(*) = 1)
          SELECT p.path, coalesce(arg_min(u.label, u.k), p.path) AS label FROM p LEFT JOIN u ON u.path = p.path GROUP BY p.path""", N)
def w6_unique_suffix(spark, d):
    return build.shortest_unique_suffix(view(spark, d, "nodes").filter("source_file <> ''"), "source_file")


@query("SELECT seq, CASE WHEN weight IS NULL THEN NULL WHEN weight < 0 THEN 1.0 ELSE weight END AS weight, CASE WHEN confidence_score < 0 THEN 1.0 ELSE confidence_score END AS confidence_score FROM edges", E)
def m2_sanitise_numbers(spark, d):
    return build.sanitise(view(spark, d, "edges")).select("seq", "weight", "confidence_score")


@query("""SELECT seq, CASE WHEN e.source_file <> '' THEN e.source_file WHEN s.source_file <> '' THEN s.source_file WHEN t.source_file <> '' THEN t.source_file ELSE '' END AS source_file
          FROM edges e LEFT JOIN nodes s ON s.id = e.source LEFT JOIN nodes t ON t.id = e.target""", N, E)
def m3_backfill_source(spark, d):
    return build.backfill_source(view(spark, d, "edges"), view(spark, d, "nodes")).select("seq", "source_file")


@query("""SELECT seq FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target,
          LATERAL (SELECT regexp_extract(s.source_file, '(\\.[^./]+)$', 1) AS es, regexp_extract(t.source_file, '(\\.[^./]+)$', 1) AS et) x,
          LATERAL (SELECT CASE es WHEN '.py' THEN 'python' WHEN '.ts' THEN 'js' END AS fs, CASE et WHEN '.py' THEN 'python' WHEN '.ts' THEN 'js' END AS ft) f
          WHERE NOT (relation = 'calls' AND confidence = 'INFERRED' AND es <> '' AND et <> '' AND fs IS DISTINCT FROM ft)
            AND NOT (relation IN ('imports', 'imports_from', 'references') AND coalesce(fs <> ft, false))""", N, E)
def m4_cross_language(spark, d):
    return build.drop_cross_language(view(spark, d, "edges"), view(spark, d, "nodes")).select("seq")


@query("SELECT seq FROM (SELECT seq, relation, source, CASE WHEN seq % 2 = 0 THEN source ELSE target END AS target FROM edges) WHERE NOT (source = target AND relation IN ('imports', 'imports_from', 're_exports'))", E)
def m5_import_loops(spark, d):
    edges = view(spark, d, "edges").withColumn("target", F.when(F.col("seq") % 2 == 0, F.col("source")).otherwise(F.col("target")))
    return build.drop_import_loops(edges).select("seq")


@query("""SELECT hid, array_to_string(list(node ORDER BY pos, node), ',') AS nodes FROM (SELECT hid, node, min(pos) AS pos FROM (
            SELECT l_orderkey AS hid, 'part_' || CAST(l_partkey + 30 AS VARCHAR) AS node, l_linenumber AS pos FROM lineitem) WHERE node IN (SELECT id FROM nodes) GROUP BY hid, node) GROUP BY hid""", N)
def m6_hyperedges(spark, d):
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("hid"), F.concat(F.lit("part_"), (F.col("l_partkey") + 30).cast("string")).alias("node"), F.col("l_linenumber").alias("pos"))
    return build.compact_hyperedges(members, view(spark, d, "nodes")).select("hid", F.array_join("nodes", ",").alias("nodes"))


@query("""SELECT 'edge' AS kind, concat_ws('>', source, target) AS key, 'missing ' || c AS problem FROM edges, (VALUES ('source'), ('target'), ('relation'), ('confidence'), ('source_file')) v(c)
            WHERE CASE c WHEN 'source' THEN source WHEN 'target' THEN target WHEN 'relation' THEN relation WHEN 'confidence' THEN confidence ELSE source_file END IS NULL
          UNION ALL SELECT 'edge', source || '>' || target, 'unmatched source' FROM edges WHERE source NOT IN (SELECT id FROM nodes)
          UNION ALL SELECT 'edge', source || '>' || target, 'unmatched target' FROM edges WHERE target NOT IN (SELECT id FROM nodes)""", N, E)
def m1_validate(spark, d):
    return build.violations(view(spark, d, "nodes"), view(spark, d, "edges"))


@query(SOUND + """, m AS (SELECT id AS old, 'part_' || CAST(CAST(substr(id, 6) AS BIGINT) // 2 * 2 AS VARCHAR) AS new FROM nodes WHERE starts_with(id, 'part_') AND CAST(substr(id, 6) AS BIGINT) % 2 = 1 AND CAST(substr(id, 6) AS BIGINT) > 1),
          r AS (SELECT seq, coalesce(a.new, source) AS s, coalesce(b.new, target) AS t, source = target AS was FROM sound LEFT JOIN m a ON a.old = source LEFT JOIN m b ON b.old = target)
          SELECT seq, s AS source, t AS target FROM r WHERE s <> t OR was""", N, E)
def d7_rewire(spark, d):
    nodes, edges, _ = graph(spark, d)
    k = F.substring("id", 6, 20).cast("long")
    parts = nodes.filter(F.col("id").startswith("part_")).filter((k % 2 == 1) & (k > 1))
    remap = parts.select(F.col("id").alias("old"), F.concat(F.lit("part_"), (k - 1).cast("string")).alias("new"))
    return build.rewire(edges, remap).select("seq", "source", "target")


# --- analysis -------------------------------------------------------------------------------------------------------


@query(DEGREE + " SELECT id, degree FROM degree", N, E)
def a1_degree(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.degrees(nodes, pairs)


@query(SOUND + COLLAPSED + """ SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT community) FROM nodes) AS n_communities, count(*) AS n_edges,
        CAST(round_even(sum(CASE confidence WHEN 'EXTRACTED' THEN 100.0 ELSE 0 END)::DOUBLE / count(*), 0) AS BIGINT) AS pct_extracted,
        CAST(round_even(sum(CASE confidence WHEN 'INFERRED' THEN 100.0 ELSE 0 END)::DOUBLE / count(*), 0) AS BIGINT) AS pct_inferred,
        CAST(round_even(sum(CASE confidence WHEN 'AMBIGUOUS' THEN 100.0 ELSE 0 END)::DOUBLE / count(*), 0) AS BIGINT) AS pct_ambiguous FROM collapsed""", N, E)
def a2_graph_stats(spark, d):
    nodes, edges, _ = graph(spark, d)
    return analyze.graph_stats(nodes, build.collapse(edges))


_COMM = ", cp AS (SELECT lo, hi, a.community AS cu, b.community AS cv FROM pairs JOIN nodes a ON a.id = lo JOIN nodes b ON b.id = hi)"


@query(PAIRS + _COMM + """ SELECT s.community, n_nodes, CASE WHEN n_nodes <= 1 THEN 1.0 ELSE coalesce(m, 0) / (n_nodes * (n_nodes - 1) / 2) END AS cohesion
        FROM (SELECT community, count(*) AS n_nodes FROM nodes GROUP BY 1) s LEFT JOIN (SELECT cu, count(*) AS m FROM cp WHERE cu = cv AND lo <> hi GROUP BY 1) i ON i.cu = s.community""", N, E)
def a3_cohesion(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.cohesion(nodes, pairs)


@query("SELECT community, substr(sha256(string_agg(id, chr(0) ORDER BY id) || chr(0)), 1, 16) AS signature FROM nodes GROUP BY community", N)
def a4_signatures(spark, d):
    return analyze.signatures(view(spark, d, "nodes"))


@query(DEGREE + " SELECT community, regexp_replace(label, '\\(\\)$', '') AS label FROM (SELECT community, label, row_number() OVER (PARTITION BY community ORDER BY degree DESC, id) AS k FROM nodes JOIN degree USING (id)) WHERE k = 1", N, E)
def a5_hub_labels(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.hub_labels(nodes, pairs)


@query(PAIRS + _COMM + " SELECT least(cu, cv) AS a, greatest(cu, cv) AS b, count(*) AS n FROM cp WHERE cu <> cv GROUP BY 1, 2", N, E)
def a6_community_edges(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.community_edges(nodes, pairs)


@query("""SELECT community, count(*) FILTER (confidence = 'EXTRACTED') AS n_extracted, count(*) FILTER (confidence = 'INFERRED') AS n_inferred, count(*) FILTER (confidence = 'AMBIGUOUS') AS n_ambiguous
          FROM edges JOIN nodes ON id = source GROUP BY community""", N, E)
def a7_confidence_by_community(spark, d):
    return analyze.confidence_by_community(view(spark, d, "nodes"), view(spark, d, "edges"))


@query(SOUND + """, pr AS (SELECT source, target, relation, count(*) AS n, count(DISTINCT coalesce(source_file, '')) > 1 AS f, count(DISTINCT coalesce(source_location, '')) > 1 AS l, count(DISTINCT coalesce(context, '')) > 1 AS c FROM sound GROUP BY 1, 2, 3),
        pp AS (SELECT source, target, sum(n) AS n, count(*) AS r FROM pr GROUP BY 1, 2)
        SELECT (SELECT count(*) FROM sound) AS valid_edges, (SELECT count(*) FROM pp) AS directed_pairs, (SELECT count(DISTINCT (least(source, target), greatest(source, target))) FROM pp) AS undirected_pairs,
            (SELECT count(*) FROM pp WHERE n > 1) AS same_endpoint_groups, (SELECT count(*) FROM pp WHERE r > 1) AS relation_variants, (SELECT count(*) FROM pr WHERE f) AS file_variants,
            (SELECT count(*) FROM pr WHERE l) AS location_variants, (SELECT count(*) FROM pr WHERE c) AS context_variants, (SELECT count(*) FROM sound WHERE source = target) AS self_loops,
            (SELECT count(*) FROM edges) AS raw_edges, (SELECT count(*) FROM edges) - (SELECT count(*) FROM sound) AS dangling_edges""", N, E)
def a8_integrity(spark, d):
    return analyze.integrity(view(spark, d, "nodes"), view(spark, d, "edges"))


@query(SOUND + """ SELECT source, target, count(*) AS edge_count, string_agg(DISTINCT coalesce(relation, ''), ',' ORDER BY coalesce(relation, '')) AS relations,
        string_agg(DISTINCT coalesce(context, ''), ',' ORDER BY coalesce(context, '')) AS contexts FROM sound GROUP BY 1, 2 HAVING count(*) > 1 ORDER BY edge_count DESC, source, target LIMIT 5""", N, E)
def a9_duplicated_pairs(spark, d):
    return analyze.duplicated_pairs(view(spark, d, "nodes"), view(spark, d, "edges"))


@query("SELECT round(avg(coalesce(confidence_score, 0.5)), 6) AS score FROM edges WHERE confidence = 'INFERRED'", E)
def a10_inferred_average(spark, d):
    return view(spark, d, "edges").filter("confidence = 'INFERRED'").agg(F.round(F.avg(F.coalesce("confidence_score", F.lit(0.5))), 6).alias("score"))


@query(FLAGS + " SELECT id, label, degree FROM flags WHERE NOT is_file AND NOT is_concept ORDER BY degree DESC, id LIMIT 10", N, E)
def k1_god_nodes(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.god_nodes(nodes, pairs)


@query(FLAGS + """, t AS (SELECT degree AS threshold FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS n FROM degree) WHERE k = greatest(0, CAST(floor(n * 99 / 100) AS BIGINT) - 1))
        SELECT id, label, degree FROM flags, t WHERE degree <= threshold AND NOT is_file AND NOT is_concept ORDER BY degree DESC, id LIMIT 10""", N, E)
def k1_god_nodes_without_hubs(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.god_nodes(nodes, pairs, exclude_percent=99)


@query(DEGREE + """ SELECT (SELECT degree FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS n FROM degree) WHERE k = greatest(0, CAST(floor(n * 95 / 100) AS BIGINT) - 1)) AS hub,
        (SELECT greatest(50, degree) FROM (SELECT degree, row_number() OVER (ORDER BY degree) - 1 AS k, count(*) OVER () AS n FROM degree) WHERE k = CAST(floor(n * 0.99) AS BIGINT)) AS expansion""", N, E)
def w7_thresholds(spark, d):
    nodes, _, pairs = graph(spark, d)
    deg = analyze.degrees(nodes, pairs)
    return analyze.percentile_degree(deg, 95).select(F.col("threshold").alias("hub")).join(analyze.expansion_threshold(deg).select(F.col("threshold").alias("expansion")))


_CATEGORY = "CASE regexp_extract({0}, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'code' WHEN '.ts' THEN 'code' WHEN '.pdf' THEN 'paper' ELSE 'doc' END"
_FAMILY = "CASE regexp_extract({0}, '(\\.[^./]+)$', 1) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'js' END"


@query(FLAGS + COLLAPSED + f""", c AS (SELECT k.lo, k.hi, k.relation, k.confidence, u.degree AS du, v.degree AS dv, {_CATEGORY.format("u.source_file")} AS cu, {_CATEGORY.format("v.source_file")} AS cv,
            split_part(u.source_file, '/', 1) <> split_part(v.source_file, '/', 1) AS dirs, coalesce(u.community <> v.community, false) AS comms,
            coalesce({_FAMILY.format("u.source_file")} <> {_FAMILY.format("v.source_file")}, false) AS langs
          FROM collapsed k JOIN flags u ON u.id = k.lo JOIN flags v ON v.id = k.hi WHERE k.relation NOT IN ('imports', 'imports_from', 'contains', 'method')
            AND NOT u.is_concept AND NOT v.is_concept AND NOT u.is_file AND NOT v.is_file AND u.source_file <> v.source_file),
        q AS (SELECT *, confidence = 'INFERRED' AND relation IN ('calls', 'uses') AND (langs OR (cu = 'code' AND cv = 'doc') OR (cu = 'doc' AND cv = 'code')) AS quiet FROM c),
        b AS (SELECT *, CASE WHEN quiet THEN 0 ELSE CASE confidence WHEN 'AMBIGUOUS' THEN 3 WHEN 'INFERRED' THEN 2 ELSE 1 END + CASE WHEN cu <> cv THEN 2 ELSE 0 END + CASE WHEN dirs THEN 2 ELSE 0 END + CASE WHEN comms THEN 1 ELSE 0 END END AS base FROM q)
        SELECT lo, hi, relation, confidence, CAST(CASE relation WHEN 'semantically_similar_to' THEN floor(base * 1.5) ELSE base END + CASE WHEN least(du, dv) <= 2 AND greatest(du, dv) >= 5 THEN 1 ELSE 0 END AS BIGINT) AS score
        FROM b ORDER BY score DESC, lo, hi LIMIT 20""", N, E)
def k2_surprises(spark, d):
    nodes, edges, _ = graph(spark, d)
    return analyze.surprises(nodes, build.collapse(edges))


@query("""SELECT 'removed' AS change, source, target FROM (SELECT DISTINCT source, target FROM edges WHERE seq % 10 < 8 EXCEPT SELECT source, target FROM edges WHERE seq % 10 > 1)
          UNION ALL SELECT 'added', source, target FROM (SELECT DISTINCT source, target FROM edges WHERE seq % 10 > 1 EXCEPT SELECT source, target FROM edges WHERE seq % 10 < 8)""", E)
def k6_graph_diff(spark, d):
    edges = view(spark, d, "edges")
    return analyze.diff(edges.filter("seq % 10 < 8"), edges.filter("seq % 10 > 1"), ["source", "target"])


@query(FLAGS + " SELECT id, degree FROM flags WHERE degree <= 1 AND NOT is_file AND NOT is_concept AND file_type <> 'rationale'", N, E)
def g16_isolated(spark, d):
    nodes, _, pairs = graph(spark, d)
    return analyze.isolated(nodes, pairs)


@query(FLAGS + COLLAPSED + """, top AS (SELECT id, degree FROM flags WHERE NOT is_file ORDER BY degree DESC, id LIMIT 5)
        SELECT id, degree, count(*) AS inferred FROM top JOIN collapsed ON confidence = 'INFERRED' AND (id = lo OR id = hi) GROUP BY 1, 2 HAVING count(*) >= 2""", N, E)
def g17_verify_candidates(spark, d):
    nodes, edges, _ = graph(spark, d)
    return analyze.verify_candidates(nodes, build.collapse(edges))


@query(SOUND + COLLAPSED + """ SELECT a, b, lo, hi, confidence FROM (SELECT lo, hi, confidence, least(u.community, v.community) AS a, greatest(u.community, v.community) AS b,
        row_number() OVER (PARTITION BY least(u.community, v.community), greatest(u.community, v.community) ORDER BY CASE confidence WHEN 'AMBIGUOUS' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, lo, hi) AS k
        FROM collapsed JOIN nodes u ON u.id = lo JOIN nodes v ON v.id = hi WHERE u.community <> v.community) WHERE k = 1""", N, E)
def w11_bridges(spark, d):
    nodes, edges, _ = graph(spark, d)
    return analyze.bridges_between(nodes, build.collapse(edges))


@query("""SELECT turn, event_type, event_id FROM (SELECT row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS turn, event_type, event_id FROM events) ORDER BY turn, list_position(['purchase', 'error', 'signup', 'click', 'view'], event_type) LIMIT 7""")
def w12_interleave(spark, d):
    return analyze.interleave(table(spark, d, "events"), "event_type", ["event_id"], ["purchase", "error", "signup", "click", "view"], 7).select("turn", "event_type", "event_id")


@query("""SELECT c_nationkey AS old_cid, c_custkey % 25 AS new_cid, count(*) AS overlap FROM customer GROUP BY 1, 2""")
def w13_community_overlap(spark, d):
    c = table(spark, d, "customer")
    return analyze.community_overlap(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cid")), c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).alias("cid")))


@query()
def w13_greedy_remap(spark, d):
    c = table(spark, d, "customer")
    return analyze.greedy_remap(c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("cid")), c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 25).alias("cid")))


# --- traversals -----------------------------------------------------------------------------------------------------

_SYM = PAIRS + ", adj AS (SELECT lo AS src, hi AS dst FROM pairs UNION SELECT hi, lo FROM pairs)"


@query(_SYM + """, f0 AS (SELECT 'supplier_1' AS id), f1 AS (SELECT DISTINCT dst AS id FROM adj WHERE src IN (SELECT id FROM f0)), f2 AS (SELECT DISTINCT dst AS id FROM adj WHERE src IN (SELECT id FROM f1))
        SELECT id, CAST(min(distance) AS INT) AS distance FROM (SELECT id, 0 AS distance FROM f0 UNION ALL SELECT id, 1 FROM f1 UNION ALL SELECT id, 2 FROM f2) GROUP BY id""", N, E)
def g1_neighbourhood(spark, d):
    _, _, pairs = graph(spark, d)
    return traverse.reach(traverse.symmetric(pairs), spark.createDataFrame([("supplier_1",)], "id string"), 2)


@query(_SYM + """, v AS (SELECT 'supplier_1' AS id UNION SELECT dst FROM adj WHERE src = 'supplier_1') SELECT lo, hi FROM pairs WHERE lo <> hi AND lo IN (SELECT id FROM v) AND hi IN (SELECT id FROM v)""", N, E)
def k7_induced_edges(spark, d):
    _, _, pairs = graph(spark, d)
    return traverse.induced(pairs, traverse.reach(traverse.symmetric(pairs), spark.createDataFrame([("supplier_1",)], "id string"), 1))


@query(SOUND + """, dep AS (SELECT source, target, relation FROM sound WHERE relation IN ('calls', 'references', 'imports_from', 'uses')),
        s AS (SELECT 'nation_3' AS id UNION SELECT target FROM sound WHERE source = 'nation_3' AND relation = 'contains'),
        d1 AS (SELECT source AS id, min(relation) AS relation FROM dep WHERE target IN (SELECT id FROM s) AND source NOT IN (SELECT id FROM s) GROUP BY 1),
        d2 AS (SELECT source AS id, min(relation) AS relation FROM dep WHERE target IN (SELECT id FROM d1) AND source NOT IN (SELECT id FROM s) AND source NOT IN (SELECT id FROM d1) GROUP BY 1)
        SELECT id, CAST(1 AS INT) AS depth, relation FROM d1 UNION ALL SELECT id, 2, relation FROM d2""", N, E)
def g3_affected(spark, d):
    _, edges, _ = graph(spark, d)
    return traverse.affected(edges, "nation_3")


@query(SOUND + """, RECURSIVE_PLACEHOLDER SELECT 1""".replace(", RECURSIVE_PLACEHOLDER SELECT 1", """, a1 AS (SELECT min(source) AS p FROM sound WHERE target = 'region_1'), h AS (SELECT min(source) AS q FROM sound WHERE source LIKE 'customer%' AND target IN (SELECT source FROM sound WHERE target = 'region_1'))
        SELECT CAST(hop AS INT) AS hop, id FROM (SELECT 0 AS hop, (SELECT q FROM h) AS id UNION ALL SELECT 1, (SELECT min(target) FROM sound WHERE source = (SELECT q FROM h) AND target IN (SELECT source FROM sound WHERE target = 'region_1')) UNION ALL SELECT 2, 'region_1')"""), N, E)
def g7_shortest_path(spark, d):
    _, edges, _ = graph(spark, d)
    start = edges.filter("target = 'region_1'").select(F.col("source").alias("target"))
    first = edges.filter("source like 'customer%'").join(start, "target", "left_semi").agg(F.min("source")).first()[0]
    return traverse.shortest_path(edges.select(F.col("source").alias("src"), F.col("target").alias("dst")), first, "region_1")


_FILE_ARCS = "SELECT DISTINCT l_suppkey % 100 AS src, (l_suppkey * 7 + l_partkey % 3) % 100 AS dst FROM lineitem"


@query(f"""WITH RECURSIVE arcs AS ({_FILE_ARCS}), w AS (SELECT [src, dst] AS path, dst AS at, 1 AS n FROM arcs WHERE src < dst
          UNION ALL SELECT list_append(w.path, a.dst), a.dst, n + 1 FROM w JOIN arcs a ON a.src = w.at WHERE n < 4 AND a.dst > w.path[1] AND NOT list_contains(w.path, a.dst))
          SELECT CAST(len(path) AS INT) AS length, array_to_string(path, '>') AS path FROM w JOIN arcs a ON a.src = w.at AND a.dst = w.path[1] UNION ALL SELECT 1, CAST(src AS VARCHAR) FROM arcs WHERE src = dst""")
def g8_import_cycles(spark, d):
    li = table(spark, d, "lineitem")
    arcs = li.select((F.col("l_suppkey") % 100).alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_partkey") % 3) % 100).alias("dst")).distinct()
    return traverse.cycles(arcs).select("length", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey - 7 AS b FROM customer WHERE c_custkey > 7 AND c_custkey % 5 <> 0), both_ways AS (SELECT a AS u, b AS v FROM e UNION SELECT b, a FROM e),
          r AS (SELECT u AS node, u AS seen FROM both_ways UNION SELECT r.node, v FROM r JOIN both_ways ON u = seen) SELECT node, min(seen) AS component FROM r GROUP BY node""")
def g13_components(spark, d):
    c = table(spark, d, "customer").filter("c_custkey > 7 and c_custkey % 5 <> 0")
    return components(c.select(F.col("c_custkey").alias("a"), (F.col("c_custkey") - 7).alias("b")))


@query("SELECT 'out' AS direction, target AS id, relation, confidence FROM edges WHERE source = 'supplier_1' UNION ALL SELECT 'in', source, relation, confidence FROM edges WHERE target = 'supplier_1'", E)
def g14_neighbours(spark, d):
    return traverse.neighbours(view(spark, d, "edges"), "supplier_1")


@query("SELECT id, label FROM nodes WHERE community = 3", N)
def g15_community_members(spark, d):
    return view(spark, d, "nodes").filter("community = 3").select("id", "label")


# --- retrieval ------------------------------------------------------------------------------------------------------

_TERMS = retrieve.query_terms("where is the customer 0001 of supplier and nation?")


@query("SELECT term, df, round(ln(1 + n / (1 + df)), 6) AS idf FROM (SELECT term, count(*) FILTER (contains(lower(label), term)) AS df, count(*)::DOUBLE AS n FROM nodes, (VALUES " + ", ".join(f"('{t}')" for t in _TERMS) + ") v(term) GROUP BY term)", N)
def a11_idf(spark, d):
    return retrieve.document_frequencies(view(spark, d, "nodes"), _TERMS).withColumn("idf", F.round("idf", 6))


_SCORED = """WITH t AS (SELECT unnest([{terms}]) AS term), n AS (SELECT id, label, lower(source_file) AS src, lower(coalesce(rationale, '')) AS why, lower(label) AS nl, regexp_replace(lower(label), '[()]+$', '') AS bl,
        array_to_string(regexp_extract_all(lower(label), '[a-z0-9]+'), ' ') AS lt FROM nodes),
    idf AS (SELECT term, ln(1 + (SELECT count(*) FROM n)::DOUBLE / (1 + count(*) FILTER (contains(nl, term)))) AS w FROM t, n GROUP BY term),
    x AS (SELECT id, label, nl, bl, lt, term, w, CASE WHEN nl = term OR bl = term THEN 1000 * w WHEN starts_with(nl, term) OR starts_with(bl, term) THEN 100 * w ELSE 0 END AS tier, contains(nl, term) AS hit,
        CASE WHEN contains(src, term) THEN 0.5 * w ELSE 0 END + CASE WHEN contains(why, term) THEN 0.75 * w ELSE 0 END AS side FROM n, idf)"""


@query((_SCORED + """, s AS (SELECT id, any_value(label) AS label, any_value(CASE WHEN '{joined}' IN (nl, bl, lt, lower(id)) THEN 10000.0 WHEN starts_with(nl, '{joined}') OR starts_with(bl, '{joined}') OR starts_with(lt, '{joined}') THEN 1000.0 ELSE 0.0 END) * (SELECT max(w) FROM idf)
        + sum(side) + sum(CASE WHEN hit AND tier = 0 THEN w ELSE 0 END) + sum(tier) * pow(count(*) FILTER (hit)::DOUBLE / {n}, 2) AS score FROM x GROUP BY id)
    SELECT id, round(score, 6) AS score FROM s WHERE score > 0""").format(terms=", ".join(f"'{t}'" for t in _TERMS), joined=" ".join(_TERMS), n=len(_TERMS)), N)
def q2_scores(spark, d):
    return retrieve.scores(view(spark, d, "nodes"), _TERMS).select("id", F.round("score", 6).alias("score"))


@query((DEGREE + _SCORED.replace("WITH t AS", ", t AS") + """ SELECT term, id FROM (SELECT term, id, row_number() OVER (PARTITION BY term ORDER BY CASE WHEN term IN (nl, bl, lt, lower(id)) THEN 10000 * w WHEN starts_with(nl, term) OR starts_with(bl, term) OR starts_with(lt, term) THEN 1000 * w ELSE 0 END
        + tier + side + CASE WHEN hit AND tier = 0 THEN w ELSE 0 END DESC, degree DESC, length(label), id) AS k, tier, side, hit FROM x JOIN degree USING (id)) WHERE k = 1 AND (tier > 0 OR side > 0 OR hit)""").format(terms=", ".join(f"'{t}'" for t in _TERMS)), N, E)
def w9_seeds(spark, d):
    nodes, _, pairs = graph(spark, d)
    return retrieve.seeds_by_term(nodes, analyze.degrees(nodes, pairs), _TERMS)


@query("""WITH t AS (SELECT id, source_file, CASE WHEN array_to_string(regexp_extract_all(lower(source_file), '[a-z0-9]+'), ' ') = 'germany' THEN 0 WHEN lower(label) = 'germany' OR lower(id) = 'germany' THEN 1
          WHEN starts_with(lower(label), 'germany') THEN 2 WHEN contains(lower(label), 'germany') THEN 3 END AS tier FROM nodes) SELECT id, tier, source_file FROM t WHERE tier = (SELECT min(tier) FROM t)""", N)
def g5_lookup(spark, d):
    return retrieve.lookup(view(spark, d, "nodes"), "Germany")


@query("SELECT seq, context FROM edges WHERE context IN ('call', 'field')", E)
def q3_context_filter(spark, d):
    return view(spark, d, "edges").filter(F.col("context").isin("call", "field")).select("seq", "context")


# --- feedback and facts ---------------------------------------------------------------------------------------------

_NOW = "2024-02-01 00:00:00"
_SIGNED = f"""WITH m AS (SELECT node, CASE outcome WHEN 'useful' THEN 1 WHEN 'dead_end' THEN -1 WHEN 'corrected' THEN -1 END AS sign, pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{_NOW}') - epoch_us(ts)) / 86400000000.0) / 30.0) AS w FROM memory WHERE outcome IS NOT NULL),
    s AS (SELECT node, count(*) FILTER (sign > 0) AS pos, count(*) FILTER (sign < 0) AS neg, round(sum(sign * w), 9) AS score FROM m GROUP BY node)"""


@query(_SIGNED + " SELECT node, pos, neg, round(score, 6) AS score FROM s", "memory")
def a12_lesson_scores(spark, d):
    return feedback.scored(view(spark, d, "memory"), _NOW).select("node", "pos", "neg", F.round("score", 6).alias("score"))


@query(_SIGNED + """ SELECT node, CASE WHEN pos > 0 AND neg > 0 THEN 'contested' WHEN pos >= 2 THEN 'preferred' ELSE 'tentative' END AS kind,
        CASE WHEN pos > 0 AND neg > 0 THEN CASE WHEN score > 0 THEN 'useful' WHEN score < 0 THEN 'dead end' ELSE 'even' END END AS verdict, round(score, 6) AS score FROM s WHERE pos > 0""", "memory")
def a15_lessons(spark, d):
    return feedback.lessons(view(spark, d, "memory"), _NOW).select("node", "kind", "verdict", F.round("score", 6).alias("score"))


@query("SELECT m.question, arg_min(community, (-n, community)) AS community FROM (SELECT question, community, count(*) AS n FROM memory JOIN nodes ON id = node GROUP BY 1, 2) m GROUP BY 1", "memory", N)
def a13_plurality(spark, d):
    return feedback.plurality(view(spark, d, "memory"), view(spark, d, "nodes"))


@query("SELECT question, doc_id, correction FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY ts DESC, doc_id DESC) AS k FROM memory WHERE outcome = 'corrected') WHERE k = 1", "memory")
def a14_latest_corrections(spark, d):
    return feedback.latest_by_question(view(spark, d, "memory"), "corrected")


_SETS = "WITH v AS (SELECT s, p, g, list_sort(list_distinct(list(o))) AS vals FROM quads GROUP BY 1, 2, 3)"
_CONF = _SETS + ", c AS (SELECT s, p, count(*) AS sources, array_to_string(list_sort(list_distinct(flatten(list(vals)))), '|') AS values FROM v GROUP BY 1, 2 HAVING count(DISTINCT vals) > 1)"


@query(_CONF + " SELECT s, p, sources, values FROM c", "quads")
def a20_conflicts(spark, d):
    return quads.conflicts(view(spark, d, "quads"))


@query(_SETS + " SELECT s, p, g, CAST(len(vals) AS BIGINT) AS n, array_to_string(vals, '|') AS values FROM v WHERE len(vals) > 1", "quads")
def a21_inconsistencies(spark, d):
    return quads.inconsistencies(view(spark, d, "quads"))


@query(_CONF + """, f AS (SELECT DISTINCT q.s, q.p, q.g, x.source, x.layer, x.date, x.version_key, x.override_of FROM quads q JOIN c ON c.s = q.s AND c.p = q.p JOIN graphs x ON x.g = q.g)
        SELECT DISTINCT q.s, q.p, q.g, q.o FROM quads q JOIN f a ON a.s = q.s AND a.p = q.p AND a.g = q.g WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.s = a.s AND b.p = a.p AND b.g <> a.g AND (
            (b.layer = 'wiki' AND coalesce(b.override_of IN (a.source, a.s), false)) OR (NOT (a.layer = 'wiki' AND coalesce(a.override_of IN (b.source, b.s), false)) AND
            ((b.layer = 'raw' AND a.layer = 'wiki') OR (b.layer = a.layer AND (b.date > a.date OR (b.date = a.date AND b.version_key > a.version_key)))))))""", "quads", "graphs")
def j20_precedence(spark, d):
    return quads.winners(view(spark, d, "quads"), view(spark, d, "graphs"))


@query("SELECT s, p, g, o FROM quads WHERE contains(lower(o), 'urgent') ORDER BY s, p, g, o LIMIT 50", "quads")
def m29_search(spark, d):
    return quads.search(view(spark, d, "quads"), "URGENT")


@query("""SELECT s, a + b + CASE WHEN a > 0 AND b > 0 THEN 5.0 ELSE 0.0 END AS score FROM (SELECT s, max(CASE WHEN contains(lower(o), 'machinery') THEN CASE p WHEN 'segment' THEN 3.0 ELSE 1.0 END ELSE 0.0 END)::DOUBLE AS a,
          max(CASE WHEN contains(lower(o), 'urgent') THEN CASE p WHEN 'segment' THEN 3.0 ELSE 1.0 END ELSE 0.0 END)::DOUBLE AS b FROM quads GROUP BY s) WHERE a + b > 0 ORDER BY score DESC, s LIMIT 20""", "quads")
def q7_ask(spark, d):
    return quads.ask(view(spark, d, "quads"), ["machinery", "urgent"], {"segment": 3.0})


# --- incremental and streaming --------------------------------------------------------------------------------------


@query("""WITH o AS (SELECT path, sha256(text) AS hash FROM files WHERE doc_id % 10 <> 1), n AS (SELECT path, sha256(CASE WHEN doc_id % 10 = 2 THEN text || 'x' ELSE text END) AS hash FROM files WHERE doc_id % 10 <> 3)
          SELECT path, CASE WHEN o.hash IS NULL THEN 'new' WHEN n.hash IS NULL THEN 'deleted' WHEN o.hash = n.hash THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL JOIN n USING (path)""", "files")
def s8_manifest_diff(spark, d):
    f = view(spark, d, "files")
    old = f.filter("doc_id % 10 <> 1").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    new = f.filter("doc_id % 10 <> 3").select("path", F.sha2(F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")).cast("binary"), 256).alias("hash"))
    return incremental.manifest_diff(old, new)


@query("""SELECT seq, confidence FROM edges WHERE source_file NOT IN (SELECT source_file FROM edges WHERE seq % 101 = 0) UNION ALL SELECT seq, 'EXTRACTED' FROM edges WHERE seq % 101 = 0""", E)
def t3_replace_sources(spark, d):
    edges = view(spark, d, "edges").select("seq", "confidence", "source_file")
    return incremental.replace_sources(edges, edges.filter("seq % 101 = 0").withColumn("confidence", F.lit("EXTRACTED")), ["source_file"]).select("seq", "confidence")


@query("""WITH gone AS (SELECT DISTINCT source_file FROM nodes WHERE source_file LIKE '%3/%'), n AS (SELECT * FROM nodes WHERE source_file NOT IN (SELECT * FROM gone)),
          e AS (SELECT * FROM edges WHERE source_file NOT IN (SELECT * FROM gone) AND source IN (SELECT id FROM n) AND target IN (SELECT id FROM n))
          SELECT id FROM n WHERE source_file <> '' OR id IN (SELECT source FROM e UNION SELECT target FROM e)""", N, E)
def t4_prune_sources(spark, d):
    nodes, edges = view(spark, d, "nodes"), view(spark, d, "edges")
    gone = nodes.filter("source_file like '%3/%'").select("source_file").distinct()
    return incremental.prune_sources(nodes, edges, gone)[0].select("id")


@query("""WITH n AS (SELECT file_type AS repo, id, community FROM nodes), s AS (SELECT repo, sum(max(community) + 1) OVER (ORDER BY repo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS off FROM n GROUP BY repo)
          SELECT repo, id, CAST(community + coalesce(off, 0) AS BIGINT) AS community FROM n JOIN s USING (repo)""", N)
def t10_community_offsets(spark, d):
    return incremental.with_offsets(view(spark, d, "nodes").withColumn("repo", F.col("file_type")))


@query("""SELECT path, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS tag FROM (SELECT path, base, row_number() OVER (PARTITION BY base ORDER BY path) AS k FROM (SELECT 'r' || s_suppkey || '/' || 'repo' || (s_suppkey % 7) AS path, 'repo' || (s_suppkey % 7) AS base FROM supplier))""")
def a25_repo_tags(spark, d):
    key = F.col("s_suppkey")
    return incremental.repo_tags(table(spark, d, "supplier").select(F.concat(F.lit("r"), key.cast("string"), F.lit("/repo"), (key % 7).cast("string")).alias("path")))


@query("""WITH o AS (SELECT path, length(text) AS bytes, sha256(text) AS hash FROM files WHERE doc_id % 10 <> 1), n AS (SELECT path, length(t) AS bytes, sha256(t) AS hash FROM (SELECT path, CASE doc_id % 10 WHEN 2 THEN text || 'x' WHEN 4 THEN reverse(text) ELSE text END AS t, doc_id FROM files) WHERE doc_id % 10 <> 3)
          SELECT path, problem FROM (SELECT path, CASE WHEN n.hash IS NULL THEN 'missing' WHEN o.hash IS NULL THEN 'extra' WHEN o.bytes <> n.bytes THEN 'size' WHEN o.hash <> n.hash THEN 'content' END AS problem FROM o FULL JOIN n USING (path)) WHERE problem IS NOT NULL""", "files")
def m26_audit(spark, d):
    f = view(spark, d, "files")
    changed = F.when(F.col("doc_id") % 10 == 2, F.concat("text", F.lit("x"))).when(F.col("doc_id") % 10 == 4, F.reverse("text")).otherwise(F.col("text"))
    described = lambda x: x.select("path", F.length("t").cast("long").alias("bytes"), F.sha2(F.col("t").cast("binary"), 256).alias("hash"))
    return incremental.audit(described(f.filter("doc_id % 10 <> 1").withColumn("t", F.col("text"))), described(f.filter("doc_id % 10 <> 3").withColumn("t", changed)))


@query("""WITH m AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
          s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS "end", count(*) AS n, max(event_type) AS last_kind FROM s GROUP BY user_id, k""")
def t1_debounced_sessions(spark, d):
    return changes.sessions(table(spark, d, "events"))


@query("""SELECT seq, source, target, 'MERGE (a {id:''' || source || '''})-[:' || upper(relation) || ']->(b {id:''' || target || '''})' AS line FROM edges""", E)
def x5_cypher_lines(spark, d):
    line = F.format_string("MERGE (a {id:'%s'})-[:%s]->(b {id:'%s'})", "source", F.upper("relation"), "target")
    return view(spark, d, "edges").select("seq", "source", "target", line.alias("line"))


# --- entities -------------------------------------------------------------------------------------------------------

_TWINS = """SELECT * FROM (SELECT id, label, file_type, source_file, source_location, rationale, community FROM nodes
    UNION ALL SELECT id, label || ' copy', file_type, 'archive/' || source_file, NULL, 'from a copy', community FROM nodes WHERE file_type = 'code')"""


@query(f"""WITH t AS ({_TWINS}), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN starts_with(source_file, 'archive/') THEN 1 ELSE 0 END, length(label), label) AS k FROM t)
          SELECT id, label, source_file, rationale FROM r WHERE k = 1""", N)
def w1_id_survivors(spark, d):
    n = view(spark, d, "nodes")
    twins = n.filter("file_type = 'code'").withColumns({"label": F.concat("label", F.lit(" copy")), "source_file": F.concat(F.lit("archive/"), "source_file"), "source_location": F.lit(None).cast("string"), "rationale": F.lit("from a copy")})
    return entities.survivors(n.unionByName(twins), ["rationale", "source_location"]).select("id", "label", "source_file", "rationale")


_LABEL_NORM = "trim(regexp_replace(lower(label), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT *, {_LABEL_NORM} AS norm FROM nodes WHERE file_type <> 'code'),
          h AS (SELECT norm, -sum(c / t * log2(c / t)) AS bits FROM (SELECT norm, count(*)::DOUBLE AS c, (sum(count(*)) OVER (PARTITION BY norm))::DOUBLE AS t FROM (SELECT norm, unnest(string_split(norm, '')) AS ch FROM (SELECT DISTINCT norm FROM n)) GROUP BY norm, ch) GROUP BY norm)
          SELECT a, b FROM (SELECT min(id) OVER (PARTITION BY norm, source_file) AS a, id AS b FROM n WHERE source_file <> '' AND norm <> ''
            UNION SELECT min(id) OVER (PARTITION BY norm), id FROM n JOIN h USING (norm) WHERE file_type = 'concept' AND source_file <> '' AND bits >= 2.5) WHERE a <> b""", N)
def d3_exact_label_pairs(spark, d):
    return entities.exact_pairs(view(spark, d, "nodes"))


@query()
def d4_similar_label_pairs(spark, d):
    return entities.similar_pairs(view(spark, d, "nodes"))


@query()
def d4_merge_entities(spark, d):
    n = view(spark, d, "nodes")
    return entities.merged(n, entities.exact_pairs(n).unionByName(entities.similar_pairs(n).select("a", "b")))


@query("SELECT count(DISTINCT community) AS repos, count(DISTINCT community) > 1 AS refused FROM nodes", N)
def d1_single_repository(spark, d):
    return view(spark, d, "nodes").agg(F.countDistinct("community").alias("repos")).withColumn("refused", F.col("repos") > 1)


# --- clusters and centralities --------------------------------------------------------------------------------------


@query()
def g11_communities(spark, d):
    edges = view(spark, d, "edges")
    return cluster.communities(view(spark, d, "nodes"), edges.select(F.col("source").alias("lo"), F.col("target").alias("hi")))


def _supplier_pairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    li = table(spark, d, "lineitem").select((F.col("l_suppkey") % 100).cast("string").alias("a"), (F.col("l_partkey") % 100).cast("string").alias("b"), F.col("l_orderkey"))
    own = li.filter("l_orderkey % 37 = 0 and a <> b")
    pairs = own.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()
    return pairs.select(F.explode(F.array("lo", "hi")).alias("id")).distinct(), pairs


@query()
def g9_betweenness(spark, d):
    nodes, pairs = _supplier_pairs(spark, d)
    return cluster.betweenness(nodes, pairs)


@query(PAIRS + """, v AS (SELECT s AS id, community AS cid, count(*) AS n FROM (SELECT lo AS s, hi AS o FROM pairs UNION SELECT hi, lo FROM pairs) JOIN nodes ON id = o WHERE s LIKE 'nation%' AND o NOT LIKE 'nation%' GROUP BY 1, 2)
        SELECT id, cid FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, cid) AS k FROM v) WHERE k = 1""", N, E)
def g12_attach_by_vote(spark, d):
    nodes, _, pairs = graph(spark, d)
    hubs = nodes.filter("id like 'nation%'")
    rest = nodes.join(hubs.select("id"), "id", "left_anti").select("id", F.col("community").alias("cid"))
    return cluster.attach_by_vote(rest, pairs, hubs.select("id"))


# --- reports --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT source_file AS path, string_split(source_file, '/') AS s FROM nodes WHERE source_file <> '') SELECT array_to_string(s[1:k], '/') AS dir, CAST(k AS INT) AS depth, count(*) AS total FROM p, unnest(range(0, len(s))) AS u(k) GROUP BY 1, 2""", N)
def a17_directory_totals(spark, d):
    return report.directory_totals(view(spark, d, "nodes").filter("source_file <> ''").select(F.col("source_file").alias("path"))).select("dir", "depth", "total")


@query("SELECT s.file_type AS a, t.file_type AS b, count(*) AS n FROM edges e JOIN nodes s ON s.id = source JOIN nodes t ON t.id = target WHERE s.file_type <> t.file_type GROUP BY 1, 2", N, E)
def a18_section_edges(spark, d):
    return report.section_edges(view(spark, d, "edges"), view(spark, d, "nodes").select("id", F.col("file_type").alias("section")))


@query("SELECT regexp_extract(path, '(\\.[^./]+)$', 1) AS extension, count(*) AS n FROM files GROUP BY 1 ORDER BY n DESC, extension LIMIT 3", "files")
def a19_extensions(spark, d):
    return report.extension_histogram(view(spark, d, "files"))


_SCORE = "coalesce(confidence_score, 1.0) + CASE confidence WHEN 'EXTRACTED' THEN 2.0 ELSE 0.0 END + CASE WHEN relation IN ('calls', 'uses', 'method') THEN 1.0 WHEN relation IN ('imports', 'imports_from') THEN 0.6 WHEN relation = 'contains' THEN -0.2 ELSE 0.0 END"


@query(f"SELECT id, round(sum(s), 4) AS score FROM (SELECT source AS id, {_SCORE} AS s FROM edges UNION ALL SELECT target, {_SCORE} FROM edges) GROUP BY id", E)
def m21_node_scores(spark, d):
    return report.node_scores(view(spark, d, "edges")).select("id", F.round("score", 4).alias("score"))


@query(DEGREE + """, c AS (SELECT CASE WHEN source = 'supplier_1' THEN 'out' ELSE 'in' END AS direction, CASE WHEN source = 'supplier_1' THEN target ELSE source END AS id, source_file, seq FROM edges WHERE source = 'supplier_1' OR target = 'supplier_1'),
        r AS (SELECT c.*, row_number() OVER (ORDER BY degree DESC, id, seq) AS k FROM c JOIN degree USING (id))
        SELECT 'shown' AS part, direction, id, source_file AS file, CAST(1 AS BIGINT) AS n FROM r WHERE k <= 20 UNION ALL SELECT 'rest', direction, NULL, CASE source_file WHEN '' THEN '(unknown file)' ELSE source_file END, count(*) FROM r WHERE k > 20 GROUP BY 2, 4""", N, E)
def m12_explain(spark, d):
    nodes, _, pairs = graph(spark, d)
    return report.explain(view(spark, d, "edges"), analyze.degrees(nodes, pairs), "supplier_1")


_CHANGED = "SELECT o_orderkey % 9 AS pr, 'nation' || CAST(o_orderkey % 25 AS VARCHAR) || '/customer' || CAST(o_orderkey % 37 AS VARCHAR) || '.py' AS file FROM orders"
_IMPACT = f"""WITH ch AS (SELECT DISTINCT * FROM ({_CHANGED})), f AS (SELECT source_file, count(*) AS n, list(DISTINCT community) AS cs FROM nodes WHERE source_file <> '' GROUP BY 1),
    m AS (SELECT DISTINCT pr, source_file, n, cs FROM ch JOIN f ON file = source_file OR ends_with(source_file, '/' || file) OR ends_with(file, '/' || source_file)),
    i AS (SELECT pr, CAST(sum(n) AS BIGINT) AS n_nodes, array_to_string(list_sort(list_distinct(flatten(list(cs)))), ',') AS communities FROM m GROUP BY pr)"""


def _impact(spark, d):
    o = table(spark, d, "orders")
    file = F.concat(F.lit("nation"), (F.col("o_orderkey") % 25).cast("string"), F.lit("/customer"), (F.col("o_orderkey") % 37).cast("string"), F.lit(".py"))
    return report.pull_request_impact(o.select((F.col("o_orderkey") % 9).alias("pr"), file.alias("file")), view(spark, d, "nodes"))


@query(_IMPACT + " SELECT pr, n_nodes, communities FROM i", N)
def j18_pull_request_impact(spark, d):
    return _impact(spark, d)


@query(_IMPACT + " SELECT community, array_to_string(list_sort(list(pr)), ',') AS prs FROM (SELECT pr, unnest(string_split(communities, ',')) AS community FROM i) GROUP BY community HAVING count(*) > 1", N)
def m32_pull_request_conflicts(spark, d):
    return report.pull_request_conflicts(_impact(spark, d))


@query(PAIRS + _COMM + " SELECT least(cu, cv) AS a, greatest(cu, cv) AS b, count(*) AS n FROM cp WHERE cu <> cv GROUP BY 1, 2", N, E)
def x2_meta_graph(spark, d):
    nodes, _, pairs = graph(spark, d)
    return report.meta_graph(nodes, pairs)


@query(_SYM + """, f0 AS (SELECT 'supplier_1' AS id), f1 AS (SELECT DISTINCT dst AS id FROM adj WHERE src = 'supplier_1'), v AS (SELECT id FROM f0 UNION SELECT id FROM f1)
        SELECT CAST(floor(sum(length('NODE ' || label || ' src=' || coalesce(source_file, '') || ' loc=' || coalesce(source_location, '')) + 1) / 4) AS BIGINT) AS tokens, count(*) AS n_nodes FROM nodes WHERE id IN (SELECT id FROM v)""", N, E)
def a16_question_tokens(spark, d):
    nodes, _, pairs = graph(spark, d)
    seen = traverse.reach(traverse.symmetric(pairs), spark.createDataFrame([("supplier_1",)], "id string"), 1)
    return report.question_tokens(nodes, pairs, seen)


@query(_SYM + """, f0 AS (SELECT 'supplier_1' AS id, 0 AS distance), v AS (SELECT id, min(distance) AS distance FROM (SELECT * FROM f0 UNION ALL SELECT dst, 1 FROM adj WHERE src = 'supplier_1') GROUP BY id),
        dg AS (SELECT n.id, count(e.id) AS degree FROM nodes n LEFT JOIN (SELECT lo AS id FROM pairs UNION ALL SELECT hi FROM pairs) e ON e.id = n.id GROUP BY n.id)
        SELECT CAST(row_number() OVER (ORDER BY distance, degree DESC, id) AS INT) AS place, id, 'NODE ' || label || ' [src=' || coalesce(source_file, '') || ' loc=' || coalesce(source_location, '') || ' community=' || coalesce(CAST(community AS VARCHAR), '') || ']' AS line
        FROM v JOIN nodes USING (id) JOIN dg USING (id)""", N, E)
def q5_render(spark, d):
    nodes, _, pairs = graph(spark, d)
    seen = traverse.reach(traverse.symmetric(pairs), spark.createDataFrame([("supplier_1",)], "id string"), 1)
    return retrieve.render(nodes, seen, analyze.degrees(nodes, pairs))


# --- text units -----------------------------------------------------------------------------------------------------


@query()
def e10_slices(spark, d):
    return slicing.slice_documents(table(spark, d, "documents"), 2000)


@query("""WITH RECURSIVE u AS (SELECT source AS dir, doc_id AS unit, CAST(n_chars // 4 AS BIGINT) AS cost, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
          r AS (SELECT dir, unit, k, cost AS used, CAST(0 AS BIGINT) AS chunk FROM u WHERE k = 1 UNION ALL SELECT u.dir, u.unit, u.k, CASE WHEN r.used + u.cost > 4000 THEN u.cost ELSE r.used + u.cost END, CASE WHEN r.used + u.cost > 4000 THEN chunk + 1 ELSE chunk END FROM r JOIN u ON u.dir = r.dir AND u.k = r.k + 1)
          SELECT dir, unit, chunk FROM r""")
def e12_pack_by_directory(spark, d):
    return slicing.pack_by_directory(table(spark, d, "documents").select(F.col("source").alias("dir"), F.col("doc_id").alias("unit"), F.floor(F.col("n_chars") / 4).alias("cost")), 4000)


@query("""SELECT doc_id, 'code' AS kind, unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '`([^`\\n]+)`', 1)) AS value FROM documents
          UNION ALL SELECT doc_id, 'heading', unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '(?m)^#{1,6}\\s+(.+?)\\s*$', 1)) FROM documents
          UNION ALL SELECT doc_id, 'link', unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '\\[[^\\]]*\\]\\(([^)\\s]+)', 1)) FROM documents
          UNION ALL SELECT doc_id, 'wiki', unnest(regexp_extract_all(regexp_replace(text, '(?s)```.*?```', '', 'g'), '\\[\\[([^\\]|#]+)', 1)) FROM documents""")
def e4_markdown(spark, d):
    return files.markdown(table(spark, d, "documents"))


@query("SELECT seq, source || '>' || target AS key, CASE confidence WHEN 'EXTRACTED' THEN 1.0 WHEN 'INFERRED' THEN 0.55 ELSE 0.2 END::DOUBLE AS score FROM edges WHERE confidence_score IS NULL", E)
def x1_default_scores(spark, d):
    e = view(spark, d, "edges").filter("confidence_score is null")
    return e.select("seq", F.concat("source", F.lit(">"), "target").alias("key"), F.when(F.col("confidence") == "EXTRACTED", 1.0).when(F.col("confidence") == "INFERRED", 0.55).otherwise(0.2).alias("score"))


@query("""SELECT user_id, CAST(ts AS DATE) + CAST(event_id % 60 AS INT) AS due, CAST(DATE '2024-02-01' - (CAST(ts AS DATE) + CAST(event_id % 60 AS INT)) AS INT) AS overdue, event_id FROM events WHERE CAST(ts AS DATE) + CAST(event_id % 60 AS INT) < DATE '2024-02-01'""")
def m27_stale_notes(spark, d):
    due = F.date_add(F.col("ts").cast("date"), (F.col("event_id") % 60).cast("int"))
    return table(spark, d, "events").select("user_id", due.alias("due"), F.datediff(F.lit("2024-02-01").cast("date"), due).alias("overdue"), "event_id").filter("overdue > 0")


@query("SELECT event_type, round(avg(value), 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS stderr FROM events GROUP BY 1")
def a23_mean_saving(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value") / F.sqrt(F.count("value")), 6).alias("stderr"))


@query("""SELECT 'a' AS repo, id FROM nodes WHERE community < 5 UNION SELECT 'b', id FROM nodes WHERE community > 3 AND community < 8""", N)
def k5_union_of_fragments(spark, d):
    n = view(spark, d, "nodes")
    a, b = n.filter("community < 5").select(F.lit("a").alias("repo"), "id"), n.filter("community > 3 and community < 8").select(F.lit("b").alias("repo"), "id")
    return a.unionByName(b, allowMissingColumns=True)


# --- resolution -----------------------------------------------------------------------------------------------------

_RAW = "SELECT 'customer_' || CAST(o_custkey AS STRING) AS source, 'part_name_' || CAST(o_orderkey % 60 AS STRING) AS callee, 'src/nation' || CAST(o_custkey % 25 AS STRING) || '/a' || CAST(o_custkey % 3 AS STRING) || '/m.py' AS source_file FROM {orders}"
_DEFS = """SELECT 'part_' || CAST(p_partkey AS STRING) AS id, 'part_name_' || CAST(p_partkey % 90 AS STRING) || '()' AS label,
    CASE WHEN p_partkey % 4 = 0 THEN 'tests/' ELSE 'src/' END || 'nation' || CAST(p_partkey % 25 AS STRING) || '/a' || CAST(p_partkey % 3 AS STRING) || '/p' || CAST(p_partkey AS STRING) || '.py' AS source_file FROM {part} WHERE p_partkey <= 200"""


@query(f"""WITH raw AS (SELECT DISTINCT * FROM ({_RAW.replace("{orders}", "orders")})), defs AS ({_DEFS.replace("{part}", "part")}),
          f AS (SELECT raw.source, callee, raw.source_file, d.id AS target, string_split(raw.source_file, '/')[1:-2] AS sd, string_split(d.source_file, '/')[1:-2] AS td, starts_with(d.source_file, 'tests/') AS t, count(*) OVER (PARTITION BY raw.source, callee, raw.source_file) AS n
                FROM raw JOIN defs d ON callee || '()' = d.label),
          l AS (SELECT *, count(*) OVER w AS m, CASE WHEN sd[1] <> td[1] THEN 0 WHEN sd[2] <> td[2] THEN 1 WHEN sd[3] <> td[3] THEN 2 ELSE 3 END AS near FROM f WHERE n = 1 OR NOT t WINDOW w AS (PARTITION BY source, callee, source_file)),
          b AS (SELECT *, max(near) OVER (PARTITION BY source, callee, source_file) AS top FROM l), r AS (SELECT * FROM b WHERE m = 1 OR (near = top AND top > 0)),
          s AS (SELECT source, callee, source_file, min(target) AS target FROM r GROUP BY 1, 2, 3 HAVING count(*) = 1)
          SELECT source, target, min(source_file) AS source_file FROM s WHERE source <> target GROUP BY 1, 2""")
def j8_cross_file_calls(spark, d):
    raw, defs = spark.sql(_RAW, orders=table(spark, d, "orders")), spark.sql(_DEFS, part=table(spark, d, "part"))
    return resolve.calls(raw, defs, spark.createDataFrame([], "source string, target string"))


@query("""WITH t AS (SELECT id, file_type, source_file FROM nodes WHERE file_type = 'document' UNION ALL SELECT id || '_doc', file_type, CASE WHEN id LIKE '%1' THEN 'other.md' ELSE source_file END FROM nodes WHERE file_type = 'document')
          SELECT a.id AS old, b.id AS new FROM t a JOIN t b ON b.id = a.id || '_doc' AND a.source_file = b.source_file""", N)
def j5_document_twins(spark, d):
    docs = view(spark, d, "nodes").filter("file_type = 'document'").select("id", "file_type", "source_file")
    twins = docs.select(F.concat("id", F.lit("_doc")).alias("id"), "file_type", F.when(F.col("id").endswith("1"), "other.md").otherwise(F.col("source_file")).alias("source_file"))
    return resolve.document_twins(docs.unionByName(twins))


@query("""WITH t AS (SELECT id, label, source_file, source_location FROM nodes WHERE file_type = 'code' UNION ALL SELECT 'ghost_' || id, CASE WHEN id LIKE '%7' THEN 'none' ELSE label END, source_file, NULL FROM nodes WHERE file_type = 'code'),
          a AS (SELECT source_file, label, min(id) AS new FROM t WHERE source_location IS NOT NULL GROUP BY 1, 2 HAVING count(*) = 1) SELECT t.id AS old, new FROM t JOIN a USING (source_file, label) WHERE t.source_location IS NULL""", N)
def j6_ghost_merge(spark, d):
    code = view(spark, d, "nodes").filter("file_type = 'code'").select("id", "label", "source_file", "source_location")
    ghost = code.select(F.concat(F.lit("ghost_"), "id").alias("id"), F.when(F.col("id").endswith("7"), "none").otherwise(F.col("label")).alias("label"), "source_file", F.lit(None).cast("string").alias("source_location"))
    return resolve.ghosts(code.unionByName(ghost), F.col("source_location").isNotNull())


@query("""SELECT id AS old, new FROM (SELECT id, first_value(id) OVER (PARTITION BY label ORDER BY coalesce(source_file, ''), coalesce(source_location, ''), id) AS new FROM (SELECT id, regexp_replace(label, '[0-9]$', '') AS label, source_file, source_location FROM nodes)) WHERE id <> new""", N)
def m16_canonical_groups(spark, d):
    return resolve.canonical_groups(view(spark, d, "nodes").withColumn("label", F.regexp_replace("label", "[0-9]$", "")))


@query("""WITH n AS (SELECT doc_id, 'id_' || doc_id AS id, CASE doc_id % 3 WHEN 0 THEN split_part(text, ' ', 1) || '()' ELSE 'neverthere' || doc_id || '(x)' END AS label, path FROM files JOIN documents USING (doc_id, text)),
          w AS (SELECT doc_id, id, path, [x FOR x IN regexp_extract_all(lower(split_part(label, '(', 1) || ' ' || id), '[a-z_][a-z0-9_]*') IF length(x) >= 3] AS ws FROM n)
          SELECT w.id FROM w JOIN files f USING (path) WHERE len(ws) > 0 AND len([x FOR x IN ws IF contains(lower(f.text), x)]) = 0""", "files")
def e14_unverified(spark, d):
    f = view(spark, d, "files")
    first = F.split("text", " ")[0]
    label = F.when(F.col("doc_id") % 3 == 0, F.concat(first, F.lit("()"))).otherwise(F.concat(F.lit("neverthere"), F.col("doc_id").cast("string"), F.lit("(x)")))
    nodes = f.select(F.concat(F.lit("id_"), F.col("doc_id").cast("string")).alias("id"), label.alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"))
    return resolve.unverified(nodes, f.select(F.col("path").alias("source_file"), "text"))


@query("SELECT event_id, round(CASE event_type WHEN 'click' THEN (event_id * 3.0 + user_id * 15.0) / 1e6 WHEN 'view' THEN (event_id * 0.5 + user_id * 2.0) / 1e6 ELSE 0 END, 9) AS cost FROM events")
def e16_cost(spark, d):
    usage = table(spark, d, "events").select("event_id", F.col("event_type").alias("model"), F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"))
    return resolve.cost(usage, {"click": (3.0, 15.0), "view": (0.5, 2.0)}).select("event_id", F.round("cost", 9).alias("cost"))


@query("SELECT doc_id, sha256(substr(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'), 1, 256)) AS label FROM documents")
def e17_sanitise_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(text.sanitize_label(F.col("text")).cast("binary"), 256).alias("label"))


@query("""WITH w AS (SELECT id, label, source_file, CASE WHEN community < 12 THEN 'a' ELSE 'b' END AS repo FROM nodes), f AS (SELECT 'b::' || id AS id, label, source_file FROM nodes WHERE community % 2 = 0),
          x AS (SELECT label, min(id) AS new FROM w WHERE repo <> 'b' AND source_file = '' AND label <> '' GROUP BY label), m AS (SELECT f.id AS old, new FROM f JOIN x USING (label) WHERE f.source_file = '')
          SELECT repo, id FROM w WHERE repo <> 'b' UNION ALL SELECT 'b', id FROM f WHERE id NOT IN (SELECT old FROM m)""", N)
def t9_add_repository(spark, d):
    n = view(spark, d, "nodes")
    whole = n.select("id", "label", "source_file", F.when(F.col("community") < 12, "a").otherwise("b").alias("repo"))
    fresh = n.filter("community % 2 = 0").select(F.concat(F.lit("b::"), "id").alias("id"), "label", "source_file")
    return resolve.add_repository(whole, fresh, "b")[0].select("repo", "id")


@query("""SELECT count(DISTINCT source_file) AS files, count(DISTINCT source_file) > 1 AS ambiguous FROM nodes WHERE starts_with(lower(label), 'customer#00000000')""", N)
def g6_ambiguous_lookup(spark, d):
    return retrieve.ambiguous(view(spark, d, "nodes"), "Customer#00000000")


@query(f"SELECT unnest({sorted(set(_TERMS))!r}) AS term".replace("\"", "'"))
def p5_query_terms(spark, d):
    return spark.createDataFrame([(t,) for t in sorted(set(_TERMS))], "term string")


@query()
def w10_seeds(spark, d):
    nodes, _, pairs = graph(spark, d)
    best = retrieve.seeds_by_term(nodes, analyze.degrees(nodes, pairs), _TERMS)
    return spark.createDataFrame([(i, s) for i, s in enumerate(retrieve.pick_seeds(retrieve.scores(nodes, _TERMS, 50), nodes, best, _TERMS))], "place int, id string")


@query()
def m20_community_samples(spark, d):
    nodes, _, pairs = graph(spark, d)
    return report.community_samples(nodes, analyze.god_nodes(nodes, pairs, 50))


@query("SELECT repo, id, label FROM (SELECT repo, id, label, row_number() OVER (PARTITION BY id ORDER BY repo) AS k FROM (SELECT 0 AS repo, id, label FROM nodes WHERE community < 15 UNION ALL SELECT 1, id, label || '!' FROM nodes WHERE community > 9)) WHERE k = 1", N)
def m11_cached_first(spark, d):
    n = view(spark, d, "nodes").select("id", "label", "community")
    both = n.filter("community < 15").withColumn("repo", F.lit(0)).unionByName(n.filter("community > 9").withColumns({"repo": F.lit(1), "label": F.concat("label", F.lit("!"))}))
    return build.last_nodes(both.withColumn("seq", -F.col("repo"))).select("repo", "id", "label")


@query("""WITH m AS (SELECT l_orderkey AS hid, array_to_string(list_distinct(list(l_partkey ORDER BY l_linenumber, l_partkey)), ',') AS x, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) SELECT hid, n FROM m""")
def m7_distinct_members(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hid")).agg(F.size(F.array_distinct(F.collect_list("l_partkey"))).cast("long").alias("n"))


# --- caches and scopes ----------------------------------------------------------------------------------------------


@query("SELECT seq FROM edges WHERE source_file IN (SELECT source_file FROM edges WHERE seq % 7 = 0)", E)
def m23_scope_guard(spark, d):
    e = view(spark, d, "edges").select("seq", "source_file")
    return incremental.in_scope(e, e.filter("seq % 7 = 0")).select("seq")


_HASHED = "SELECT path, sha256(text) AS hash, doc_id FROM files"


@query(f"WITH f AS ({_HASHED}), c AS (SELECT DISTINCT hash FROM f WHERE doc_id % 3 = 0) SELECT path, hash IN (SELECT hash FROM c) AS hit FROM f", "files")
def m24_cache_split(spark, d):
    f = view(spark, d, "files").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    hit, miss = incremental.cache_split(f.select("path", "hash"), f.filter("doc_id % 3 = 0").select("hash").distinct())
    return hit.select("path", F.lit(True).alias("hit")).unionByName(miss.select("path", F.lit(False).alias("hit")))


@query(f"WITH f AS ({_HASHED}) SELECT path FROM f WHERE hash IN (SELECT hash FROM f WHERE doc_id % 4 = 1)", "files")
def m25_live_cache(spark, d):
    f = view(spark, d, "files").select("path", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "doc_id")
    return incremental.live_cache(f, f.filter("doc_id % 4 = 1")).select("path")


@query("SELECT seq FROM edges WHERE source IN (SELECT id FROM nodes WHERE community <> 3) AND target IN (SELECT id FROM nodes WHERE community <> 3)", N, E)
def k9_without_repository(spark, d):
    n = view(spark, d, "nodes").withColumn("repo", F.col("community").cast("string"))
    return incremental.without_repository(n, view(spark, d, "edges"), "3")[1].select("seq")


@query("""WITH m AS (SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) AS package, 'customer_' || CAST(c_custkey AS VARCHAR) AS file FROM customer WHERE c_custkey <= 100)
          SELECT DISTINCT source, file AS target, relation FROM edges JOIN m ON target = package WHERE source LIKE 'supplier%'""", E)
def m15_package_fan_out(spark, d):
    key = lambda c: F.col(c).cast("string")
    m = table(spark, d, "customer").filter("c_custkey <= 100").select(F.concat(F.lit("nation_"), key("c_nationkey")).alias("package"), F.concat(F.lit("customer_"), key("c_custkey")).alias("file"))
    return incremental.fan_out_packages(view(spark, d, "edges").filter("source like 'supplier%'"), m)


@query("""SELECT seq FROM edges WHERE relation NOT IN ('imports', 'imports_from', 're_exports') OR target NOT IN (SELECT 'nation_' || CAST(c_nationkey AS VARCHAR) FROM customer GROUP BY c_nationkey HAVING count(DISTINCT c_custkey) > 1)""", E)
def m13_ambiguous_imports(spark, d):
    m = table(spark, d, "customer").select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("module"), F.col("c_custkey").alias("file"))
    return incremental.unambiguous_imports(view(spark, d, "edges").select("seq", "target", "relation"), m).select("seq")


@query("SELECT s AS source, count(*) AS facts, count(DISTINCT p) AS properties FROM quads GROUP BY s", "quads")
def a26_volume(spark, d):
    return view(spark, d, "quads").groupBy(F.col("s").alias("source")).agg(F.count("*").alias("facts"), F.countDistinct("p").alias("properties"))
