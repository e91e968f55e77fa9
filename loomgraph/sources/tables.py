"""The graph's tables as projections of relational tables.

Each projection is one SQL text that Spark and any other engine with the same tables can run. ``views`` gives them as
DataFrames. Kinds of nodes: customers (code), suppliers (code of another language), parts (concepts, some
without a source), nations (documents), regions (papers).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NODES = """
    SELECT 'customer_' || CAST(c_custkey AS STRING) AS id, c_name AS label, 'code' AS file_type,
           'src/nation' || CAST(c_nationkey AS STRING) || '/customer' || CAST(c_custkey % 37 AS STRING) || '.py' AS source_file,
           'L' || CAST(c_custkey % 500 AS STRING) AS source_location, 'segment ' || lower(c_mktsegment) AS rationale, CAST(c_nationkey AS INT) AS community
    FROM customer
    UNION ALL SELECT 'supplier_' || CAST(s_suppkey AS STRING), s_name || '()', 'code',
           'lib/nation' || CAST(s_nationkey AS STRING) || '/supplier' || CAST(s_suppkey % 11 AS STRING) || '.ts',
           'L' || CAST(s_suppkey AS STRING), CAST(NULL AS STRING), CAST(s_nationkey AS INT) FROM supplier
    UNION ALL SELECT 'part_' || CAST(p_partkey AS STRING), p_name, 'concept',
           CASE WHEN p_size % 7 = 0 THEN '' ELSE 'docs/' || p_brand || '/part' || CAST(p_size AS STRING) || '.md' END,
           CAST(NULL AS STRING), p_type, CAST(p_size % 25 AS INT) FROM part
    UNION ALL SELECT 'nation_' || CAST(n_nationkey AS STRING), n_name, 'document', 'docs/nations.md', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(n_nationkey AS INT) FROM nation
    UNION ALL SELECT 'region_' || CAST(r_regionkey AS STRING), r_name, 'paper', 'papers/regions.pdf', CAST(NULL AS STRING), CAST(NULL AS STRING), CAST(r_regionkey AS INT) FROM region"""

EDGES = """
    SELECT 'part_' || CAST(l_partkey AS STRING) AS source, 'supplier_' || CAST(l_suppkey AS STRING) AS target,
           CASE l_linenumber % 4 WHEN 0 THEN 'calls' WHEN 1 THEN 'references' WHEN 2 THEN 'uses' ELSE 'semantically_similar_to' END AS relation,
           CASE l_returnflag WHEN 'N' THEN 'EXTRACTED' WHEN 'A' THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence,
           1 - l_discount AS confidence_score, l_quantity AS weight, CASE l_linestatus WHEN 'O' THEN 'call' ELSE 'import' END AS context,
           'src/order' || CAST(l_orderkey % 97 AS STRING) || '.py' AS source_file, 'L' || CAST(l_linenumber AS STRING) AS source_location,
           l_orderkey * 10 + l_linenumber AS seq
    FROM lineitem
    UNION ALL SELECT 'customer_' || CAST(o_custkey AS STRING), 'part_' || CAST(o_orderkey % 2500 AS STRING), 'references',
           CASE o_orderstatus WHEN 'F' THEN 'EXTRACTED' WHEN 'O' THEN 'INFERRED' ELSE 'AMBIGUOUS' END,
           CAST(NULL AS DOUBLE), o_totalprice - 100000, 'field', '', CAST(NULL AS STRING), -o_orderkey FROM orders
    UNION ALL SELECT 'customer_' || CAST(c_custkey AS STRING), 'nation_' || CAST(c_nationkey AS STRING), 'imports_from', 'EXTRACTED',
           CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), 'import', 'src/main.py', 'L1', -1000000000 - c_custkey FROM customer
    UNION ALL SELECT 'supplier_' || CAST(s_suppkey AS STRING), 'nation_' || CAST(s_nationkey AS STRING), 'imports_from', 'EXTRACTED',
           CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), 'import', 'lib/main.ts', 'L1', -2000000000 - s_suppkey FROM supplier
    UNION ALL SELECT 'nation_' || CAST(n_nationkey AS STRING), 'region_' || CAST(n_regionkey AS STRING), 'contains', 'EXTRACTED',
           CAST(1 AS DOUBLE), CAST(1 AS DOUBLE), CAST(NULL AS STRING), 'docs/nations.md', CAST(NULL AS STRING), -3000000000 - n_nationkey FROM nation"""

MEMORY = """
    SELECT event_id AS doc_id, ts, 'question ' || CAST(event_id % 400 AS STRING) AS question,
           CASE event_type WHEN 'purchase' THEN 'useful' WHEN 'error' THEN 'dead_end' WHEN 'signup' THEN 'corrected' ELSE NULL END AS outcome,
           'customer_' || CAST(user_id AS STRING) AS node, 'correction ' || CAST(event_id AS STRING) AS correction
    FROM events"""

QUADS = """
    SELECT 'raw:orders' AS g, 'customer_' || CAST(o_custkey AS STRING) AS s, 'priority' AS p, o_orderpriority AS o FROM orders WHERE o_orderkey % 2 = 0
    UNION ALL SELECT 'wiki:orders', 'customer_' || CAST(o_custkey AS STRING), 'priority', o_orderpriority FROM orders WHERE o_orderkey % 2 = 1
    UNION ALL SELECT 'raw:customers', 'customer_' || CAST(c_custkey AS STRING), 'segment', c_mktsegment FROM customer
    UNION ALL SELECT 'wiki:customers', 'customer_' || CAST(c_custkey AS STRING), 'segment', CASE WHEN c_custkey % 3 = 0 THEN 'OTHER' ELSE c_mktsegment END FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT 'raw:archive', 'customer_' || CAST(c_custkey AS STRING), 'segment', CASE WHEN c_custkey % 5 = 0 THEN 'OLD' ELSE c_mktsegment END FROM customer WHERE c_custkey % 4 = 0"""

GRAPHS = """
    SELECT 'raw:orders' AS g, 'orders' AS source, 'raw' AS layer, '2024-01-01' AS date, '1' AS version_key, CAST(NULL AS STRING) AS override_of
    UNION ALL SELECT 'wiki:orders', 'orders_note', 'wiki', '2024-02-01', '1', 'orders'
    UNION ALL SELECT 'raw:customers', 'customers', 'raw', '2024-01-01', '2', NULL
    UNION ALL SELECT 'wiki:customers', 'customers_note', 'wiki', '2024-03-01', '1', NULL
    UNION ALL SELECT 'raw:archive', 'archive', 'raw', '2023-01-01', '1', NULL"""

FILES = """
    SELECT doc_id, source || '/' || lang || '/' || CASE WHEN doc_id % 9 = 0 THEN 'tests/' ELSE '' END || 'doc' || CAST(doc_id AS STRING) ||
           CASE doc_id % 6 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.pdf' WHEN 3 THEN '.png' WHEN 4 THEN '.json' ELSE '' END AS path, source AS dir, text
    FROM documents"""

PROJECTIONS = {"nodes": NODES, "edges": EDGES, "memory": MEMORY, "quads": QUADS, "graphs": GRAPHS, "files": FILES}
_USED = {
    "nodes": ["customer", "supplier", "part", "nation", "region"],
    "edges": ["lineitem", "orders", "customer", "supplier", "nation"],
    "memory": ["events"],
    "quads": ["orders", "customer"],
    "graphs": [],
    "files": ["documents"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A relational table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A projection by name, without registering anything in the session."""
    text = PROJECTIONS[name]
    used = _USED[name]
    for t in used:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used}) if used else spark.sql(text)


def with_views(body: str, *names: str) -> str:
    """SQL with projections as common table expressions before ``body``."""
    ctes = ", ".join(f"{n} AS ({PROJECTIONS[n]})" for n in names)
    return f"WITH {ctes}{', ' if body.lstrip()[:1] == ',' or body.lstrip().upper().startswith('WITH ') else ' '}" + (body.lstrip()[5:] if body.lstrip().upper().startswith("WITH ") else body)
