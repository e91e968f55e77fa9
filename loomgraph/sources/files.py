"""Readers of files: corpora, stored graphs, symbol indexes, manifests, notes, SQL and Markdown.

Everything reads through Spark's own sources, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text

# Directories that hold no sources, and signs of files with secrets.
NOISE_DIRS = ["node_modules", "__pycache__", ".git", "venv", ".venv", "dist", "build", "target", ".mypy_cache", ".pytest_cache", "coverage", "htmlcov", ".tox", "site-packages"]
SENSITIVE = r"(?i)(^|/)(\.env(\..*)?|.*\.(pem|key|p12|pfx|jks)|id_(rsa|dsa|ecdsa|ed25519)(\.pub)?|\.netrc|\.pgpass|.*credentials?\.(json|ya?ml|ini)|secrets?\.(json|ya?ml|toml))$"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, modified, category, words, hash) of the files below a folder, without noise and sensitive files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    path = F.regexp_replace(F.substring("path", F.locate(root.rstrip("/"), F.col("path")) + len(root.rstrip("/")) + 1, 1 << 20), "^/+", "")
    own = raw.select(path.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "content")
    body = F.decode("content", "UTF-8")
    kept = own.filter(~noise(F.col("path")) & ~F.col("path").rlike(SENSITIVE))
    return kept.select("path", "bytes", "modified", text.category(F.col("path")).alias("category"), text.word_count(body).alias("words"), F.sha2("content", 256).alias("hash"))


def noise(path: Column) -> Column:
    """Whether a path has a directory that holds no sources."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(d) for d in NOISE_DIRS]))


def ignored(paths: DataFrame, rules: list[str]) -> DataFrame:
    """(path, ignored) under ignore rules in order: the last that matches decides, ``!`` negates, a leading ``/`` anchors."""
    verdict = F.lit(False)
    for rule in rules:
        negate, body = rule.startswith("!"), rule.lstrip("!")
        folder, anchored = body.endswith("/"), "/" in body.strip("/") or body.startswith("/")
        parts = body.strip("/").split("**")
        pattern = ".*".join("[^/]*".join("[^/]".join(_literal(q) for q in p.split("?")) for p in s.split("*")) for s in parts).replace("/.*/", "/(?:.*/)?")
        hit = F.col("path").rlike(f"^{'' if anchored else '(?:.*/)?'}{pattern}{'/' if folder else '(?:/|$)'}")
        verdict = F.when(hit, F.lit(not negate)).otherwise(verdict)
    return paths.select("path", verdict.alias("ignored"))


def _literal(s: str) -> str:
    return "".join("\\" + c if c in "\\.^$|()[]{}+" else c for c in s)


def graph_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a node-link document; edges may be called links."""
    doc = spark.read.option("multiLine", True).json(path)
    links = "links" if "links" in doc.columns else "edges"
    return doc.select(F.inline("nodes")), doc.select(F.inline(links))


def symbols(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a symbol index: (documents of path, symbols(symbol, kind, relationships), occurrences(symbol, line)).

    Relationships whose target several documents define are left out.
    """
    each = documents.select("path", F.explode("symbols").alias("s")).select("path", "s.symbol", "s.kind", "s.relationships")
    nodes = each.select(F.col("symbol").alias("id"), F.regexp_extract("symbol", r"([^/#.`]+)[#.`()]*$", 1).alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"))
    one = nodes.groupBy("id").agg(F.count("*").alias("n")).filter("n = 1").select(F.col("id").alias("target"))
    rel = each.select("path", F.col("symbol").alias("source"), F.explode("relationships").alias("r")).select("source", F.col("r.symbol").alias("target"), F.when(F.col("r.is_implementation"), "implements").otherwise("references").alias("relation"), F.col("path").alias("source_file"))
    return nodes, rel.join(one, "target", "left_semi")


def manifest_packages(files: DataFrame) -> DataFrame:
    """(package, depends_on) of package manifests (path, text): project files, crates, modules."""
    t = F.col("text")
    name = F.when(F.col("path").endswith("go.mod"), F.regexp_extract(t, r"(?m)^module\s+(\S+)", 1)).otherwise(F.regexp_extract(t, r"(?m)^name\s*=\s*[\"']([^\"']+)[\"']", 1))
    listed = F.regexp_extract_all(F.regexp_extract(t, r"(?s)dependencies\s*=\s*\[(.*?)\]", 1), F.lit(r"[\"']([A-Za-z0-9_.-]+)"), F.lit(1))
    table = F.regexp_extract_all(F.regexp_extract(t, r"(?s)\[dependencies\](.*?)(?:\n\[|$)", 1), F.lit(r"(?m)^([A-Za-z0-9_-]+)\s*="), F.lit(1))
    required = F.regexp_extract_all(t, F.lit(r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+v"), F.lit(1))
    deps = F.when(F.col("path").endswith("go.mod"), required).when(F.col("path").endswith("Cargo.toml"), table).otherwise(listed)
    return files.select(name.alias("package"), F.explode(F.array_distinct(deps)).alias("depends_on")).filter("package <> ''")


def tool_servers(configs: DataFrame) -> DataFrame:
    """(server, command, package, variable) of tool-server configurations (text)."""
    shape = "struct<mcpServers: map<string, struct<command: string, args: array<string>, env: map<string, string>>>>"
    servers = configs.select(F.explode(F.from_json("text", shape)["mcpServers"]).alias("server", "s"))
    package = F.filter(F.coalesce("s.args", F.array().cast("array<string>")), lambda a: ~a.startswith("-"))
    return servers.select("server", "s.command", F.try_element_at(package, F.lit(1)).alias("package"), F.explode_outer(F.map_keys("s.env")).alias("variable"))


def notes(files: DataFrame) -> DataFrame:
    """(path, question, date, outcome, source_nodes, correction) from the front matter of notes (path, text)."""
    head = F.regexp_extract("text", r"(?s)^---\n(.*?)\n---", 1)
    field = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{k}:\s*(.*)$", 1), r"^[\"']|[\"']$", "")), F.lit(""))
    nodes = F.regexp_extract_all(F.regexp_extract(head, r"(?m)^source_nodes:\s*\[(.*)\]$", 1), F.lit(r"[\"']?([^\"',\[\]]+?)[\"']?\s*(?:,|$)"), F.lit(1))
    return files.select("path", field("question").alias("question"), field("date").alias("date"), field("outcome").alias("outcome"), nodes.alias("source_nodes"), field("correction").alias("correction"))


def sql_lineage(files: DataFrame) -> DataFrame:
    """(path, object, kind, relation, target) of SQL files (path, text): tables, views, functions; references, reads_from.

    Comments and strings are blanked first; a statement ends at a semicolon.
    """
    masked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " "), r"'(?:[^']|'')*'", "''")
    statements = files.select("path", F.explode(F.split(masked, ";")).alias("s"))
    head = r"(?is)^\s*create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+)?(?:materialized\s+)?(table|view|function|trigger|index)\s+(?:if\s+not\s+exists\s+)?([\w.\"`\[\]]+)"
    clean = lambda c: F.lower(F.regexp_replace(c, r"[\"`\[\]]", ""))
    own = statements.select("path", "s", F.lower(F.regexp_extract("s", head, 1)).alias("kind"), clean(F.regexp_extract("s", head, 2)).alias("object")).filter("object <> ''")
    found = lambda p: F.transform(F.regexp_extract_all("s", F.lit(p), F.lit(1)), clean)
    refs = own.select("path", "object", "kind", F.lit("references").alias("relation"), F.explode(F.array_distinct(found(r"(?is)\breferences\s+([\w.\"`\[\]]+)"))).alias("target"))
    reads = own.filter("kind <> 'table'").select("path", "object", "kind", F.lit("reads_from").alias("relation"), F.explode(F.array_distinct(found(r"(?is)\b(?:from|join)\s+([\w.\"`\[\]]+)"))).alias("target"))
    return refs.unionByName(reads).filter("target <> object")


def markdown(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, kind, value): headings, links, wiki links and code spans, code fences left out."""
    body = F.regexp_replace(F.col(text_col), r"(?s)```.*?```", "")
    kinds = {"heading": (r"(?m)^#{1,6}\s+(.+?)\s*$", 1), "link": (r"\[[^\]]*\]\(([^)\s]+)", 1), "wiki": (r"\[\[([^\]|#]+)", 1), "code": (r"`([^`\n]+)`", 1)}
    out = None
    for kind, (pattern, group) in kinds.items():
        rows = docs.select(F.col(id_col), F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(body, F.lit(pattern), F.lit(group))).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out
