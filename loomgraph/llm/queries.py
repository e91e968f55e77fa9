"""The thin queries over whole tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import ann, bpe, chains, exact_dedup, langid, ngram_join, packing, rans, secrets_scan, urlfilter, worker
from loomgraph.plans import scratch

#: Which rules every ``pages`` URL is judged by.
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    worker.small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.place(spark, "rans")
    rans.write(rans.tokenise(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), "words", 1), path)
    return rans.read(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chains.passages(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_rans_token_files, op2_url_filter, op3_byte_bpe, op4_nearest_neighbours, op5_best_fit_packing, op6_ngram_jaccard_join, op7_language_id, op8_secret_scan, op9_substring_dedup, op10_exact_dedup)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL: dict[str, str] = {
    "op2_url_filter": f"""
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
        split AS (
            SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
                   regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
        rules(h, p, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for v, h, p in URL_RULES)}),
        fits AS (
            SELECT page_id, h || p AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS k
            FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
        SELECT s.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
        FROM split s LEFT JOIN fits f ON f.page_id = s.page_id AND k = 1""",
    "op6_ngram_jaccard_join": f"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (
            SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)])
                                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
        g AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
        pairs AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
            FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT x, y FROM pairs WHERE 100 * c >= 75 * (na + nb - c)),
        both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
        reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON b.x = r.y)
        SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(r.y) AS component_id FROM s JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, s.s""",
    "op10_exact_dedup": f"""
        WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS x FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(x) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY x)""",
}
