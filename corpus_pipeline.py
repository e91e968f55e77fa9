"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import exact_dedup, langid, ngram_join, packing, queries, secrets_scan, worker
from loomgraph.plans import scratch


#: A text whose best language has a smaller share is in none of them.
LEAST_SHARE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in none of the learned languages go; a null ``lang`` is filled with the prediction.

    Null, empty and letterless texts go; repeated rows are judged alike; an empty table stays empty.
    """
    worker.small_batches(spark)
    return langid.keep_languages(docs, least_score=LEAST_SHARE)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal documents the one with the largest id stays.

    A null text counts as empty, a null id as the smallest; of rows that repeat id and text one stays; an empty table stays empty.
    """
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similar five-word shingles the one with the smallest id stays.

    Texts without words stay; of rows that repeat the smallest id of a group the one with the least set stays, a null id
    goes if another row of its group has one; an empty table stays empty.
    """
    return ngram_join.drop_similar(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; all documents stay. A null text stays null."""
    return secrets_scan.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of 1024 tokens; a null text is one piece of the end id."""
    return packing.pack_documents(docs, queries.tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("exact_dedup", copies),
    ("ngram_jaccard_join", near_copies),
    ("secret_scan", secrets),
    ("best_fit_packing", packed),
]

#: Language identification and packing are beyond SQL; the tests hold this against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written and read again.

    A stage's intermediate tables, and the result that it read, are deleted when its own result is written.
    """
    docs, read_from = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs, path = scratch.settled(spark, partial(stage, spark, docs, sf_dir), name)
        if read_from:
            scratch.drop(spark, read_from)
        read_from = path
    return docs
