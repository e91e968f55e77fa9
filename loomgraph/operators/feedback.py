"""Lessons from feedback: time-decayed signed scores of nodes, latest corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSITIVE = ["useful"]
NEGATIVE = ["dead_end", "corrected"]


def scored(memory: DataFrame, now: str, half_life_days: float = 30.0) -> DataFrame:
    """(node, pos, neg, score, last): one row a node; undated signals count in full, future ones too."""
    sign = F.when(F.col("outcome").isin(POSITIVE), 1).when(F.col("outcome").isin(NEGATIVE), -1)
    age = F.greatest(F.lit(0.0), (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 86_400_000_000.0)
    weight = F.coalesce(F.pow(F.lit(0.5), age / half_life_days), F.lit(1.0))
    own = memory.filter(sign.isNotNull()).select("node", "ts", sign.alias("sign"), weight.alias("weight"))
    return own.groupBy("node").agg(
        F.sum((F.col("sign") > 0).cast("long")).alias("pos"), F.sum((F.col("sign") < 0).cast("long")).alias("neg"), F.round(F.sum(F.col("sign") * F.col("weight")), 9).alias("score"), F.max("ts").alias("last")
    )


def lessons(memory: DataFrame, now: str, half_life_days: float = 30.0, min_corroboration: int = 2) -> DataFrame:
    """(node, kind, verdict, score): preferred, tentative or contested; nodes with bad outcomes alone are left to the dead ends."""
    s = scored(memory, now, half_life_days)
    kind = F.when((F.col("pos") > 0) & (F.col("neg") > 0), "contested").when(F.col("pos") >= min_corroboration, "preferred").when(F.col("pos") > 0, "tentative")
    verdict = F.when(F.col("score") > 0, "useful").when(F.col("score") < 0, "dead end").otherwise("even")
    return s.select("node", kind.alias("kind"), F.when(kind == "contested", verdict).alias("verdict"), "score").filter("kind is not null")


def latest_by_question(memory: DataFrame, outcome: str) -> DataFrame:
    """(question, doc_id, correction): the last entry of every question with an outcome."""
    return memory.filter(F.col("outcome") == outcome).groupBy("question").agg(F.max_by(F.struct("doc_id", "correction"), F.struct("ts", "doc_id")).alias("r")).select("question", "r.doc_id", "r.correction")


def plurality(memory: DataFrame, nodes: DataFrame) -> DataFrame:
    """(question, community): the community that most of a question's nodes are in, the least of equals."""
    own = memory.join(nodes.select(F.col("id").alias("node"), F.col("community")), "node").groupBy("question", "community").agg(F.count("*").alias("n"))
    return own.groupBy("question").agg(F.min_by("community", F.struct(-F.col("n"), F.col("community"))).alias("community"))
