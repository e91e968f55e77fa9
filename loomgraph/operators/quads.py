"""Facts (g, s, p, o) from several sources: conflicts, precedence, inconsistencies, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_sets(quads: DataFrame) -> DataFrame:
    """(s, p, g, values)."""
    return quads.groupBy("s", "p", "g").agg(F.array_sort(F.collect_set("o")).alias("values"))


def conflicts(quads: DataFrame) -> DataFrame:
    """(s, p, sources, values) whose value sets differ between sources."""
    v = value_sets(quads).groupBy("s", "p").agg(F.count("*").alias("sources"), F.countDistinct("values").alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("values")))), "|").alias("values"))
    return v.filter("n > 1").select("s", "p", "sources", "values")


def winners(quads: DataFrame, graphs: DataFrame) -> DataFrame:
    """(s, p, g, o) in conflicts, of sources that no other source of the same fact beats.

    A wiki source that overrides the other wins; else raw wins over wiki; else the later date, then version.
    """
    contested = quads.join(conflicts(quads).select("s", "p"), ["s", "p"], "left_semi")
    facts = contested.select("s", "p", "g").distinct().join(F.broadcast(graphs), "g")  # one row for each source
    a = facts.select("s", "p", *[F.col(c).alias(f"a_{c}") for c in ("g", "source", "layer", "date", "version_key", "override_of")])
    b = facts.select("s", "p", *[F.col(c).alias(f"b_{c}") for c in ("g", "source", "layer", "date", "version_key", "override_of")])
    over = lambda x, y: F.coalesce((F.col(f"{x}_layer") == "wiki") & ((F.col(f"{x}_override_of") == F.col(f"{y}_source")) | (F.col(f"{x}_override_of") == F.col("s"))), F.lit(False))
    later = (F.col("b_date") > F.col("a_date")) | ((F.col("b_date") == F.col("a_date")) & (F.col("b_version_key") > F.col("a_version_key")))
    beats = over("b", "a") | (~over("a", "b") & (((F.col("b_layer") == "raw") & (F.col("a_layer") == "wiki")) | ((F.col("b_layer") == F.col("a_layer")) & later)))
    beaten = a.join(b, ["s", "p"]).filter((F.col("a_g") != F.col("b_g")) & beats).select("s", "p", F.col("a_g").alias("g")).distinct()
    return contested.join(beaten, ["s", "p", "g"], "left_anti").select("s", "p", "g", "o").distinct()


def inconsistencies(quads: DataFrame) -> DataFrame:
    """(s, p, g, n, values): one source, several values."""
    return value_sets(quads).filter(F.size("values") > 1).select("s", "p", "g", F.size("values").cast("long").alias("n"), F.array_join("values", "|").alias("values"))


def search(quads: DataFrame, term: str, top: int = 50) -> DataFrame:
    return quads.filter(F.contains(F.lower("o"), F.lit(term.lower()))).select("s", "p", "g", "o").orderBy("s", "p", "g", "o").limit(top)


def ask(quads: DataFrame, terms: list[str], weights: dict[str, float], top: int = 20) -> DataFrame:
    """(s, score): for each term the greatest weight of a property that contains it, and 5 if all terms occur."""
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("p")), F.lit(1.0))
    hits = [F.max(F.when(F.contains(F.lower("o"), F.lit(t)), weight)).alias(f"t{i}") for i, t in enumerate(terms)]
    own = quads.groupBy("s").agg(*hits)
    each = [F.col(f"t{i}") for i in range(len(terms))]
    score = sum((F.coalesce(c, F.lit(0.0)) for c in each), F.lit(0.0))
    every = F.lit(True)
    for c in each:
        every = every & c.isNotNull()
    return own.select("s", (score + F.when(every, 5.0).otherwise(0.0)).alias("score")).filter("score > 0").orderBy(F.desc("score"), "s").limit(top)
