"""Keyword retrieval over node labels: document frequencies, scores, seeds, lookup tiers.

Terms are a handful of literals of one query, so each becomes a few expressions in one pass over the nodes; nothing is
joined or exploded.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions import text

# Weights of the tiers.
EXACT, PREFIX, SUBSTRING, SOURCE, RATIONALE = 1000.0, 100.0, 1.0, 0.5, 0.75
# Words that say nothing about what is asked for.
STOPWORDS = set(
    "how what why when where which who whom whose does did is are was were be been being can could should would will shall may might must has have had the and but "
    "not for from with without into onto off that this these those there here its their them they about any all some work works working der die das den dem ein eine "
    "und oder nicht wie wer wann wo warum wieso welche welcher welches ist sind wird wurde hat haben kann koennen können soll muss sich bei mit von fuer für ueber über "
    "nach aus gibt es funktioniert geaendert geändert aendert ändert pourquoi quand quel quelle quels quelles quoi qui que est sont fonctionne cette dans avec où cómo "
    "como qué cuál cuáles cuándo dónde donde porque por para funciona está están hay qual quais quando onde são estão tem uma não perché cosa quale quali dove funziona "
    "sono che della".split()
)


def query_terms(question: str) -> list[str]:
    """Search terms: words of a language other than English, or of three letters and more; filler words only if there is nothing else."""
    terms = []
    for raw in question.lower().split():
        if any("一" <= c <= "鿿" for c in raw):
            pairs = [raw[i : i + 2] for i in range(len(raw) - 1)] or [raw]
            terms += [*pairs, *([raw] if len(raw) > 1 and raw not in pairs else [])]
        else:
            terms += [t for t in re.findall(r"\w+", raw) if len(t) > 2 or not re.fullmatch("[a-z]*", t)]
    return [t for t in terms if t not in STOPWORDS] or terms


def prepared(nodes: DataFrame) -> DataFrame:
    """Nodes with norm_label, bare_label and label_tokens."""
    d = text.with_fold(nodes, "label", "_folded").withColumn("norm_label", F.lower("_folded"))
    return d.withColumns({"bare_label": text.bare_label(F.col("norm_label")), "label_tokens": F.array_join(text.tokens(F.col("_folded")), " ")}).drop("_folded")


def document_frequencies(nodes: DataFrame, terms: list[str]) -> DataFrame:
    """(term, df, idf): labels that contain a term, and ln(1 + N / (1 + df))."""
    own = prepared(nodes)
    counts = own.agg(F.count("*").alias("n"), *[F.sum(F.contains("norm_label", F.lit(t)).cast("long")).alias(f"t{i}") for i, t in enumerate(terms)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"t{i}").alias("df")) for i, t in enumerate(terms)]))
    return counts.select("n", rows.alias("r")).select("r.term", "r.df", F.log(1 + F.col("n") / (1 + F.col("r.df"))).alias("idf"))


def _tiers(t: Column, w: Column, node: dict[str, Column]) -> dict[str, Column]:
    exact = (node["norm_label"] == t) | (node["bare_label"] == t)
    prefix = node["norm_label"].startswith(t) | node["bare_label"].startswith(t)
    inside = F.contains(node["norm_label"], t)
    zero = F.lit(0.0)
    return {
        "tier": F.when(exact, w * EXACT).when(prefix, w * PREFIX).otherwise(zero),
        "inside": F.when(~exact & ~prefix & inside, w * SUBSTRING).otherwise(zero),
        "matched": (exact | prefix | inside).cast("int"),
        "side": F.when(F.contains(F.lower(F.coalesce(node["source_file"], F.lit(""))), t), w * SOURCE).otherwise(zero) + F.when(F.contains(F.lower(F.coalesce(node["rationale"], F.lit(""))), t), w * RATIONALE).otherwise(zero),
    }


def scores(nodes: DataFrame, terms: list[str], top: int | None = None) -> DataFrame:
    """(id, score) of nodes that match, best first: by score, length of label, id."""
    terms = list(dict.fromkeys(terms))
    idf = document_frequencies(nodes, terms)
    weights = idf.groupBy().pivot("term", terms).agg(F.first("idf"))
    weights = weights.select(*[F.col(f"`{t}`").alias(f"w{i}") for i, t in enumerate(terms)])
    own = prepared(nodes).join(F.broadcast(weights))  # one row
    node = {c: F.col(c) for c in ("norm_label", "bare_label", "label_tokens", "source_file", "rationale")}
    joined = F.lit(" ".join(terms))
    best = F.greatest(*[F.col(f"w{i}") for i in range(len(terms))]) if len(terms) > 1 else F.col("w0")
    whole_exact = (node["norm_label"] == joined) | (node["bare_label"] == joined) | (node["label_tokens"] == joined) | (F.lower("id") == joined)
    whole_prefix = node["norm_label"].startswith(joined) | node["bare_label"].startswith(joined) | node["label_tokens"].startswith(joined)
    score = F.when(whole_exact, best * EXACT * 10).when(whole_prefix, best * PREFIX * 10).otherwise(F.lit(0.0))
    each = [_tiers(F.lit(t), F.col(f"w{i}"), node) for i, t in enumerate(terms)]
    add = lambda k: sum((e[k] for e in each[1:]), each[0][k])
    score = score + add("inside") + add("side") + add("tier") * F.pow(add("matched") / len(terms), F.lit(2.0))
    ranked = own.select("id", F.length(F.coalesce("label", "id")).alias("_n"), score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "_n", "id")
    return (ranked if top is None else ranked.limit(top)).select("id", "score")


def seeds_by_term(nodes: DataFrame, deg: DataFrame, terms: list[str]) -> DataFrame:
    """(term, id): for each term the node it fits best by itself; ties by degree, length of label, id."""
    found = None
    own = prepared(nodes).join(deg, "id")
    idf = document_frequencies(nodes, terms)
    for t in terms:
        node = {c: F.col(c) for c in ("norm_label", "bare_label", "label_tokens", "source_file", "rationale")}
        term = F.lit(t)
        with_w = own.join(F.broadcast(idf.filter(F.col("term") == t).select(F.col("idf").alias("w"))))
        e = _tiers(term, F.col("w"), node)
        exact = (node["norm_label"] == term) | (node["bare_label"] == term) | (node["label_tokens"] == term) | (F.lower("id") == term)
        prefix = node["norm_label"].startswith(term) | node["bare_label"].startswith(term) | node["label_tokens"].startswith(term)
        single = F.when(exact, F.col("w") * EXACT * 10).when(prefix, F.col("w") * PREFIX * 10).otherwise(F.lit(0.0)) + e["tier"] + e["inside"] + e["side"]
        best = with_w.withColumn("s", single).filter("s > 0").agg(F.min_by("id", F.struct(-F.col("s"), -F.col("degree"), F.length(F.coalesce("label", "id")), F.col("id"))).alias("id"))
        row = best.filter("id is not null").select(F.lit(t).alias("term"), "id")
        found = row if found is None else found.unionByName(row)
    return found


# Words that ask for a relation.
INTENT = set("call calls called caller callers invoke invokes invoked use uses used using import imports imported export exports exported extend extends extended implement implements implemented depend depends reference references referenced".split())


def pick_seeds(ranked: DataFrame, nodes: DataFrame, best: DataFrame, terms: list[str], most: int = 3, gap: float = 0.2) -> list[str]:
    """Where a traversal starts: the best nodes with different labels, none below ``gap`` of the first's score, and each term's own.

    Words of intent get no seed of their own unless there are no other words. Both inputs have a handful of rows.
    """
    label = prepared(nodes).select("id", "norm_label")
    first = ranked.orderBy(F.desc("score"), "id").limit(50).join(label, "id").orderBy(F.desc("score"), "id").collect()
    own = {r.term: (r.id, r.norm_label) for r in best.join(label, "id").collect()}
    if any(t not in INTENT for t in terms):
        own = {t: x for t, x in own.items() if t not in INTENT}
    seeds, seen = [], set()
    for r in first:
        if len(seeds) >= most or (seeds and r.score < first[0].score * gap):
            break
        if r.norm_label not in seen:
            seen.add(r.norm_label)
            seeds.append(r.id)
    for t in sorted(own):
        i, name = own[t]
        if i not in seeds and name not in seen:
            seen.add(name)
            seeds.append(i)
    return seeds


def ambiguous(nodes: DataFrame, query: str) -> DataFrame:
    """(files, ambiguous): whether the best tier of a lookup spans several files."""
    return lookup(nodes, query).agg(F.countDistinct("source_file").alias("files")).withColumn("ambiguous", F.col("files") > 1)


def lookup(nodes: DataFrame, query: str) -> DataFrame:
    """(id, tier) of the nodes in the best tier that matches: source path, exact, prefix, substring."""
    q = text.fold(query).lower()
    joined = F.lit(" ".join(re.findall(r"[^\W_]+", q)))
    own = prepared(nodes)
    source_tokens = F.array_join(text.tokens(F.coalesce("source_file", F.lit(""))), " ")
    exact = (F.col("norm_label") == q) | (F.col("bare_label") == q) | (F.col("label_tokens") == joined) | (F.lower("id") == q)
    prefix = F.col("norm_label").startswith(q) | F.col("label_tokens").startswith(joined)
    inside = F.contains("norm_label", F.lit(q)) | F.contains("label_tokens", joined)
    tier = F.when(source_tokens == joined, 0).when(exact, 1).when(prefix, 2).when(inside, 3)
    tiered = own.withColumn("tier", tier).filter("tier is not null").select("id", "source_file", "tier")
    return tiered.join(F.broadcast(tiered.agg(F.min("tier").alias("tier"))), "tier").select("id", "tier", "source_file")


def render(nodes: DataFrame, visited: DataFrame, deg: DataFrame, most: int = 20_000) -> DataFrame:
    """(place, id, line) text lines of nodes by distance, descending degree, id; ``most`` lines, more than any budget of text has room for."""
    d = nodes.join(visited, "id").join(deg, "id").orderBy("distance", F.desc("degree"), "id").limit(most)
    place = F.row_number().over(Window.orderBy("distance", F.desc("degree"), "id"))
    line = F.format_string("NODE %s [src=%s loc=%s community=%s]", "label", F.coalesce("source_file", F.lit("")), F.coalesce("source_location", F.lit("")), F.coalesce(F.col("community").cast("string"), F.lit("")))
    return d.select(place.alias("place"), "id", line.alias("line"))


def within_budget(lines: DataFrame, tokens: int) -> DataFrame:
    """Lines (place, line) that together stay in a budget of three characters a token; the first always stays."""
    used = F.sum(F.length("line") + 1).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    return lines.withColumn("used", used.cast("long")).filter((F.col("used") <= tokens * 3) | (F.col("place") == 1))
