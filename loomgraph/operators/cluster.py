"""Communities and centralities that have no relational form.

Communities: synchronous label moves on the DataFrame. Each round every node weighs the communities of its neighbours by
the modularity that joining them would gain and moves to the best; half of the nodes (by a hash of id and round) move in a
round, which keeps neighbours from swapping for ever. Ids become numbers once; the edges are kept as lists of bounded length
below their one end. A round joins these lists with the communities' sizes, deals what the moving half is told out by
node, and adds it up there; totals for a community are aggregated, so a hub or a huge community is never collected.

Betweenness: Brandes' accumulation from sampled sources, each source one task's traversal of a broadcast adjacency whose size
is checked first.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.traverse import symmetric
from loomgraph.plans import scratch

#: An adjacency up to this many pairs is broadcast for centralities (16 bytes a direction).
MOST_PAIRS = 5_000_000
#: Rounds that a node's key tells it to move in or not.
BITS = 24
#: Ends of edges that a task takes at most on average, whatever the session's number of partitions.
ENDS_PER_TASK = 1_000_000


def _numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its place in ``order`` from 0, by the places in sorted parts and the parts' row counts."""
    rows = scratch.save(df.orderBy(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), name)
    parts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each part
    before = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_n", "_before")


def _keys(nodes: DataFrame) -> DataFrame:
    """(id, key): numbers in the order of the ids' hashes; bit r of a key says whether the node moves in round r."""
    ids = _numbered(nodes.select("id").filter("id is not null").distinct(), [F.xxhash64("id"), F.col("id")], "place")
    bits = [F.when(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(2)) == 0, F.lit(1 << r)).otherwise(F.lit(0)) for r in range(BITS)]
    return ids.select("id", F.shiftleft("place", BITS).bitwiseOR(reduce(lambda a, b: a.bitwiseOR(b), bits).cast("long")).alias("key"))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (dst, src) sorted by dst to rows (dst, srcs); a node's list ends with the batch."""
    for b in batches:
        dst = b.column("dst").to_numpy()
        starts = np.flatnonzero(np.append(True, dst[1:] != dst[:-1])) if len(dst) else np.empty(0, "int64")
        offsets = pa.array(np.append(starts, len(dst)).astype("int32"))
        yield pa.RecordBatch.from_arrays([pa.array(dst[starts]), pa.ListArray.from_arrays(offsets, b.column("src"))], names=["dst", "srcs"])


def _parts(spark: SparkSession, ends: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ends // ENDS_PER_TASK))


def _neighbours(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """(dst, srcs): the neighbours of each node by key, in one or more rows."""
    ends = pairs.filter("lo <> hi").select("lo", "hi")
    for end in ("lo", "hi"):
        ends = ends.join(keys.select(F.col("id").alias(end), F.col("key").alias(f"{end}_key")).hint("shuffle_hash"), end).drop(end)
    both = ends.select(F.inline(F.array(F.struct(F.col("lo_key").alias("dst"), F.col("hi_key").alias("src")), F.struct(F.col("hi_key").alias("dst"), F.col("lo_key").alias("src")))))
    return both.repartition(_parts(pairs.sparkSession, 2 * pairs.count()), "dst").distinct().sortWithinPartitions("dst").mapInArrow(_lists, "dst long, srcs array<long>")


def communities(nodes: DataFrame, pairs: DataFrame, rounds: int = 12, resolution: float = 1.0) -> DataFrame:
    """(id, cid): communities numbered by descending size, then least member; isolated nodes have their own.

    ``pairs`` (lo, hi) may have an edge more than once and either way; those with an end that is no node are left out.
    After ``BITS`` rounds the halves that move come again.
    """
    spark = nodes.sparkSession
    keys = scratch.save(_keys(nodes), "keys")
    adj = scratch.save(_neighbours(pairs, keys), "adjacency")
    degree = adj.groupBy(F.col("dst").alias("key")).agg(F.sum(F.size("srcs")).alias("k"))
    state, path = scratch.table(degree.select("key", "k", F.col("key").alias("c")), "state")
    total = state.agg(F.sum("k")).first()[0] or 0
    parts = _parts(spark, total)
    for r in range(rounds if total else 0):
        moves = F.col("key").bitwiseAND(F.lit(1 << r % BITS)) != 0
        sized = state.join(state.groupBy("c").agg(F.sum("k").alias("v")), "c")
        told = adj.join(sized.select(F.col("key").alias("dst"), "c", "v"), "dst").select(F.explode("srcs").alias("key"), "c", "v").filter(moves)
        links = told.repartition(parts, "key").groupBy("key", "c", "v").agg(F.count("*").alias("w"))
        share = F.lit(resolution) * F.col("k")
        stay = F.lit(0).cast("long") - share * (F.col("v") - F.col("k")) / total  # without a link into the own community
        own = sized.filter(moves).select("key", "k", F.col("c").alias("now"), stay.alias("stay"))
        rest = F.col("v") - F.when(F.col("c") == F.col("now"), F.col("k")).otherwise(0)
        offers = links.join(own.hint("shuffle_hash"), "key").withColumn("gain", F.col("w") - share * rest / total).filter("gain > stay - 1e-8")
        best = offers.groupBy("key").agg(F.max(F.struct(F.round("gain", 9).alias("gain"), (F.col("c") == F.col("now")).alias("same"), "c")).alias("best"), F.first("stay").alias("stay"))
        moved = best.filter(F.col("best.gain") > F.round("stay", 9)).select("key", F.col("best.c").alias("to"))
        following, new_path = scratch.table(state.join(moved, "key", "left").select("key", "k", F.coalesce("to", "c").alias("c")), "state")
        scratch.drop(spark, path)
        state, path = following, new_path
    labelled = nodes.select("id").join(keys, "id").join(state.select("key", "c"), "key", "left").select("id", F.coalesce("c", "key").alias("c"))
    sizes = labelled.groupBy("c").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    numbered = _numbered(sizes, [F.desc("n"), F.col("first")], "cid")
    return labelled.join(numbered.select("c", "cid"), "c").select("id", "cid")


def modularity(assigned: DataFrame, pairs: DataFrame) -> float:
    adj = symmetric(pairs.filter("lo <> hi"))
    c = assigned.select("id", "cid")
    m = adj.count()
    if not m:
        return 0.0
    inside = adj.join(c.select(F.col("id").alias("src"), F.col("cid").alias("a")), "src").join(c.select(F.col("id").alias("dst"), F.col("cid").alias("b")), "dst")
    within = inside.filter("a = b").count()
    volumes = inside.groupBy("a").agg(F.count("*").alias("v")).agg(F.sum(F.col("v").cast("double") * F.col("v"))).first()[0]
    return within / m - volumes / m / m


def betweenness(nodes: DataFrame, pairs: DataFrame, sources: int | None = None) -> DataFrame:
    """(id, score): share of shortest paths through a node, from all sources or the first ``sources`` by hash, normalised."""
    spark = nodes.sparkSession
    n_pairs = pairs.count()
    if n_pairs > MOST_PAIRS:
        raise ValueError(f"{n_pairs} pairs are more than a task can hold; take the neighbourhood of interest first")
    ids = [r.id for r in nodes.select("id").orderBy("id").collect()]  # bounded as the pairs are
    place = {x: i for i, x in enumerate(ids)}
    near: list[list[int]] = [[] for _ in ids]
    for r in pairs.filter("lo <> hi").collect():
        near[place[r.lo]].append(place[r.hi])
        near[place[r.hi]].append(place[r.lo])
    graph = spark.sparkContext.broadcast(near)
    n = len(ids)
    chosen = nodes.select("id").orderBy(F.xxhash64("id", F.lit(42))).limit(sources) if sources else nodes.select("id")
    starts = spark.createDataFrame([(place[r.id],) for r in chosen.collect()], "s int").repartition(spark.sparkContext.defaultParallelism)

    def of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = np.zeros(n)
        for f in frames:
            for s in f["s"]:
                order, before, paths, far = [], [[] for _ in range(n)], np.zeros(n), np.full(n, -1)
                paths[s], far[s] = 1, 0
                queue = deque([s])
                while queue:
                    v = queue.popleft()
                    order.append(v)
                    for w in graph.value[v]:
                        if far[w] < 0:
                            far[w] = far[v] + 1
                            queue.append(w)
                        if far[w] == far[v] + 1:
                            paths[w] += paths[v]
                            before[w].append(v)
                part = np.zeros(n)
                for w in reversed(order):
                    for v in before[w]:
                        part[v] += paths[v] / paths[w] * (1 + part[w])
                    if w != s:
                        score[w] += part[w]
        at = np.flatnonzero(score)
        yield pd.DataFrame({"i": at.astype("int32"), "score": score[at]})

    k = sources or n
    scale = (n / k) / ((n - 1) * (n - 2)) if n > 2 else 0.0
    names = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "i int, id string")
    found = starts.mapInPandas(of, "i int, score double").groupBy("i").agg(F.sum("score").alias("score"))
    return names.join(found, "i", "left").select("id", F.round(F.coalesce("score", F.lit(0.0)) * scale, 9).alias("score"))


def attach_by_vote(assigned: DataFrame, pairs: DataFrame, left_out: DataFrame) -> DataFrame:
    """(id, cid) of nodes left out of clustering (id): the community most of their neighbours are in, the least of equals."""
    votes = symmetric(pairs.filter("lo <> hi")).join(left_out.select(F.col("id").alias("src")), "src").join(assigned.select(F.col("id").alias("dst"), "cid"), "dst")
    counted = votes.groupBy(F.col("src").alias("id"), "cid").agg(F.count("*").alias("n"))
    return counted.groupBy("id").agg(F.min_by("cid", F.struct(-F.col("n"), F.col("cid"))).alias("cid"))
