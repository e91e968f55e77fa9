"""Approximate nearest neighbours by stable projections: a kd-tree in few dimensions and a chi-square stopping test.

Vectors are scaled to length one, where the largest cosine is the smallest distance, and projected onto
``PROJECTED`` Gaussian directions. A projected squared distance divided by the true one then follows a chi-square law with
that many degrees of freedom. Each shard of the rows is indexed by a kd-tree over the projections. A query visits the
tree's leaves from the nearest box on and verifies projected neighbours in ascending order on the original
vectors; it stops when, for a vector as near as the k-th best so far, the chance of a projected
distance beyond the next one is less than ``1 - STOP``. Equal vectors are one point of the tree with a list of ids.

Rows are dealt to shards in turn, so no vector or id fills one shard; queries go to every shard and stream past
its index in batches; the k best of every shard meet per query. A shard holds about ``SHARD_ROWS`` rows.

Results for odd input: vectors that are null, zero, of another length than most, or hold a null or non-finite component
take no part, neither as query nor as candidate; a query never finds a row with its own id; rows that
repeat an id are candidates each, and repeated queries are answered each; ties go to the smaller id, null
ids take no part; with fewer candidates than k all are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PROJECTED = 8
STOP = 0.99
LEAF = 64
SHARD_ROWS = 16_384
SEED = 11
#: Leaves whose points are verified together at first; each further step takes twice as many.
LEAVES = 4


def chi_square_cdf(x: float, freedom: int) -> float:
    """For an even number of degrees of freedom."""
    half, term, total = x / 2, 1.0, 1.0
    for i in range(1, freedom // 2):
        term *= half / i
        total += term
    return 1 - float(np.exp(-half)) * total if half < 700 else 1.0


class KdTree:
    """Nodes are ranges of ``order`` with the box of their points; children of node i are 2i+1 and 2i+2 while ``cut[i]``."""

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.range: dict[int, tuple[int, int]] = {}
        self.low: dict[int, np.ndarray] = {}
        self.high: dict[int, np.ndarray] = {}
        stack = [(0, 0, len(points))]
        while stack:
            node, a, b = stack.pop()
            own = points[self.order[a:b]]
            self.range[node], self.low[node], self.high[node] = (a, b), own.min(0), own.max(0)
            if b - a > LEAF:
                axis = int(np.argmax(self.high[node] - self.low[node]))
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(own[:, axis], mid)]
                stack += [(2 * node + 1, a, a + mid), (2 * node + 2, a + mid, b)]
        self.nodes = {n: i for i, n in enumerate(self.range)}
        self.lows, self.highs = np.array(list(self.low.values())), np.array(list(self.high.values()))

    def leaves(self, q: np.ndarray) -> Iterator[tuple[float, np.ndarray]]:
        """(least squared distance, points) of the leaves, nearest box first."""
        gap = np.maximum(np.maximum(self.lows - q, q - self.highs), 0)
        least = (gap * gap).sum(1).tolist()
        heap = [(least[0], 0)]
        while heap:
            d, node = heapq.heappop(heap)
            left = self.nodes.get(2 * node + 1)
            if left is None:
                a, b = self.range[node]
                yield d, self.order[a:b]
            else:
                for child in (2 * node + 1, 2 * node + 2):
                    heapq.heappush(heap, (least[self.nodes[child]], child))


class Shard:
    """An index of vectors; equal ones are kept once, with all their ids in ascending order."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        whole = np.ascontiguousarray(vectors)
        _, first, which = np.unique(whole.view(f"V{whole.dtype.itemsize * whole.shape[1]}").ravel(), return_index=True, return_inverse=True)
        by = np.lexsort((ids, which))
        self.ids = np.split(ids[by], np.flatnonzero(np.diff(which[by])) + 1)
        self.vectors = vectors[first].astype(np.float64)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(1))
        self.directions = np.random.RandomState(SEED).standard_normal((self.vectors.shape[1], PROJECTED))
        self.tree = KdTree((self.vectors / self.norms[:, None]) @ self.directions)

    def search(self, own: int, q: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (-cosine, id) of those found."""
        q = q.astype(np.float64)
        norm = np.sqrt((q * q).sum())
        p = (q / norm) @ self.directions
        best: list[tuple[float, int]] = []
        waiting, reached = [], self.tree.leaves(p)
        points = self.tree.points
        done, take = False, LEAVES
        while not done:
            least, fresh = np.inf, []
            for _ in range(take):
                d, leaf = next(reached, (np.inf, None))
                least = d
                if leaf is None:
                    done = True
                    break
                fresh.append(leaf)
            if fresh:
                own_leaves = np.concatenate(fresh)
                gap = points[own_leaves] - p
                waiting.append((own_leaves, (gap * gap).sum(1)))
            take *= 2
            leaf = np.concatenate([w[0] for w in waiting])
            far = np.concatenate([w[1] for w in waiting])
            near = far <= least  # no leaf to come holds a nearer one
            waiting = [(leaf[~near], far[~near])]
            if near.any():
                batch = leaf[near][np.argsort(far[near], kind="stable")]
                cosines = (self.vectors[batch] * q).sum(1) / (self.norms[batch] * norm)
                floor = -best[-1][0] if len(best) >= k else -np.inf
                for i in np.flatnonzero(cosines >= floor).tolist():
                    ids = self.ids[batch[i]]
                    best += [(-float(cosines[i]), x) for x in ids[ids != own][:k].tolist()]
                best = sorted(best)[:k]
            if len(best) >= k and not done:
                true = max(2 + 2 * best[-1][0], 1e-300)
                done = chi_square_cdf(least / true, PROJECTED) >= STOP
        return best


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def nearest(rows: DataFrame, is_query: F.Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row for which ``is_query`` holds, its nearest others: query_id, rank, vec_id, score."""
    v = F.col("v")
    sound = rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    sound = sound.filter("id is not null and v is not null").filter(~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    sizes = sound.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    dims = sizes[0]["n"] if sizes else 1
    total = sizes[0]["count"] if sizes else 0
    sound = sound.filter(F.size("v") == dims).withColumn("turn", F.monotonically_increasing_id())
    shards = max(1, -(-total // SHARD_ROWS))
    kept = sound.select((F.pmod("turn", F.lit(shards))).cast("int").alias("shard"), F.lit(None).cast("long").alias("turn"), "id", "v")
    asked = sound.filter("asks").select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "turn", "id", "v")
    dealt = kept.unionByName(asked).repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("turn").asc_nulls_first())

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, ids, vectors = None, None, [], []
        for whole in batches:
            shard_of = whole.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), len(shard_of)]
            for a, e in zip(cuts, cuts[1:]):
                b = whole.slice(a, e - a)
                if e == a:
                    continue
                if shard_of[a] != at:
                    index, at, ids, vectors = None, shard_of[a], [], []
                n = b.column(1).null_count  # rows to index come before queries
                if n:
                    ids.append(b.column(2).slice(0, n).to_numpy())
                    vectors.append(_vectors(b.column(3).slice(0, n), dims))
                if n < b.num_rows:
                    index = index or Shard(np.concatenate(ids), np.concatenate(vectors))
                    asks, own = b.column(1).slice(n).to_pylist(), b.column(2).slice(n).to_pylist()
                    found = [(t, o, x, -s) for t, o, q in zip(asks, own, _vectors(b.column(3).slice(n), dims)) for s, x in index.search(o, q, k)]
                    yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))], ["turn", "query_id", "vec_id", "score"])

    found = dealt.mapInArrow(search, "turn long, query_id long, vec_id long, score double")
    best = Window.partitionBy("turn", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
