"""Best-fit-decreasing packing of token sequences with a segment tree over remaining capacities.

Documents longer than a sequence are cut; all pieces then are packed from the longest to the shortest, each into
the open sequence with the least room that still holds it. What that does depends on how many pieces
have each length alone, and there are at most ``capacity`` lengths; so the driver packs the histogram and not the
pieces: a segment tree over the capacities finds, in logarithmic time, the least room that holds the next
piece, and equal sequences are handled as runs. The outcome is a short table: piece number r of length L
goes to sequence ``first + (r - from) // each`` at ``offset + (r - from) % each * L``. Executors number the
pieces of a length (a running count in each task, plus the counts of the tasks before it) and look their places
up. The result is the packing that one machine would make of the whole corpus; no group is
collected anywhere.

Results for odd input: a null text counts as empty and is one piece of the end id; null and repeated ids are
packed row by row; an empty table gives an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import tokens
from loomgraph.plans import scratch

#: Units that a worker's encoder keeps in a generation; packing follows other stages in the same workers.
MOST_UNITS = 150_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


class CapacityTree:
    """The rooms 0..capacity of which open sequences exist; ``first`` finds the least one of at least so much."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = bytearray(2 * self.size)

    def put(self, room: int, there: bool) -> None:
        i = room + self.size
        self.any[i] = there
        while i > 1:
            i //= 2
            self.any[i] = self.any[2 * i] | self.any[2 * i + 1]

    def first(self, least: int) -> int | None:
        i = least + self.size
        while not self.any[i]:
            while i & 1:  # a right child: everything under the parent from here on has been seen
                i //= 2
            if i == 0:
                return None
            i += 1
        while i < self.size:
            i = 2 * i + (not self.any[2 * i])
        return i - self.size


def best_fit(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Places as (length, from, first sequence, each, offset), in the order of length and from; and the sequences used."""
    tree, runs = CapacityTree(capacity), defaultdict(list)  # room -> [first sequence, sequences]
    places, used = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room:
            runs[room].append((first, n))
            tree.put(room, True)

    for length in sorted(histogram, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError("a piece must have a length from 1 to the capacity")
        left, rank = histogram[length], 0
        while left:
            room = tree.first(length)
            if room is None:  # enough new sequences for all that is left
                room = capacity
                first, n = used, -(-left // (capacity // length))
                used += n
            else:
                first, n = runs[room].pop()
                tree.put(room, bool(runs[room]))
            each = room // length
            full = min(n, left // each)
            if full:
                places.append((length, rank, first, each, capacity - room))
                put(room - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and left and left < each:
                places.append((length, rank, first, left, capacity - room))
                put(room - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            if n:
                put(room, first, n)
    return places, used


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    head = n % capacity or capacity
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, style: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document; ``rank`` numbers those of one length within the task ``part``."""
    end = np.array([end_id], "<u4").tobytes()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, ranks = tokens.encoder(tokenizer, style, MOST_UNITS), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                rows = []
                for doc_id, ids in zip(b.column(0).to_pylist(), own.encode(b.column(1).to_pylist())):
                    ids = np.frombuffer(ids, own.dtype).astype("<u4").tobytes() + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, ranks[length]))
                        ranks[length] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(of, PIECES)


def pack(cuts: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a written table of ``pieces``."""
    counts = cuts.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = scratch.save(counts, "counts")  # at most ``capacity`` rows for each task
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = best_fit(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    table = np.array(places, np.int64).reshape(-1, 5)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    length_of, from_, first, each, offset = table.T
    bounds = np.searchsorted(length_of, np.arange(capacity + 2))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):  # of the places for this length, the last that begins at or before the rank
                own = length == n
                at[own] = bounds[n] + np.searchsorted(from_[bounds[n] : bounds[n + 1]], rank[own], "right") - 1
            inner = rank - from_[at]
            columns = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(first[at] + inner // each[at]), pa.array(offset[at] + inner % each[at] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    # The table of counts grows with the tasks: a shuffled join at any size. No key has more rows than one task wrote.
    ranked = cuts.join(before.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(placed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, style: str = "spaced", end_id: int = 2, capacity: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(scratch.save(pieces(docs, tokenizer, style, end_id, capacity, id_col, text_col), "pieces"), capacity)
