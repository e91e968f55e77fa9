"""Cutting long documents and packing units under a budget, in order."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slices(text: str, most: int) -> list[tuple[int, int]]:
    """Ranges that cover a text, none longer than ``most``, cut before a heading, else after a blank line, else after a line feed."""
    out, at = [], 0
    while len(text) - at > most:
        cut = at + most
        for sep, after in (("\n#", 1), ("\n\n", 2), ("\n", 1)):
            found = text.rfind(sep, at + 1, at + most)
            if found > at:
                cut = found + after
                break
        out.append((at, cut))
        at = cut
    return [*out, (at, len(text))] if at < len(text) or not out else out


def slice_documents(docs: DataFrame, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, slice, start, end)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, s, e) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (s, e) in enumerate(slices(t or "", most))]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], ["doc_id", "slice", "start", "end"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(of, "doc_id long, slice long, start long, end long")


def pack_by_directory(units: DataFrame, budget: int) -> DataFrame:
    """(dir, unit, chunk): units of a directory in order, a new chunk where the next would exceed the budget.

    The rule is sequential within a directory. Directories are dealt to tasks and stream through them sorted, so a task
    holds one running sum and no directory is collected; chunks are numbered by directory.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunk, used = None, 0, 0
        for b in batches:
            chunks = []
            for d, cost in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if d != at:
                    at, chunk, used = d, 0, 0
                elif used + cost > budget:
                    chunk, used = chunk + 1, 0
                used += cost
                chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(chunks, pa.int64())], ["dir", "unit", "chunk"])

    own = units.select("dir", F.col("unit").cast("long"), F.col("cost").cast("long")).repartition("dir").sortWithinPartitions("dir", "unit")
    return own.mapInArrow(of, "dir string, unit long, chunk long")
