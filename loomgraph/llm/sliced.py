"""Fixed-size arrays added up over all tasks, slice by slice.

An array of ``SLICES`` x ``width`` counters has the same size for every corpus. A task adds to its own copy and passes
it on as compressed slices; the slices of all tasks are added where they meet, and what the driver gets is one
row for each slice.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICES = 16
#: Bits of a membership filter for each key and in all; a place is a hash, so a filter may hold more than was put in, never less.
#: Beyond some millions of keys a filter of the largest size (64 MB) lets more and more through, and the join behind it does the rest.
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 17, 1 << 29


def spread(counters: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """(slice, packed) of the slices that are not all zero."""
    for k, part in enumerate(counters.reshape(SLICES, -1)):
        if part.any():
            yield k, zlib.compress(part.astype("<u4").tobytes(), 1)


def total(rows: DataFrame, size: int, finish: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of (slice, packed) rows as ``finish`` makes it of each slice (uint8 to be sent to the driver)."""
    width = size // SLICES

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), "<u4")
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.uint64)
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([finish(s).astype(np.uint8).tobytes()], pa.binary())], ["slice", "packed"])

    out = np.repeat(finish(np.zeros(1, np.uint64)).astype(np.uint8), size)
    for r in rows.repartition(SLICES, "slice").mapInArrow(add, "slice int, packed binary").collect():
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.packed, np.uint8)
    return out


def _place(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where a filter of so many bits, a power of two, holds 64-bit keys."""
    x = keys.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(65 - bits.bit_length())).astype(np.int64)


def holds(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether a filter holds each key: true for all that were put in, false for most others."""
    at = _place(np.ascontiguousarray(keys), 8 * len(filter_))
    return (filter_[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def members(keys: DataFrame) -> np.ndarray:
    """A filter, as packed bits, of all values of a DataFrame's columns of longs; its size follows their number."""
    asked = max(1, keys.count() * len(keys.columns) * KEY_BITS)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (asked - 1).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 8, np.uint8)
        for b in batches:
            for c in b.columns:
                at = _place(c.to_numpy(), bits)
                np.bitwise_or.at(marks, at >> 3, (128 >> (at & 7)).astype(np.uint8))
        rows = list(spread(marks))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["slice", "packed"])

    def either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, np.ndarray] = {}
        for b in batches:
            for k, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = np.frombuffer(zlib.decompress(packed), "<u4").astype(np.uint8)
                got[k] = got[k] | part if k in got else part
        for k, part in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], ["slice", "packed"])

    schema = "slice int, packed binary"
    out = np.zeros(bits // 8, np.uint8)
    width = len(out) // SLICES
    for r in keys.mapInArrow(marked, schema).repartition(SLICES, "slice").mapInArrow(either, schema).collect():
        out[r.slice * width : (r.slice + 1) * width] = np.frombuffer(r.packed, np.uint8)
    return out


def among(keys: DataFrame) -> Callable[[Column], Column]:
    """A predicate on a column of longs: true for all values of ``keys`` and for null, false for nearly all others.

    It parts the few rows that a join decides about from the many that pass without being dealt out.
    """
    marks = keys.sparkSession.sparkContext.broadcast(members(keys))

    @F.arrow_udf(T.BooleanType())
    def there(values: pa.Array) -> pa.Array:
        known = holds(marks.value, values.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(known | values.is_null().to_numpy(zero_copy_only=False))

    return there
