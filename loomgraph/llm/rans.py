"""Token ids as binary files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over the whole corpus and scaled to ``2**scale_bits``, is shared by all blocks. A block
holds the ids of whole documents and is coded by ``LANES`` interleaved coders, token i by coder i mod ``LANES``, into one
stream of 32-bit words. Blocks are independent; within a block the coders' states and the place in the stream
are kept every ``CHECK_STEPS`` steps, so a reader decodes all parts between checkpoints at once (here as the
rows of one array). Each block carries the CRC-32 of its ids and of its bytes and is refused when either
differs.

The files are Parquet, the container that executors can write to any store: a row is a block, its column
``payload`` this module's format, the other columns the index (segment, block, tokens before it in the segment).
Segments follow each other in ascending document id.

Results for odd input: a null text counts as empty and has the end id alone; null ids come first; documents
that repeat an id stand next to each other and are all written; an empty table gives an index of no blocks and
an empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import tokens
from loomgraph.plans import scratch

LANES = 128
CHECK_STEPS = 128
BLOCK_TOKENS = 1 << 17
TOGETHER = 8
LOW = np.uint64(1 << 31)
HEADER = struct.Struct("<4sIIIIIII")  # magic, documents, tokens, words, checkpoints, scale bits, CRC-32 of the ids, CRC-32 of what follows
MAGIC = b"LRA1"
FILE_SCHEMA = "segment int, block int, before long, n_docs int, n_tokens long, payload binary"


def scaled(counts: np.ndarray, scale_bits: int) -> np.ndarray:
    """Frequencies with sum 2**scale_bits, at least 1 for every symbol that occurs."""
    total, whole = int(counts.sum()), 1 << scale_bits
    if not total:
        return np.zeros(len(counts), np.uint64)
    there = counts > 0
    if int(there.sum()) > whole // 2:
        raise ValueError("scale_bits is too small for so many symbols")
    f = np.where(there, np.maximum(1, np.floor(counts / total * (whole - int(there.sum()))).astype(np.int64)), 0)
    f[int(np.argmax(counts))] += whole - int(f.sum())
    return f.astype(np.uint64)


class Coder:
    """Codes and decodes blocks under one table of scaled frequencies."""

    def __init__(self, freq: np.ndarray, scale_bits: int):
        self.freq, self.bits = freq.astype(np.uint64), np.uint64(scale_bits)
        self.cum = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)[:-1].astype(np.uint64)])
        self.mask = np.uint64((1 << scale_bits) - 1)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, blocks: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per block: the states at step 0 and at each checkpoint with the words before it, and the words."""
        rows, n = len(blocks), np.array([len(b) for b in blocks])
        steps = int(-(-n.max() // LANES)) if rows else 0
        ids = np.zeros((rows, steps * LANES), np.int64)
        for r, b in enumerate(blocks):
            ids[r, : len(b)] = b
        ids = np.ascontiguousarray(ids.reshape(rows, steps, LANES).transpose(1, 0, 2))
        lane, thirty_two, low32 = np.arange(LANES), np.uint64(32), np.uint64(0xFFFFFFFF)
        limit = self.freq << (np.uint64(63) - self.bits)
        x = np.full((rows, LANES), LOW, np.uint64)
        words, rows_of, states = [], [], {}
        taken = np.zeros((steps + 1, rows), np.int64)
        for t in range(steps - 1, -1, -1):
            s = ids[t]
            f = self.freq[s]
            active = n[:, None] > t * LANES + lane
            f = np.where(active, f, np.uint64(1))
            over = (x >= limit[s]) & active
            words.append((x[over] & low32).astype(np.uint32))
            rows_of.append(np.nonzero(over)[0])
            taken[t + 1] = over.sum(1)
            x = np.where(over, x >> thirty_two, x)
            q = x // f
            x = np.where(active, (q << self.bits) + (x - q * f) + self.cum[s], x)
            if t % CHECK_STEPS == 0:
                states[t // CHECK_STEPS] = x
        before = np.cumsum(taken, 0)
        all_words = np.concatenate(words[::-1]) if words else np.empty(0, np.uint32)
        all_rows = np.concatenate(rows_of[::-1]) if words else np.empty(0, np.int64)
        out = []
        for r in range(rows):
            marks = range(int(-(-n[r] // (LANES * CHECK_STEPS))))
            points = np.empty((len(marks), LANES + 1), np.uint64)
            for k in marks:
                points[k, 0], points[k, 1:] = before[k * CHECK_STEPS, r], states[k][r]
            out.append((points, all_words[all_rows == r]))
        return out

    def decode(self, coded: list[tuple[int, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
        """Ids of blocks given as (tokens, checkpoints, words); all parts of all blocks are decoded side by side."""
        part = LANES * CHECK_STEPS
        x = np.concatenate([p[:, 1:] for _, p, _ in coded])
        base = np.cumsum([0, *(len(w) for _, _, w in coded)])
        at = np.concatenate([p[:, 0].astype(np.int64) + base[i] for i, (_, p, _) in enumerate(coded)])
        n = np.concatenate([np.minimum(part, total - part * np.arange(len(p))) for total, p, _ in coded])
        words = np.concatenate([*(w for _, _, w in coded), np.zeros(1, np.uint32)]).astype(np.uint64)
        steps, lane, thirty_two = int(-(-n.max(initial=0) // LANES)), np.arange(LANES), np.uint64(32)
        out = np.empty((len(n), steps, LANES), np.uint32)
        for t in range(steps):
            slot = x & self.mask
            s = self.symbol[slot.astype(np.int64)]
            out[:, t] = s
            x = self.freq[s] * (x >> self.bits) + slot - self.cum[s]
            need = (x < LOW) & (n[:, None] > t * LANES + lane)
            place = np.where(need, at[:, None] + np.cumsum(need, 1) - 1, len(words) - 1)
            x = np.where(need, (x << thirty_two) | words[place], x)
            at = at + need.sum(1)
        ids, row = [], 0
        for total, p, _ in coded:
            ids.append(out[row : row + len(p)].reshape(-1)[:total] if len(p) == 1 else np.concatenate([*(out[row + k].reshape(-1) for k in range(len(p))), np.empty(0, np.uint32)])[:total])
            row += len(p)
        return ids

    def pack(self, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, points: np.ndarray, words: np.ndarray) -> bytes:
        known = np.array([d is not None for d in doc_ids], np.uint8)
        numbers = np.array([d or 0 for d in doc_ids], "<i8")
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        body = b"".join([known.tobytes(), numbers.tobytes(), lengths.astype("<u4").tobytes(), points.astype("<u8").tobytes(), words.astype("<u4").tobytes()])
        return HEADER.pack(MAGIC, len(doc_ids), len(ids), len(words), len(points), int(self.bits), crc, zlib.crc32(body)) + body

    def unpack(self, payloads: list[bytes]) -> list[tuple[list[int | None], np.ndarray, np.ndarray]]:
        """Per block: document ids, their lengths, the ids of all of them."""
        heads, coded = [], []
        for p in payloads:
            magic, docs, total, n_words, n_points, bits, crc, body_crc = HEADER.unpack_from(p)
            if magic != MAGIC or bits != int(self.bits):
                raise ValueError("not a block of this format and table")
            if zlib.crc32(memoryview(p)[HEADER.size :]) != body_crc:
                raise ValueError("a block is damaged")
            at = HEADER.size
            known = np.frombuffer(p, np.uint8, docs, at)
            numbers = np.frombuffer(p, "<i8", docs, at + docs)
            lengths = np.frombuffer(p, "<u4", docs, at + 9 * docs)
            at += 13 * docs
            points = np.frombuffer(p, "<u8", n_points * (LANES + 1), at).reshape(n_points, LANES + 1)
            coded.append((total, points, np.frombuffer(p, "<u4", n_words, at + points.nbytes)))
            heads.append(([d if k else None for d, k in zip(numbers.tolist(), known)], lengths, crc))
        out = []
        for (doc_ids, lengths, crc), ids in zip(heads, self.decode(coded)):
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise ValueError("a block's checksum differs")
            out.append((doc_ids, lengths, ids))
        return out


IDS_SCHEMA = "doc_id long, row long, two boolean, ids binary"


def tokenise(docs: DataFrame, tokenizer: str, style: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, two, ids): each text's ids and the end id, little-endian, of two bytes each if ``two``, else four."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens.encoder(tokenizer, style)
        end, two = np.array([end_id], own.dtype).tobytes(), own.dtype.itemsize == 2
        at = TaskContext.get().partitionId() << 36
        for whole in batches:
            for b in (whole.slice(i, 1000) for i in range(0, whole.num_rows, 1000)):
                ids = [i + end for i in own.encode(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.arange(at, at + len(ids)), pa.int64()), pa.array([two] * len(ids)), pa.array(ids, pa.binary())], ["doc_id", "row", "two", "ids"])
                at += len(ids)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(of, IDS_SCHEMA)


def _wide(two: pa.Array, ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(i, "<u2" if t else "<u4") for t, i in zip(two.to_pylist(), ids.to_pylist())]


def write(ids: DataFrame, path: str, scale_bits: int = 20) -> None:
    """Write a table of ``tokenise`` as files below ``path``: ``path/table`` and ``path/blocks``."""
    spark = ids.sparkSession
    kept, kept_path = scratch.table(ids, "ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for b in batches:
            new = np.bincount(np.concatenate([np.empty(0, np.int64), *_wide(b.column(0), b.column(1))]).astype(np.int64))
            n = np.pad(n, (0, max(0, len(new) - len(n)))) + np.pad(new, (0, max(0, len(n) - len(new))))
        there = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["id", "n"])

    # At most one row for each id of the vocabulary comes to the driver.
    pairs = kept.select("two", "ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max([r.id for r in pairs], default=-1) + 1, np.int64)
    for r in pairs:
        counts[r.id] = r.n
    freq = scaled(counts, scale_bits)
    spark.createDataFrame([(scale_bits, freq.astype("<u8").tobytes())], "scale_bits int, freq binary").coalesce(1).write.parquet(f"{path}/table")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, segment, number, before = Coder(freq, scale_bits), TaskContext.get().partitionId(), 0, 0
        blocks: list[tuple[list[int | None], list[np.ndarray]]] = []
        names, own, size = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal number, before
            whole = [np.concatenate(i) for _, i in blocks]
            payloads, starts = [], []
            for (docs, parts), i, (points, words) in zip(blocks, whole, coder.encode(whole)):
                payloads.append(coder.pack(docs, np.array([len(p) for p in parts]), i, points, words))
                starts.append(before)
                before += len(i)
            k = len(blocks)
            out = pa.RecordBatch.from_arrays(
                [pa.array([segment] * k, pa.int32()), pa.array(range(number, number + k), pa.int32()), pa.array(starts, pa.int64()), pa.array([len(d) for d, _ in blocks], pa.int32()), pa.array([len(i) for i in whole], pa.int64()), pa.array(payloads, pa.binary())],
                ["segment", "block", "before", "n_docs", "n_tokens", "payload"],
            )
            number += k
            blocks.clear()
            return out

        for b in batches:
            for name, i in zip(b.column(0).to_pylist(), _wide(b.column(2), b.column(3))):
                names.append(name)
                own.append(i)
                size += len(i)
                if size >= BLOCK_TOKENS:
                    blocks.append((names, own))
                    names, own, size = [], [], 0
                    if len(blocks) == TOGETHER:
                        yield flush()
        if names:
            blocks.append((names, own))
        if blocks:
            yield flush()

    ordered = kept.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
    ordered.mapInArrow(coded, FILE_SCHEMA).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(spark, kept_path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, ids (binary, little-endian unsigned 32-bit), from the files alone."""
    table = spark.read.parquet(f"{path}/table").first()
    freq, scale_bits = np.frombuffer(table.freq, "<u8"), table.scale_bits
    blocks = spark.read.schema(FILE_SCHEMA).parquet(f"{path}/blocks")
    # One row for each segment, that is for each task that wrote.
    sizes = blocks.groupBy("segment").agg(F.sum("n_tokens").alias("n")).orderBy("segment").collect()
    base = dict(zip([r.segment for r in sizes], np.cumsum([0, *(r.n for r in sizes)]).tolist()))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq, scale_bits)
        for whole in batches:
            for b in (whole.slice(i, TOGETHER) for i in range(0, whole.num_rows, TOGETHER)):
                rows = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), coder.unpack(b.column(2).to_pylist()))
                for segment, before, (doc_ids, lengths, ids) in rows:
                    ends = np.cumsum(lengths.astype(np.int64))
                    raw = memoryview(ids.astype("<u4").tobytes())
                    own = [bytes(raw[4 * a : 4 * e]) for a, e in zip((ends - lengths).tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, pa.int64()), pa.array(base[segment] + before + ends - lengths), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(i) for i in own], pa.int64()), pa.array(own, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                    )

    return blocks.select("segment", "before", "payload").mapInArrow(of, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
