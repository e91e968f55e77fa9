"""Exact duplicates by a tree merge of sorted digest runs.

Every partition of the corpus is reduced to one sorted run of ``(digest, check, best row, count)`` records, one
record per distinct text. Runs then meet in rounds, as in a binomial exchange: slots are numbered in base
``fan_in`` and round r replaces digit r of a run's slot by digit r of the digests, so each slot receives the
matching pieces of ``fan_in`` runs, merges them and keeps one record per text. After ``log(slots)`` rounds the
slot number is the digest's own prefix and all copies of a text have met, yet no task ever saw more than its share
of *distinct* texts: a text that makes up a third of the corpus is one record per run from the first round on.

A record is verified at each merge: equal SHA-256 digests must also agree in byte length and in an independent
64-bit BLAKE2 check; records that disagree are kept apart as different texts.

Results for odd input: a null text counts as empty; the empty text is a text like any other, so all empty
documents are one group; a null ``doc_id`` is smaller than any other, and a group of which all ids are null has a
null ``keep_id``; of rows that repeat both id and text exactly one is ``kept``; an empty table gives an
empty result; columns other than the two named are neither read nor returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import sliced, worker
from loomgraph.plans import scratch

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
NO_ID = -(1 << 63)
RECORD = np.dtype([("digest", "S32"), ("check", "<u8"), ("bytes", "<i8"), ("id", "<i8"), ("row", "<i8"), ("count", "<i8")])
#: Groups with at least this share of all rows are joined by broadcast; by arithmetic there are at most so many.
MOST_HOT = 1000


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, digest, check, bytes) of every row; ``row`` tells rows of one run of this function apart."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.claim("digests")
        part, at = TaskContext.get().partitionId() << 36, 0
        for b in batches:
            worker.trim()
            texts = [(t or b"").translate(LOWER) for t in b.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(np.arange(at, at + len(texts)) + part, pa.int64()),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little", signed=True) for t in texts], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["doc_id", "row", "digest", "check", "bytes"],
            )
            at += len(texts)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(of, "doc_id long, row long, digest binary, check long, bytes long")


def _merge(records: np.ndarray, keep: str) -> np.ndarray:
    """One record per text, sorted by digest; timsort finds the sorted runs in ``records`` and merges them."""
    if not len(records):
        return records
    records = records[np.argsort(records["digest"], kind="stable")]
    same = records[1:]["digest"] == records[:-1]["digest"]
    if not same.any():
        return records
    # Equal digests must agree in length and check; within such a text the row that stays comes first.
    best = records["id"] if keep == "min" else ~records["id"]
    run = np.cumsum(np.r_[True, ~same])
    order = np.lexsort((records["row"], best, records["bytes"], records["check"], run))
    records, run = records[order], run[order]
    first = np.r_[True, (run[1:] != run[:-1]) | (records["check"][1:] != records["check"][:-1]) | (records["bytes"][1:] != records["bytes"][:-1])]
    out = records[first]
    out["count"] = np.add.reduceat(records["count"], np.flatnonzero(first))
    return out


def _digit(records: np.ndarray, r: int, bits: int) -> np.ndarray:
    """Digit r of the digests, in base 2**bits, from their first eight bytes."""
    raw = np.frombuffer(np.ascontiguousarray(records["digest"]).tobytes(), np.uint8).reshape(-1, 32)
    head = np.ascontiguousarray(raw[:, :8]).view(">u8").ravel()
    return ((head >> np.uint64(64 - bits * (r + 1))) & np.uint64((1 << bits) - 1)).astype(np.int64)


def merge_runs(rows: DataFrame, slots: int, fan_in: int = 8, keep: str = "max") -> DataFrame:
    """(digest, check, bytes, keep_id, keep_row, group_size) of every text in a table of ``digests``."""
    bits = fan_in.bit_length() - 1
    if 1 << bits != fan_in:
        raise ValueError("fan_in must be a power of two")
    rounds = 1
    while fan_in**rounds < slots:
        rounds += 1
    slots = fan_in**rounds

    def send(records: np.ndarray, slot: int, r: int) -> Iterator[pa.RecordBatch]:
        """The pieces of a run, by the slot that each goes to in round r."""
        digit, place = _digit(records, r, bits), fan_in ** (rounds - 1 - r)
        base = slot - slot // place % fan_in * place
        to, runs = [], []
        for d in np.unique(digit):
            to.append(int(base + d * place))
            runs.append(records[digit == d].tobytes())
        if to:
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array(runs, pa.binary())], ["slot", "run"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, waiting, size = np.empty(0, RECORD), [], 0
        for b in batches:
            worker.trim()
            new = np.empty(b.num_rows, RECORD)
            new["digest"] = np.array(b.column(2).to_pylist(), "S32")
            new["check"] = b.column(3).to_numpy(zero_copy_only=False).view(np.uint64)
            new["bytes"], new["row"], new["count"] = b.column(4).to_numpy(), b.column(1).to_numpy(), 1
            new["id"] = b.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            waiting.append(new)
            size += len(new)
            if size > len(own):  # so a record is merged again only when the run has doubled
                own, waiting, size = _merge(np.concatenate([own, *waiting]), keep), [], 0
        own = _merge(np.concatenate([own, *waiting]), keep)
        yield from send(own, TaskContext.get().partitionId() % slots, 0)

    def gathered(batches: Iterator[pa.RecordBatch]) -> dict[int, list[np.ndarray]]:
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for slot, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(slot, []).append(np.frombuffer(run, RECORD))
        return by

    def middle(r: int):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for slot, runs in gathered(batches).items():
                yield from send(_merge(np.concatenate(runs), keep), slot, r)

        return step

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for runs in gathered(batches).values():
            m = _merge(np.concatenate(runs), keep)
            raw = m["digest"].astype("S32").tobytes()
            ids = pa.array(np.ascontiguousarray(m["id"]), mask=m["id"] == NO_ID)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([raw[i : i + 32] for i in range(0, len(raw), 32)], pa.binary()),
                    pa.array(np.ascontiguousarray(m["check"]).view(np.int64)),
                    pa.array(np.ascontiguousarray(m["bytes"])),
                    ids,
                    pa.array(np.ascontiguousarray(m["row"])),
                    pa.array(np.ascontiguousarray(m["count"])),
                ],
                ["digest", "check", "bytes", "keep_id", "keep_row", "group_size"],
            )

    runs = rows.select("doc_id", "row", "digest", "check", "bytes").mapInArrow(first, "slot int, run binary")
    for r in range(1, rounds):
        runs = runs.repartitionById(slots, F.col("slot")).mapInArrow(middle(r), "slot int, run binary")
    return runs.repartitionById(slots, F.col("slot")).mapInArrow(last, "digest binary, check long, bytes long, keep_id long, keep_row long, group_size long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", fan_in: int = 8) -> DataFrame:
    """Per row: doc_id, keep_id, group_size, kept, text_sha256. ``keep``: which id of a group stays, max or min.

    The digests (some 60 bytes a row) are written once to the shared folder; texts are read once and never moved.
    """
    spark = docs.sparkSession
    rows = scratch.save(digests(docs, id_col, text_col), "digests")
    n = rows.count()
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    groups = scratch.save(merge_runs(rows, slots, fan_in, keep).filter("group_size > 1"), "groups")
    key = ["digest", "check", "bytes"]
    hot_size = max(2, n // MOST_HOT)
    hot = F.broadcast(groups.filter(F.col("group_size") >= hot_size))  # at most MOST_HOT rows, or all of a small table
    cold = groups.filter(F.col("group_size") < hot_size)
    found = rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
    alone = F.col("group_size").isNull()
    return found.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def normalised_sha256(text) -> F.Column:
    """The same digest by SQL functions, for joins with a table that was not made by ``digests``."""
    upper = "".join(map(chr, range(65, 91)))
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), upper, upper.lower()).cast("binary"), 256)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows whose id has no copies pass as they are read; only the others are joined with the decisions. Of rows that
    repeat both id and text one stays (an aggregation over those few rows alone, if there are any).
    """
    decided = exact_groups(docs, id_col, text_col, keep).filter("group_size > 1")
    copies = scratch.save(decided.groupBy(F.col("doc_id").alias("_i"), F.col("text_sha256").alias("_s")).agg(F.max("kept").alias("_kept"), F.count("*").alias("_n")), "decided")
    own_id = F.col(f"`{id_col}`").cast("long")
    has_copies = sliced.among(copies.select("_i").filter("_i is not null"))(own_id)
    own = docs.filter(has_copies).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"), own_id.alias("_i"), normalised_sha256(F.col(f"`{text_col}`").cast("string")).alias("_s"))
    on = own["_i"].eqNullSafe(copies["_i"]) & (own["_s"] == copies["_s"])
    joined = own.join(copies, on, "left").select("_d", own["_i"].alias("_i"), own["_s"].alias("_s"), "_kept", "_n")
    out = docs.filter(~has_copies).unionByName(joined.filter("_kept is null or (_kept and _n = 1)").select("_d.*"))
    if copies.filter("_kept and _n > 1").limit(1).count():
        out = out.unionByName(joined.filter("_kept and _n > 1").groupBy("_i", "_s").agg(F.first("_d").alias("_d")).select("_d.*"))
    return out
