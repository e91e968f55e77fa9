"""Exact Jaccard self-join of word n-gram sets by prefixes under several global orders, and its components.

A set is a document's distinct word n-grams as 64-bit hashes. Documents with the same set are one *rep*, known by a 64-bit
digest of the set. Two sets that link share at least o tokens (``Bounds.overlap``). Then, under *any* global order of the
tokens, the first ``n - o + l`` tokens of each share at least l of them, for every l; ``Bounds.least_shared`` chooses l,
some fortieth of the smaller set. So a pair is a candidate only if it does so under each of ``ORDERS`` orders, and these
filters are intersected, as counts of packed pairs, before any set is fetched for verification. The orders put rare
tokens first: a token's class is the logarithm of its count in a fixed-size counter array added up over all documents, and
within a class each order has its own hash.

1. The counters, and (document, digest, size), in one pass over the texts.
2. The prefixes under all orders are dealt out by token as packed blocks, each token with its place in the prefix. A token's
   rep pairs only with partners for whose size both places are early enough (``Bounds.reach``), so what stands behind
   the tokens in which documents differ makes no pairs, however many documents share it.
3. Where a token's reps meet, each is first paired with two leaders of its size class only. Candidates are verified on the
   whole sets, and components are made of the links.
4. Then the pairs of one token that are in *different* components, and these alone, are generated, intersected and verified in
   the same way: of each token's reps those outside its largest component, with all in reach. The components of all links.

So a group of g near copies costs some g pairs and not g * g, while no link between components is missed.

Words, n-grams and sets are known by 64-bit hashes, which are not verified: among n sets or n-grams the chance that any two
meet by accident is some n * n / 2**65, 10**-5 for 10**7 and 3 % for 10**9.

Results for odd input: a document without words (null, empty, white space) has n_shingles 0 and is linked with
nothing; one with fewer words than n has its whole sequence as its one n-gram; null ids take part, but do not name a
component that has another id; rows that repeat an id are documents each; an empty table gives an
empty result; columns other than the two named are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import sliced, worker
from loomgraph.llm.exact_dedup import LOWER, MOST_HOT
from loomgraph.plans import scratch
from loomgraph.plans.components import components

#: Counters of the order; bounded, so tokens in more than some millionth of all n-grams stand out at any size.
COUNTERS = 1 << 20
ORDERS = 3
#: A fortieth of the smaller set is asked for beyond the first shared token: more of it drops more pairs, but takes later places in.
BEYOND = 40
POSTING = np.dtype([("token", "<u8"), ("rep", "<i8"), ("n", "<u4"), ("at", "<u4")])
FLUSH = 1 << 19
#: Pairs made at a time.
MOST_PAIRS = 1 << 20
#: Bytes hashed at a time, and the base of the polynomial.
SEGMENT = 1 << 20
BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []
worker.cache("words", _powers.clear)


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    """Another hash of 64-bit hashes."""
    x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> list[np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if not _powers:
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            t = np.full(SEGMENT, base, np.uint64)
            t[0] = 1
            _powers.append(np.cumprod(t, dtype=np.uint64))
    return _powers


def _segment(data: np.ndarray) -> np.ndarray:
    """Hashes of the words of some bytes, of which at most the last word ends with them."""
    power, inverse = _tables()
    white = _WHITE[data]
    edge = np.flatnonzero(np.diff(white, prepend=True, append=True))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return np.empty(0, np.uint64)
    sums = (data.astype(np.uint64) + np.uint64(1)) * power[: len(data)]
    np.cumsum(sums, out=sums)
    before = np.where(begin > 0, sums[np.maximum(begin, 1) - 1], np.uint64(0))
    return mix((sums[end - 1] - before) * inverse[begin], 5)


def _long_word(data: np.ndarray) -> np.uint64:
    """The same hash of one word of any length."""
    power = _tables()[0]
    total, factor, step = 0, 1, int(power[-1]) * BASE
    for i in range(0, len(data), SEGMENT):
        part = data[i : i + SEGMENT]
        total += int(((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)]).sum(dtype=np.uint64)) * factor
        factor = factor * step & 0xFFFFFFFFFFFFFFFF
    return mix(np.array([total & 0xFFFFFFFFFFFFFFFF], np.uint64), 5)[0]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased and cut at ASCII white space, and how many each text has.

    A word's hash is a polynomial of its bytes, taken from running sums over whole segments of text at once.
    """
    worker.claim("words")
    raw = [t.encode() if t else b"" for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    data = np.frombuffer(b" ".join([*raw, b""]).translate(LOWER), np.uint8)
    white = _WHITE[data]
    firsts = np.flatnonzero(~white & np.concatenate([[True], white[:-1]])) if len(data) else np.empty(0, np.int64)
    counts = np.diff(np.searchsorted(firsts, np.concatenate([[0], ends])))
    parts, at = [], 0
    while at < len(data):
        stop = min(at + SEGMENT, len(data))
        if stop < len(data):
            gap = np.flatnonzero(white[at:stop])
            if not len(gap):  # one word longer than a segment
                stop += int(np.argmax(white[stop:]))
                parts.append(np.array([_long_word(data[at:stop])]))
                at = stop
                continue
            stop = at + int(gap[-1]) + 1
        parts.append(_segment(data[at:stop]))
        at = stop
    return np.concatenate([np.empty(0, np.uint64), *parts]), counts


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Each text's set of n-gram hashes, ascending."""
    hashes, counts = word_hashes(texts)
    factors = mix(np.arange(1, words + 1, dtype=np.uint64), 7) | np.uint64(1)
    n = len(hashes)
    sums = np.zeros(max(n - words + 1, 0), np.uint64)
    for j in range(words):
        sums += hashes[j : j + len(sums)] * factors[j]
    sums = mix(sums, 1)
    out, at = [], 0
    for c in counts.tolist():
        if c >= words:
            s = np.sort(sums[at : at + c - words + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif c:
            out.append(mix((hashes[at : at + c] * factors[:c]).sum(keepdims=True) + np.uint64(c), 2))
        else:
            out.append(np.empty(0, np.uint64))
        at += c
    return out


def digest(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=3) - (1 << 63)


class Bounds:
    """Integer bounds for Jaccard of at least num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n):
        return n - -(-self.num * n // self.den) + 1

    def overlap(self, a, b):
        """The least intersection of sets of a and b that link."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def shared_least(self, n):
        """The least intersection with the smallest set that can link."""
        return -(-self.num * n // self.den)

    def least_shared(self, a, b):
        """(o, l): sets of such sizes that link share o tokens, and l in their first n - o + l; the prefixes kept allow for that l."""
        o = self.overlap(a, b)
        l = np.minimum(1 + np.minimum(a, b) // BEYOND, o + 1 - np.maximum(self.shared_least(a), self.shared_least(b)))  # noqa: E741
        return o, np.maximum(l, 1)

    def reach(self, n, at):
        """The largest partner of which a token at a place of a set's prefix may be an early enough shared one."""
        return (self.num + self.den) * (n - at + n // BEYOND) // self.num - n

    def fit(self, a, b, at_a, at_b):
        """Whether sets of such sizes can link, and both places are within the first n - o + l tokens."""
        o, l = self.least_shared(a, b)  # noqa: E741
        sizes = self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)
        return sizes & (at_a <= a - o + l - 1) & (at_b <= b - o + l - 1)


class Order:
    """Global orders of tokens from the classes of their counters."""

    def __init__(self, classes: np.ndarray):
        self.classes = classes
        self.shift = np.uint64(64 - int(len(classes)).bit_length() + 1)

    def prefix(self, tokens: np.ndarray, k: int, size: int) -> np.ndarray:
        """The first ``size`` tokens under order k, in its order."""
        rank = self.classes[(tokens >> self.shift).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(tokens, 10 + k) >> np.uint64(8)
        first = np.argpartition(rank, size - 1)[:size] if size < len(tokens) else np.arange(len(tokens))
        return tokens[first[np.argsort(rank[first])]]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            worker.trim()
            yield b.slice(i, rows)


def _survey(texts: DataFrame, words: int) -> tuple[DataFrame, Order]:
    """(doc_id, rep, n) of every document, and the orders."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        shift = np.uint64(64 - COUNTERS.bit_length() + 1)
        for b in _parts(batches):
            sets = shingle_sets(b.column(1).to_pylist(), words)
            counters += np.bincount((np.concatenate(sets) >> shift).astype(np.int64), minlength=COUNTERS)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "rep", "n", "slice", "packed"])
        for k, packed in sliced.spread(counters):
            one = lambda t: pa.nulls(1, t)
            yield pa.RecordBatch.from_arrays([one(pa.int64()), one(pa.int64()), one(pa.int64()), pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["doc_id", "rep", "n", "slice", "packed"])

    both = scratch.save(texts.mapInArrow(of, "doc_id long, rep long, n long, slice int, packed binary"), "survey")
    classes = sliced.total(both.filter("slice is not null").select("slice", "packed"), COUNTERS, lambda s: np.log2(np.maximum(s, 1).astype(np.float64)))
    return both.filter("slice is null").select("doc_id", "rep", "n"), Order(classes)


def _columns(rows: np.ndarray) -> bytes:
    """Packed column by column and byte by byte, to be smaller."""
    return zlib.compress(rows.view(np.uint8).reshape(len(rows), -1).T.tobytes(), 1)


def _rows(packed: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _packed_runs(rows: np.ndarray) -> bytes:
    """Postings that stand together by rep: each rep and size once with its number of postings, then their tokens and places."""
    first = np.flatnonzero(np.concatenate([[True], rows["rep"][1:] != rows["rep"][:-1]]))
    own = [rows["rep"][first], rows["n"][first], np.diff(np.append(first, len(rows))).astype("<u4"), rows["token"], rows["at"]]
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T.tobytes() for c in own)
    return len(first).to_bytes(4, "little") + zlib.compress(body, 1)


def _runs(packed: bytes) -> np.ndarray:
    body, k = np.frombuffer(zlib.decompress(memoryview(packed)[4:]), np.uint8), int.from_bytes(packed[:4], "little")
    n, at, columns = (len(body) - 16 * k) // 12, 0, []
    for kind, length in (("<i8", k), ("<u4", k), ("<u4", k), ("<u8", n), ("<u4", n)):
        size = np.dtype(kind).itemsize * length
        columns.append(np.ascontiguousarray(body[at : at + size].reshape(-1, length).T).view(kind).ravel())
        at += size
    rows = np.empty(n, POSTING)
    rows["rep"], rows["n"] = np.repeat(columns[0], columns[2]), np.repeat(columns[1], columns[2])
    rows["token"], rows["at"] = columns[3], columns[4]
    return rows


def _useful(rows: np.ndarray, bounds: Bounds) -> np.ndarray:
    """Of postings sorted by token, without repeated reps, those that may have a partner: one in reach, or one that reaches them."""
    rows = rows[np.lexsort((rows["n"], rows["token"]))]
    if len(rows) < 2:
        return rows[:0]
    n, same = rows["n"].astype(np.int64), rows["token"][1:] == rows["token"][:-1]
    wide = np.int64(1) << np.int64(33)
    token = np.cumsum(np.concatenate([[False], ~same])) * wide
    reach = np.clip(bounds.reach(n, rows["at"].astype(np.int64)), 0, wide - 1)
    keep = np.zeros(len(rows), bool)
    keep[:-1] = same & (n[1:] <= reach[:-1])
    farthest = np.maximum.accumulate(token + reach)  # a token's keys are beyond all those before it
    keep[1:] |= same & (token[1:] + n[1:] <= farthest[:-1])
    two = np.flatnonzero(same & ~np.concatenate([[False], same[:-1]]) & ~np.concatenate([same[1:], [False]]))  # groups of two are judged exactly
    fits = _fitting(rows[two], rows[two + 1], bounds)
    keep[two], keep[two + 1] = fits, fits
    return rows[keep]


def _postings(texts: DataFrame, words: int, order, bounds: Bounds, blocks: int) -> DataFrame:
    """Blocks (block, posted) of postings sorted by token, for tokens that several reps have in their prefixes.

    The blocks of order k are those whose number leaves k when divided by ``ORDERS``.
    """
    each = max(1, blocks // ORDERS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen, tokens, reps, sizes, waiting = order.value, set(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting
            t, lengths = np.concatenate(tokens), np.array([len(x) for x in tokens])
            rows = np.empty(len(t), POSTING)
            ends = np.cumsum(lengths)
            rows["token"], rows["rep"], rows["n"], rows["at"] = t, np.repeat(reps, lengths), np.repeat(sizes, lengths), np.arange(len(t)) - np.repeat(ends - lengths, lengths)
            block = (t % np.uint64(each)).astype(np.int64) * ORDERS + np.repeat(np.arange(len(tokens)) % ORDERS, lengths)
            by = np.argsort(block, kind="stable")
            rows, block = rows[by], block[by]
            rows["token"] >>= np.uint64(16)  # the rest and the block tell tokens apart; two that meet by accident make a candidate more
            cuts = np.flatnonzero(np.diff(block)) + 1
            waiting = 0
            for x in (tokens, reps, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(block[np.concatenate([[0], cuts])].astype(np.int32)), pa.array([_packed_runs(p) for p in np.split(rows, cuts)], pa.binary())], ["block", "posted"])

        for b in _parts(batches):
            for s in shingle_sets(b.column(1).to_pylist(), words):
                if len(s) and (d := digest(s)) not in seen:
                    seen.add(d)
                    for k in range(ORDERS):
                        tokens.append(own.prefix(s, k, int(bounds.prefix(len(s)))))
                        reps.append(d)
                        sizes.append(len(s))
                        waiting += len(tokens[-1])
            if waiting >= FLUSH:
                yield flush()
        if waiting:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[bytes]] = {}
        for b in batches:
            for block, posted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by.setdefault(block, []).append(posted)
        for block in sorted(by):
            rows = np.concatenate([_runs(p) for p in by.pop(block)])
            rows = rows[np.argsort(rows["token"], kind="stable")]
            several = np.flatnonzero(np.diff(rows["token"], prepend=~rows["token"][:1]) == 0)
            keep = np.zeros(len(rows), bool)
            keep[several] = keep[several - 1] = True
            rows = rows[keep]
            rows = rows[np.lexsort((rows["rep"], rows["token"]))]
            new = np.concatenate([[True], (rows["token"][1:] != rows["token"][:-1]) | (rows["rep"][1:] != rows["rep"][:-1])])[: len(rows)]
            rows = rows[new]  # a rep of which several tasks had a copy
            rows = _useful(rows, bounds)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([_columns(rows)], pa.binary())], ["block", "posted"])

    schema = "block int, posted binary"
    return scratch.save(texts.mapInArrow(emit, schema).repartitionById(each * ORDERS, F.col("block")).mapInArrow(meet, schema), "postings")


PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("na", "<u4"), ("nb", "<u4"), ("order", "<u4"), ("shared", "<u4")])
PACKED = "kind int, block int, packed binary"


def _summed(rows: np.ndarray) -> np.ndarray:
    """One row for each (a, b, order) with the sum of ``shared``."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows["order"], rows["b"], rows["a"]))]
    first = np.flatnonzero(np.concatenate([[True], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1]) | (rows["order"][1:] != rows["order"][:-1])]))
    out = rows[first]
    out["shared"] = np.add.reduceat(rows["shared"], first)
    return out


def _pairs(x: np.ndarray, y: np.ndarray, order: int) -> np.ndarray:
    """Distinct pairs (a < b) of postings side by side, with the number of times that each occurs."""
    rows = np.empty(len(x), PAIR)
    swap = x["rep"] > y["rep"]
    for side, n, first, second in (("a", "na", x, y), ("b", "nb", y, x)):
        rows[side], rows[n] = np.where(swap, second["rep"], first["rep"]), np.where(swap, second["n"], first["n"])
    rows["order"], rows["shared"] = order, 1
    return _summed(rows)


def _fitting(x: np.ndarray, y: np.ndarray, bounds: Bounds) -> np.ndarray:
    return bounds.fit(*(p[c].astype(np.int64) for c in ("n", "at") for p in (x, y))) & (x["rep"] != y["rep"])


def _dealt(kind: int, rows: np.ndarray, block: np.ndarray) -> pa.RecordBatch:
    """Rows packed by the block that they go to."""
    by = np.argsort(block, kind="stable")
    rows, block = rows[by], block[by]
    cuts = np.flatnonzero(np.diff(block)) + 1
    parts = [p.tobytes() for p in np.split(rows, cuts)] if len(rows) else []
    blocks = block[np.concatenate([[0], cuts])] if len(rows) else block
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.int32()), pa.array(blocks.astype(np.int32)), pa.array(parts, pa.binary())], ["kind", "block", "packed"])


def _home(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(np.ascontiguousarray(keys).view(np.uint64), 8) % np.uint64(blocks)).astype(np.int64)


def _block_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _candidates(pairs: DataFrame, bounds: Bounds, leaders: bool = False) -> DataFrame:
    """(a, b) of the packed pairs whose prefixes share enough tokens under every order.

    Of pairs with ``leaders`` one token is enough, as a rep has other leaders at its other tokens.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [np.empty(0, PAIR)], 0
        for b in batches:
            for p in b.column(2).to_pylist():
                parts.append(np.frombuffer(p, PAIR))
                size += len(parts[-1])
                if size > MOST_PAIRS:
                    parts = [_summed(np.concatenate(parts))]
                    size = 0
        rows = _summed(np.concatenate(parts))
        na, nb = rows["na"].astype(np.int64), rows["nb"].astype(np.int64)
        least = bounds.least_shared(na, nb)[1]
        rows = rows[rows["shared"] >= (1 if leaders else least)]
        new = np.flatnonzero(np.concatenate([[True], (rows["a"][1:] != rows["a"][:-1]) | (rows["b"][1:] != rows["b"][:-1])])[: len(rows)])
        both = new[np.diff(np.append(new, len(rows))) == ORDERS]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows["a"][both])), pa.array(np.ascontiguousarray(rows["b"][both]))], ["a", "b"])

    return pairs.repartitionById(_block_count(pairs), F.col("block")).mapInArrow(of, "a long, b long")


def _answers(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """Packed (rep, component) for each block about its reps by ``labels`` (node, component).

    Reps ask by block where their labels are; only packed rows are dealt out. Reps without a label get no answer, and nearly
    none of them asks.
    """
    blocks = _block_count(postings)
    known = postings.sparkSession.sparkContext.broadcast(sliced.members(labels.select("node")))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, posted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                reps = np.unique(_rows(posted, POSTING)["rep"])
                reps = reps[sliced.holds(known.value, reps)]
                yield _dealt(1, np.column_stack([reps, np.full(len(reps), block)]), _home(reps, blocks))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps = np.ascontiguousarray(b.column(0).to_numpy())
            yield _dealt(0, np.column_stack([reps, b.column(1).to_numpy()]), _home(reps, blocks))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list[np.ndarray]] = {0: [np.empty((0, 2), np.int64)], 1: [np.empty((0, 2), np.int64)]}
        for b in batches:
            for kind, packed in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                got[kind].append(np.frombuffer(packed, np.int64).reshape(-1, 2))
        named, asked = np.concatenate(got[0]), np.concatenate(got[1])
        named = named[np.argsort(named[:, 0])]
        if len(named) and len(asked):
            place = np.minimum(np.searchsorted(named[:, 0], asked[:, 0]), len(named) - 1)
            there = named[place, 0] == asked[:, 0]
            yield _dealt(2, np.ascontiguousarray(named[place[there], :2]), asked[there, 1])

    questions = postings.mapInArrow(ask, PACKED).unionByName(labels.select("node", "component").mapInArrow(name, PACKED))
    return questions.repartitionById(blocks, F.col("block")).mapInArrow(answer, PACKED)


def _each_block(postings: DataFrame, labels: DataFrame, pairs_of: Callable[[np.ndarray, np.ndarray, int], Iterator[np.ndarray]]) -> DataFrame:
    """Packed pairs that ``pairs_of`` (components of the block's reps, postings, order) gives of each block."""
    blocks = _block_count(postings)
    both = _answers(postings, labels).unionByName(postings.select(F.lit(3).alias("kind"), "block", F.col("posted").alias("packed")))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known = None, np.empty((0, 2), np.int64)
        for b in batches:
            for kind, block, packed in zip(*(c.to_pylist() for c in b.columns)):
                if block != at:
                    at, known = block, np.empty((0, 2), np.int64)
                if kind == 2:  # a block's answers come before its postings
                    known = np.concatenate([known, np.frombuffer(packed, np.int64).reshape(-1, 2)])
                else:
                    for rows in pairs_of(known[np.argsort(known[:, 0])], _rows(packed, POSTING), block % ORDERS):
                        yield _dealt(0, rows, _home(rows["a"] * np.int64(3) + rows["b"], blocks))

    return both.repartition(blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(of, PACKED)


def _looked_up(known: np.ndarray, reps: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Values of ``known`` (rep, value), ascending, or else of ``other``."""
    if not len(known):
        return other
    place = np.minimum(np.searchsorted(known[:, 0], reps), len(known) - 1)
    return np.where(known[place, 0] == reps, known[place, 1], other)


def _with_leaders(postings: DataFrame, bounds: Bounds) -> DataFrame:
    """Each rep of a token with the leaders of its own size class and of the next smaller, as packed pairs.

    The first leader is the rep in whose prefix the token stands earliest: the text that others are edits of has no tokens of
    its own, which would stand before it. The second is the least under a hash, for groups without such a text.
    """
    blocks = _block_count(postings)

    def pairs(rows: np.ndarray, order: int) -> np.ndarray:
        _, token = np.unique(rows["token"], return_inverse=True)
        sizes = rows["n"].astype(np.int64)
        key = token.astype(np.int64) << 8 | np.floor(np.log(sizes) / np.log(bounds.den / bounds.num)).astype(np.int64)
        hashed = mix(np.ascontiguousarray(rows["rep"]).view(np.uint64), 50)
        me, lead = [], []
        for rank in ((hashed, rows["at"], key), (hashed, key)):
            by = np.lexsort(rank)
            own = key[by]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for below in (0, 1):
                to = first[np.minimum(np.searchsorted(own[first], own - below), len(first) - 1)]
                there = own[to] == own - below
                me.append(by[there])
                lead.append(by[to[there]])
        me, lead = np.concatenate(me), np.concatenate(lead)
        both = np.unique(np.minimum(me, lead) * len(rows) + np.maximum(me, lead))  # a token's two reps once, whichever leads
        x, y = rows[both // len(rows)], rows[both % len(rows)]
        fits = _fitting(x, y, bounds)
        return _pairs(x[fits], y[fits], order)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, posted in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = pairs(_rows(posted, POSTING), block % ORDERS)
                yield _dealt(0, found, _home(found["a"] * np.int64(3) + found["b"], blocks))

    return postings.mapInArrow(of, PACKED)


def _between(postings: DataFrame, labels: DataFrame, bounds: Bounds) -> DataFrame:
    """All pairs of one token's reps that are in different components, packed; ``labels``: (node, component), others are their own.

    Of each token the largest component's reps make no pairs among each other; every other rep is taken with all in its reach.
    """

    def of(known: np.ndarray, rows: np.ndarray, order: int) -> Iterator[np.ndarray]:
        rows = rows[np.lexsort((rows["n"], rows["token"]))]
        n = rows["n"].astype(np.int64)
        reach = bounds.reach(n, rows["at"].astype(np.int64))
        token = np.cumsum(np.diff(rows["token"], prepend=rows["token"][:1]) != 0)
        component = _looked_up(known, np.ascontiguousarray(rows["rep"]), np.ascontiguousarray(rows["rep"]))
        # The largest component of each token.
        by = np.lexsort((component, token))
        run = np.cumsum(np.concatenate([[True], (token[by][1:] != token[by][:-1]) | (component[by][1:] != component[by][:-1])])) - 1
        size = np.bincount(run)
        of_run = token[by][np.concatenate([[0], np.cumsum(size)[:-1]])]
        largest = np.zeros(len(size), bool)
        order_of = np.lexsort((-size, of_run))
        largest[order_of[np.concatenate([[True], of_run[order_of][1:] != of_run[order_of][:-1]])]] = True
        main = np.empty(len(rows), bool)
        main[by] = largest[run]
        # A pair is met from its smaller rep, whose partners are the following ones up to its reach: all of them if the rep is
        # outside the largest component, else those that are.
        wide = np.int64(1) << np.int64(33)
        key = token * wide + n
        upto = token * wide + np.clip(reach, 0, wide - 1)
        for mine, others in ((np.flatnonzero(~main), np.arange(len(rows))), (np.flatnonzero(main), np.flatnonzero(~main))):
            low = np.searchsorted(others, mine, "right")
            count = np.maximum(np.searchsorted(key[others], upto[mine], "right") - low, 0)
            total = np.cumsum(count)
            start = 0
            while start < len(mine):
                done = int(total[start - 1]) if start else 0
                stop = max(int(np.searchsorted(total, done + MOST_PAIRS, "right")), start + 1)
                k = count[start:stop]
                me = np.repeat(mine[start:stop], k)
                to = others[np.arange(len(me)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[start:stop], k)]
                differ = component[me] != component[to]
                x, y = rows[me[differ]], rows[to[differ]]
                fits = _fitting(x, y, bounds)
                if fits.any():
                    yield _pairs(x[fits], y[fits], order)
                start = stop

    return _each_block(postings, labels, of)


def _sets(texts: DataFrame, words: int, reps: DataFrame) -> DataFrame:
    """(rep, tokens) of at least the reps given, each once; what is not asked for is left out before anything is dealt out."""
    wanted = texts.sparkSession.sparkContext.broadcast(sliced.members(reps))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _parts(batches):
            rows = []
            found = shingle_sets(b.column(1).to_pylist(), words)
            own = np.array([digest(s) for s in found], np.int64)
            for d, s, there in zip(own.tolist(), found, sliced.holds(wanted.value, own)):
                if there and len(s) and d not in seen:
                    seen.add(d)
                    rows.append((d, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["rep", "tokens"])

    return texts.mapInArrow(of, "rep long, tokens binary").groupBy("rep").agg(F.first("tokens").alias("tokens"))


def _verified(texts: DataFrame, words: int, pairs: DataFrame, bounds: Bounds) -> DataFrame:
    """Of a written table of pairs (a, b) those that link.

    The sets are dealt out by rep once, for both joins. A rep with very many pairs is one side of an equi-join with one row
    for each key, which adaptive execution splits.
    """
    sets = _sets(texts, words, pairs.select("a", "b"))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches, 5000):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bounds.den * both >= bounds.num * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    first = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), F.col("tokens").alias("x")), "a")
    second = first.join(sets.select(F.col("rep").alias("b"), F.col("tokens").alias("y")), "b").select("a", "b", "x", "y")
    return second.mapInArrow(links, "a long, b long")


def _labelled(docs: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int) -> DataFrame:
    """Per row: doc_id, rep, n, component (a rep), component_id (an id); a row without words has no component."""
    spark = docs.sparkSession
    bounds = Bounds(num, den)
    texts = _texts(docs, id_col, text_col)
    surveyed, orders = _survey(texts, words)
    order = spark.sparkContext.broadcast(orders)
    postings = _postings(texts, words, order, bounds, _block_count(texts))
    order.unpersist()
    star = scratch.save(_candidates(_with_leaders(postings, bounds), bounds, leaders=True), "pairs")
    linked = scratch.save(_verified(texts, words, star, bounds), "links")
    rest = scratch.save(_candidates(_between(postings, components(linked), bounds), bounds), "pairs")
    more = scratch.save(_verified(texts, words, rest, bounds), "links")
    labels = components(linked.unionByName(more))

    # Documents of one rep are one node; the least id of each component is found over all of its documents.
    reps = scratch.save(surveyed.filter("n > 0").groupBy("rep").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "reps")
    placed = reps.join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = scratch.save(placed.join(least, "component").select("rep", "component", "component_id", "copies"), "named")
    hot_size = max(2, surveyed.count() // MOST_HOT)
    hot = F.broadcast(named.filter(F.col("copies") >= hot_size).select("rep", "component", "component_id"))  # at most MOST_HOT rows, or all of a small table
    cold = named.filter(F.col("copies") < hot_size).select("rep", "component", "component_id")
    with_words, without = surveyed.filter("n > 0"), surveyed.filter("n = 0").select("doc_id", "rep", "n", F.lit(None).cast("long").alias("component"), F.lit(None).cast("long").alias("component_id"))
    found = with_words.join(hot, "rep").unionByName(with_words.join(hot.select("rep"), "rep", "left_anti").join(cold, "rep"))
    return found.select("doc_id", "rep", "n", "component", "component_id").unionByName(without)


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, at a Jaccard similarity of at least num / den."""
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return _labelled(docs, id_col, text_col, words, num, den).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of a component one row, that with the least id.

    Where several rows of a component have that id, or none has an id, the one with the least digest of its set stays, and of rows
    that repeat both one. Rows without words stay.
    """
    found = scratch.save(_labelled(docs, id_col, text_col, words, num, den).filter("n > 0"), "labelled")
    key = [F.col("doc_id").alias("_i"), F.col("rep").alias("_r")]
    go = found.filter("component_id is not null and not doc_id <=> component_id").select(*key, F.lit(False).alias("_keep"))
    # Rows that share the component's id, and components without any id: the least digest stays.
    named = found.filter("doc_id = component_id").groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    unnamed = found.filter("component_id is null").groupBy(F.col("component").alias("_c")).agg(F.min("rep").alias("_best"), F.count("*").alias("_n")).filter("_n > 1")
    best = lambda rows, of: rows.join(of, F.col("component") == F.col("_c")).select(*key, (F.col("rep") == F.col("_best")).alias("_keep"))
    stay = best(found.filter("doc_id = component_id"), named).unionByName(best(found.filter("component_id is null"), unnamed))
    decided = scratch.save(go.unionByName(stay).groupBy("_i", "_r").agg(F.max("_keep").alias("_keep")), "decided")
    own_id = F.col(f"`{id_col}`").cast("long")
    maybe = sliced.among(decided.select("_i").filter("_i is not null"))(own_id)

    def digests(values: pa.Array) -> pa.Array:
        return pa.array([d for i in range(0, len(values), 1000) for s in shingle_sets(values.slice(i, 1000).to_pylist(), words) for d in [digest(s)]], pa.int64())

    digested = F.arrow_udf(digests, T.LongType()).asNondeterministic()  # once for each row, whatever is asked of it
    # Rows outside the filter stay without being dealt out.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d")
    own = docs.filter(maybe).select(whole, own_id.alias("_id"), digested(F.col(f"`{text_col}`").cast("string")).alias("_rep"))
    joined = own.join(decided, own["_id"].eqNullSafe(decided["_i"]) & (own["_rep"] == decided["_r"]), "left")
    out = docs.filter(~maybe).unionByName(joined.filter("_keep is null").select("_d.*"))
    if decided.filter("_keep").limit(1).count():  # of rows that repeat what stays, one
        out = out.unionByName(joined.filter("_keep").groupBy("_id", "_rep").agg(F.first("_d").alias("_d")).select("_d.*"))
    return out
