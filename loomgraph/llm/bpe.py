"""Byte-level BPE without regular expressions: scans over codepoint classes, then cached pair merging.

Pre-tokenisation. Every codepoint of a batch of texts becomes a class (letter, number, white space, apostrophe, other; white
space and apostrophes also say what follows them). A class is a function from the automaton's state before a
codepoint to the state after it, and functions compose associatively: blocks of 64 codepoints are composed side by side, a
logarithmic scan over the blocks gives the state at which each begins, and one more pass gives every codepoint's
state and with it whether a piece begins there. Text borders are constant functions.

Pieces are looked up in the worker's cache; a piece not in it is merged pair by pair, lowest rank first.
Decoding gathers the bytes of all ids at once from the vocabulary's bytes by offsets; ``offsets`` gives
where each id's bytes begin in the text's bytes.

Results for odd input: a null text counts as empty and has no ids; an empty table gives an empty result; repeated rows
are encoded each; columns other than the two named are not read. A codepoint that Unicode assigned after
this Python's tables counts as other.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import worker

BLOCK = 64
BATCH_CHARS = 2_000_000
MOST_PIECES = 1_000_000
LONG_PIECE = 64

# Classes of codepoints: what they are and, for white space and apostrophes, what follows.
LETTER, NUMBER, OTHER, ONE_MORE, TWO_MORE, SPACE_ON, SPACE_BEFORE, BLANK_BEFORE = range(8)
# States before a codepoint: nothing open, an open run of a kind, a space that joins what follows, white
# space that goes on, an apostrophe that takes one or two more letters.
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_SPACE, TAKE_ONE, TAKE_TWO = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a piece begins, by class (plus 8 for the first codepoint of a text) and state."""
    after = np.empty((16, 8), np.uint8)
    begins = np.ones((16, 8), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHERS}
    for c in range(8):
        for s in range(8):
            if s == TAKE_ONE:
                after[c, s], begins[c, s] = START, False
            elif s == TAKE_TWO:
                after[c, s], begins[c, s] = TAKE_ONE, False
            elif c in runs:
                after[c, s], begins[c, s] = runs[c], s not in (runs[c], AFTER_SPACE)
            elif c in (ONE_MORE, TWO_MORE):
                joins = s in (IN_OTHERS, AFTER_SPACE)
                after[c, s], begins[c, s] = IN_OTHERS if joins else TAKE_ONE if c == ONE_MORE else TAKE_TWO, not joins
            elif c == SPACE_ON:
                after[c, s], begins[c, s] = IN_SPACE, s != IN_SPACE
            else:
                after[c, s] = AFTER_SPACE if c == SPACE_BEFORE else START
    after[8:] = after[:8, :1]
    return after, begins


AFTER, BEGINS = _tables()
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 white space, of every codepoint."""
    global _kinds
    if _kinds is None:
        of = {"L": 0, "N": 1}
        table = np.array([of.get(unicodedata.category(chr(c))[0], 2) for c in range(0x110000)], np.uint8)
        table[[c for c in range(0x3001) if chr(c).isspace() and not 0x1C <= c <= 0x1F]] = 3
        _kinds = table
    return _kinds


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of each codepoint of texts that begin at ``starts``."""
    kind = kinds()[points]
    n = len(points)
    first = np.zeros(n + 2, bool)
    first[starts] = True
    first[n:] = True
    c = kind.copy()  # letter, number and other are their own classes
    blank = np.flatnonzero(kind == 3)
    next_kind = np.append(kind, 3)[blank + 1]
    on = (next_kind == 3) | first[blank + 1]
    c[blank] = np.where(on, SPACE_ON, np.where(points[blank] == 32, SPACE_BEFORE, BLANK_BEFORE))
    mark = np.flatnonzero(points == 39)
    wide = np.concatenate([points, np.zeros(2, points.dtype)])
    a = np.where(first[mark + 1], 0, wide[mark + 1])
    b = np.where(first[mark + 1] | first[np.minimum(mark + 2, n)], 0, wide[mark + 2])
    s, t, m, d, r, e, v, l = (ord(x) for x in "stmdrevl")  # noqa: E741
    one = (a == s) | (a == t) | (a == m) | (a == d)
    two = ((a == r) & (b == e)) | ((a == v) & (b == e)) | ((a == l) & (b == l))
    c[mark] = np.where(one, ONE_MORE, np.where(two, TWO_MORE, OTHER))
    c[starts] += 8
    return c


def boundaries(c: np.ndarray) -> np.ndarray:
    """Where pieces begin, from classes of which the first is a text's first."""
    n = len(c)
    rows = -(-n // BLOCK)
    padded = np.full(rows * BLOCK, OTHER, np.uint8)
    padded[:n] = c
    grid = np.ascontiguousarray(padded.reshape(rows, BLOCK).T).astype(np.int64)
    flat = AFTER.ravel()
    f = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for j in range(BLOCK):  # every block's function, all blocks side by side
        f = flat[(grid[j] * 8)[:, None] + f]
    step = 1
    while step < rows:  # composed with the functions of all blocks before
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.int64), 1)
        step *= 2
    state = np.concatenate([np.zeros(1, np.uint8), f[:-1, START]])
    out = np.empty((BLOCK, rows), bool)
    starts = BEGINS.ravel()
    for j in range(BLOCK):
        at = grid[j] * 8 + state
        out[j] = starts[at]
        state = flat[at]
    out[:, 0][0] = True
    first = np.ascontiguousarray(out.T).ravel()[:n]
    return np.flatnonzero(first | (c >= 8))


class Bpe:
    """A vocabulary of byte strings by rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        words = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for word, rank in self.ranks.items():
            words[rank] = word
        self.bytes = np.frombuffer(b"".join(words), np.uint8)
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.cache: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece: the adjacent pair of lowest rank is merged, leftmost first, until none has a rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        end = list(range(1, n + 1))  # where the part that begins here ends; 0 once it has been merged away
        before = list(range(-1, n - 1))
        ranks = self.ranks
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] - i != size:
                continue
            end[i], end[j] = end[j], 0
            e = end[i]
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e] - i))
            if (p := before[i]) >= 0 and (r := ranks.get(piece[p:e])) is not None:
                heapq.heappush(heap, (r, p, e - p))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        lengths = np.array([len(t) for t in texts], np.int64)
        begin = np.cumsum(lengths) - lengths
        joined = "".join(texts)
        if not joined:
            return [b""] * len(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = boundaries(classes(points, begin[lengths > 0]))
        ends = np.append(starts[1:], len(points))
        pieces = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.cache) > MOST_PIECES:
            self.cache.clear()
        found = self.cache
        unseen = set(pieces) - found.keys()
        new = {p: np.array(self.merge(p.encode()), "<u4").tobytes() for p in unseen}
        if any(len(p) > LONG_PIECE for p in new):
            found.update((p, i) for p, i in new.items() if len(p) <= LONG_PIECE)
            found = {**found, **new}
        else:
            found.update(new)
        get = found.__getitem__
        cuts = np.searchsorted(starts, np.append(begin, len(points))).tolist()
        return [b"".join(map(get, pieces[a:b])) for a, b in zip(cuts, cuts[1:])]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each id's bytes begin in the decoded bytes, and their end."""
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(self.lengths[ids])])

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        at = self.offsets(ids)
        shift = np.repeat(self.places[ids] - at[:-1], self.lengths[ids])
        return self.bytes[shift + np.arange(at[-1])].tobytes()


_vocabularies: dict[str, Bpe] = {}


def vocabulary(path: str) -> Bpe:
    """This worker's vocabulary."""
    worker.claim("bpe")
    if path not in _vocabularies:
        _vocabularies[path] = Bpe(path)
    return _vocabularies[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, ids (binary), decoded (binary): the ids and the bytes they decode to."""
    kinds_of = "doc_id long, ids binary, decoded binary"

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, decoded in _encoded(batches, path):
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return _texts(docs, id_col, text_col).mapInArrow(of, kinds_of)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256; ids and bytes stay in the task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_ids, ids, decoded in _encoded(batches, path):
            shas = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (ids, decoded)]
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([len(i) // 4 for i in ids], pa.int64()), *shas], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(of, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    own = vocabulary(path)
    for b in batches:
        texts, at = b.column(1).to_pylist(), 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to] or "") <= BATCH_CHARS):
                size += len(texts[to] or "")
                to += 1
            ids = own.encode(texts[at:to])
            whole = own.decode(np.frombuffer(b"".join(ids), "<u4"))
            ends = own.offsets(np.frombuffer(b"".join(ids), "<u4"))[np.cumsum([0, *(len(i) // 4 for i in ids)])].tolist()
            yield b.column(0).slice(at, to - at), ids, [whole[a:e] for a, e in zip(ends, ends[1:])]
            at = to


worker.cache("bpe", _vocabularies.clear)
