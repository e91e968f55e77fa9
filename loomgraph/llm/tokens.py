"""Token ids by the tokenizers library, each distinct unit of text encoded once per worker.

A text is cut only where the tokenizer's own pre-tokenisation is sure to cut, whatever stands around, so the ids of
the units joined are the ids of the text:

* ``words``: tokenizers that drop white space. Between two units stands a space, tab, line feed or carriage return.
* ``spaced``: byte-level ones, whose pieces may start with white space but never contain it after other
  characters. A unit starts at white space that follows a character other than white space. Texts with the
  separators U+001C to U+001F, on which regular-expression libraries differ, go to the library whole.

Plain texts (printable ASCII, spaces, line feeds and Latin-1 letters alone, for which the classes of the tokenizer's
pattern are plain) are cut into the pattern's pieces by arrays of character classes, a batch at a time; Arrow numbers the
pieces and only distinct ones are looked up. All other texts are cut into chunks at white space. A text that holds
the string of an added (special) token goes to the library whole, which finds such tokens before anything else. Pieces
and chunks that the worker has not met are encoded by the library in one call per batch.

A cache has two generations: when the young one is full it becomes the old one, so units in use are kept and the others go.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

from loomgraph.llm import worker

#: Units in a generation of a cache, unless the operator says otherwise.
MOST_UNITS = 400_000
#: Longer units are encoded but not kept.
LONG_UNIT = 200
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
_RUN = re.compile(r"\s\s")
_RUN_BEFORE_SPACE = re.compile(r"\s ")
_CHUNK = re.compile(r"\s*\S+|\s+\Z")
_PLAIN = re.compile("[\n !-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*")
END, SPACE, NEWLINE, LETTER, DIGIT, OTHER = range(6)
#: Classes of the bytes of plain texts in Latin-1, a zero standing after each text.
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0], _CLASS[32], _CLASS[10], _CLASS[48:58] = END, SPACE, NEWLINE, DIGIT
_CLASS[65:91] = _CLASS[97:123] = _CLASS[192:] = LETTER
_encoders: dict[tuple[str, str, int | None], TextEncoder] = {}


class _Known(dict):
    """Ids by unit; a unit of the old generation becomes young again, one that is not known is noted and None."""

    def __init__(self, most: int):
        self.most = most
        self.old: dict[str | bytes, bytes] = {}
        self.unknown: list[str | bytes] = []

    def __missing__(self, unit: str | bytes) -> bytes | None:
        ids = self.old.get(unit)
        if ids is None:
            self.unknown.append(unit)
        else:
            self[unit] = ids
        return ids

    def keep(self, units: list[str | bytes], ids: list[bytes]) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        self.update((u, i) for u, i in zip(units, ids) if len(u) <= LONG_UNIT)


def pieces(data: np.ndarray, style: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all pieces, where each begins among them, and the pieces up to the end of each text.

    ``data`` are plain texts in Latin-1, each with a zero behind it. The pieces are those of the pattern of contractions,
    runs of letters, of digits (one by one in ``words``) and of other signs, a space before a run going with it in ``spaced``.
    """
    kind = _CLASS[data]
    before = np.concatenate([np.zeros(1, np.uint8), kind[:-1]])
    start = kind != before
    start[0] = True
    if style == "words":
        start |= kind == DIGIT
        kept = kind > NEWLINE
    else:
        start &= before != SPACE
        kept = kind != END
    quote = np.flatnonzero((data == 39) & start)
    if len(quote):  # 's 't 'm 'd 're 've 'll are pieces where a piece begins with them
        one = data[quote + 1]
        two = data[np.minimum(quote + 2, len(data) - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[quote[short | long] + 1] = False
        start[quote[short] + 2] = True
        start[quote[long] + 3] = True
    start &= kept
    at = np.flatnonzero(start)
    return data[kept], (np.cumsum(kept) - 1)[at], np.searchsorted(at, np.flatnonzero(kind == END))


class TextEncoder:
    """``encode``: the ids of each text, as the library gives them without adding special tokens.

    They are little-endian unsigned integers of two bytes if the vocabulary allows it, else of four: ``dtype``.
    """

    def __init__(self, path: str, style: str, most_units: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.merging = Tokenizer(self.library.model)  # for pieces, which need no more cutting
        self.merging.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        added = self.library.get_added_tokens_decoder().values()
        case = re.IGNORECASE if any(t.normalized for t in added) else 0  # others are looked for in the text as it is
        self.special = re.compile("|".join(re.escape(t.content) for t in added), case) if added else None
        self.style = style
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        most = MOST_UNITS if most_units is None else most_units
        self.pieces, self.chunks = _Known(most), _Known(most)

    def _ids(self, library, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            return [text]
        if self.style == "words":
            return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        if _SEPARATORS.search(text):
            return [text]
        if _RUN_BEFORE_SPACE.search(text) or "\0" in text:
            return _CHUNK.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def _by_chunk(self, texts: list[list[str]]) -> list[bytes]:
        """The ids of texts given as chunks, each looked up once; those not known are encoded together and filled in."""
        known = self.chunks
        known.unknown = []
        found = [[*map(known.__getitem__, u)] for u in texts]
        if known.unknown:
            distinct = list(dict.fromkeys(known.unknown))
            ids = self._ids(self.library, distinct)
            new = dict(zip(distinct, ids))
            late = iter(known.unknown)
            for row in found:  # unknown chunks stand in the order in which they were met
                if None in row:
                    row[:] = [new[next(late)] if i is None else i for i in row]
            known.keep(distinct, ids)
        return [*map(b"".join, found)]

    def _by_piece(self, texts: list[str]) -> list[bytes]:
        """The ids of plain texts."""
        if not texts:
            return []
        data, begins, stops = pieces(np.frombuffer(("\0".join(texts) + "\0").encode("latin-1"), np.uint8), self.style)
        if not len(begins):
            return [b""] * len(texts)
        offsets = np.append(begins, len(data)).astype(np.int64)
        numbered = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        known = self.pieces
        known.unknown = []
        found = [*map(known.__getitem__, numbered.dictionary.to_pylist())]
        if known.unknown:
            ids = self._ids(self.merging, [u.decode("latin-1") for u in known.unknown])
            late = iter(ids)
            found = [next(late) if i is None else i for i in found]
            known.keep(known.unknown, ids)
        table = np.frombuffer(b"".join(found), self.dtype)
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize
        begin = np.cumsum(size) - size
        index = numbered.indices.to_numpy()
        n = size[index]
        upto = np.concatenate([[0], np.cumsum(n)])
        raw = memoryview(table[np.arange(int(upto[-1])) + np.repeat(begin[index] - upto[:-1], n)].tobytes())
        ends = (upto[stops] * self.dtype.itemsize).tolist()
        return [bytes(raw[a:e]) for a, e in zip([0, *ends], ends)]

    def _is_plain(self, text: str) -> bool:
        if not _PLAIN.fullmatch(text) or self.special and self.special.search(text):
            return False
        return self.style == "words" or not _RUN.search(text)

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        worker.trim()
        texts = [t or "" for t in texts]
        plain = [*map(self._is_plain, texts)]
        by_piece = iter(self._by_piece([t.lower() if self.style == "words" else t for t, p in zip(texts, plain) if p]))
        by_chunk = iter(self._by_chunk([self._chunks(t) if t else [] for t, p in zip(texts, plain) if not p]))
        return [next(by_piece if p else by_chunk) for p in plain]


def encoder(path: str, style: str, most_units: int | None = None) -> TextEncoder:
    """This worker's encoder for a tokenizer file."""
    worker.claim("tokens")
    key = path, style, most_units
    if key not in _encoders:
        _encoders[key] = TextEncoder(*key)
    return _encoders[key]


worker.cache("tokens", _encoders.clear)
