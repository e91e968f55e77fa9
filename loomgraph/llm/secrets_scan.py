"""Secret scans: an Aho-Corasick prefilter, anchored expressions near hits only, checksums where tokens carry them.

One automaton holds the keywords of all kinds (over the text with A-Z lower-cased). An expression is tried only at a place
where its keyword was hit, anchored there, and only if the kind's previous match has ended, which gives the
leftmost non-overlapping matches of a plain scan. Hexadecimal runs have no keyword: for them the text is mapped to two
classes and the prefilter looks for 24 class signs in a row. Added kinds (``github``, ``npm``) are tokens whose last six
characters are the base-62 CRC-32 of the thirty before them; a token counts only if they agree.

Results for odd input: a null text counts as empty and has no spans; an empty table gives an empty result; repeated
rows are scanned each; columns other than those named are returned by ``redact`` as they are and not
returned by ``scan``. Places are counted in code points.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import worker

#: In the order in which kinds at the same place are listed.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_KEYWORDS = {k: "assign" for k in ("password", "passwd", "secret", "token", "apikey", "api_key")} | {"akia": "access"} | {f"gh{k}_": "github" for k in "pousr"} | {"npm_": "npm"}
_LOWER = {c: c + 32 for c in range(65, 91)}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX_CLASS = bytes(ord("x") if chr(c) in "0123456789abcdef" else ord(".") for c in range(256))
LEAST = {"assign": 6, "access": 20, "hex": 24}
_automaton = None


def base62_crc(body: str) -> str:
    """CRC-32 of ASCII text in six base-62 digits."""
    n, out = zlib.crc32(body.encode("ascii")), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def _hits():
    global _automaton
    worker.claim("secrets")
    if _automaton is None:
        import ahocorasick

        _automaton = ahocorasick.Automaton()
        for word, kind in _KEYWORDS.items():
            _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind as in ``KINDS``."""
    if not text:
        return []
    spans = []
    ended = dict.fromkeys(KINDS, 0)
    lowered = text.lower() if text.isascii() else text.translate(_LOWER)
    starts = sorted((end - n + 1, kind) for end, (kind, n) in _hits().iter(lowered))
    for start, kind in starts:
        if start < ended[kind]:
            continue
        if kind == "assign":
            m = _ASSIGN.match(text, start)
        elif kind == "access":
            m = _ACCESS.match(text, start)
        else:
            m = _CHECKED.match(text, start)
            if not m or (start and text[start - 1].isalnum()) or base62_crc(m[0][4:34]) != m[0][34:]:
                continue
        if not m:
            continue
        ended[kind] = m.end()
        if kind not in LEAST or (len(m[1]) if kind == "assign" else m.end() - start) >= LEAST[kind]:
            spans.append((kind, start, m.end()))
    classes = text.encode("latin-1", "replace").translate(_HEX_CLASS)
    at = classes.find(b"x" * LEAST["hex"])
    while at >= 0:
        m = _HEX.match(text, at)
        spans.append(("hex", at, m.end()))
        at = classes.find(b"x" * LEAST["hex"], m.end())
    spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return spans


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worker.trim()
            rows = [find(t) for t in b.column(1).to_pylist()]
            base = [[s for s in r if s[0] in BASE] for r in rows]
            counts = [pa.array([sum(s[0] == k for s in r) for r in base], pa.int64()) for k in BASE]
            shas = [hashlib.sha256(joined(r).encode()).hexdigest() for r in base]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(shas, pa.string()), pa.array([joined(r) for r in rows], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(of, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str | None, mark: str = "[{kind}]") -> str | None:
    """The text with every span replaced; overlapping spans are replaced together under the first one's kind."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], mark.format(kind=kind)]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with secrets replaced by their kind in brackets; ``length_col``, if there, is the new length of changed texts."""
    names = docs.columns
    at = names.index(text_col)
    length_at = names.index(length_col) if length_col in names else None
    schema = docs.schema

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            worker.trim()
            old = b.column(at).to_pylist()
            new = [redacted(t) for t in old]
            columns = list(b.columns)
            columns[at] = pa.array(new, b.schema.field(at).type)
            if length_at is not None:
                lengths = [n if a is b2 else len(b2) for n, a, b2 in zip(b.column(length_at).to_pylist(), old, new)]
                columns[length_at] = pa.array(lengths, b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(of, schema)
