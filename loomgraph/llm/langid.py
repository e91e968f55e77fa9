"""Language identification by known words, backing off to shorter and shorter character n-grams.

The model is counted over a bounded sample of the labelled training rows: of each language about ``rows_per_lang`` rows,
those with the least hash of their id (all rows of a language that has fewer). Every language, every word and every
character n-gram (lengths ``LONGEST`` down to 1, with word boundaries) of the sample is in the model. Its size follows the
sample's and not the corpus's: counts are kept per unit for the languages that have it, so it is broadcast. A word in the model
adds its log frequency in each language; one that is not is covered from left to right by the longest n-gram
that the model knows at each place, down to single letters. The score is the share of the best language
among all, from the mean log frequency per word. Texts are predicted whole, words of any length too.

Results for odd input: a text that is null or has no letter is ``und`` with score 0, and so is every text if
nothing was learned; ties go to the language first in order; rows without a label or an id teach nothing, and are
predicted; rows that repeat an id are sampled together; an empty table gives an empty result; columns other than those
named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm import worker
from loomgraph.plans import scratch

LONGEST = 4
#: Labelled rows of each language that the model is learned from.
ROWS_PER_LANG = 1500
#: Longer words outside the model are judged anew each time they are met, and not remembered.
WORD_LETTERS = 64
#: Bytes of the judgements of words outside the model that a worker remembers, besides the words themselves.
MOST_REMEMBERED = 3 << 20
#: Words that a task counts before it passes the counts on.
COUNTED = 200_000
_WORD = re.compile(r"[^\W\d_]+")
#: Sharpness of the score; the prediction does not depend on it.
SHARPNESS = 4.0
FOLDS, HELD_OUT = 4, 2
#: The model that this worker used last.
_current: list[Model] = []


def _forget() -> None:
    for model in _current:
        model.forget()
    _current.clear()


worker.cache("langid", _forget)


def words(text: str | None) -> list[str]:
    """Runs of letters (and signs such as superscripts that stand with them); none if the text has no letter."""
    found = _WORD.findall(text.lower()) if text else []
    if found and not any(map(str.isalpha, found)) and not any(map(str.isalpha, text)):
        return []
    return found


def grams(word: str) -> Iterator[str]:
    """All character n-grams of a word between boundaries, longest first."""
    w = f"\x02{word}\x03"
    for n in range(LONGEST, 0, -1):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


class _Units:
    """Log frequencies of units per language: what a unit that a language lacks has there, and what each unit adds to it."""

    def __init__(self, langs: int, counts: list[tuple[int, str, int]]):
        names = sorted({unit for _, unit, _ in counts})
        self.index = dict(zip(names, range(len(names))))
        lang = np.array([c[0] for c in counts], np.int64)
        unit = np.array([self.index[c[1]] for c in counts], np.int64)
        n = np.array([c[2] for c in counts], np.float64)
        by = np.lexsort((lang, unit))
        self.lang, n = lang[by].astype(np.int32), n[by]
        self.begin = np.searchsorted(unit[by], np.arange(len(names) + 1))
        self.absent = np.log(0.5) - np.log(np.bincount(lang, n[np.argsort(by)], langs) + 0.5 * len(names) + 0.5)
        self.adds = np.log(n + 0.5) - np.log(0.5)

    def of(self, row: int) -> np.ndarray:
        out = self.absent.copy()
        a, e = self.begin[row], self.begin[row + 1]
        out[self.lang[a:e]] += self.adds[a:e]
        return out


class _Index(dict):
    """Rows by word; a word met for the first time gets the next row."""

    judged: Callable[[str], int]

    def __missing__(self, word: str) -> int:
        return self.judged(word)


class Model:
    """``counts`` of words and of n-grams: (language, unit, how often)."""

    def __init__(self, langs: list[str], word_counts: list[tuple[str, str, int]], gram_counts: list[tuple[str, str, int]]):
        self.langs = langs
        place = {lang: i for i, lang in enumerate(langs)}
        own = lambda counts: [(place[lang], unit, n) for lang, unit, n in counts]
        self.words = _Units(len(langs), own(word_counts))
        self.grams = [_Units(len(langs), own([g for g in gram_counts if len(g[1]) == n])) for n in range(1, LONGEST + 1)]
        self.unseen = np.full(len(langs), -20.0)
        self._ready()

    def _ready(self) -> None:
        self.known = len(self.words.index)
        self.rows = _Index(self.words.index)
        self.rows.judged = self.judged
        self.new, self.n_new = np.empty((1024, len(self.langs))), 0

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("langs", "words", "grams", "unseen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._ready()
        self.words.index = {}  # a worker needs it in ``rows`` alone

    def forget(self) -> None:
        """Empties what was remembered of words outside the model."""
        for word in [w for w, row in self.rows.items() if row >= self.known]:
            del self.rows[word]
        self.new, self.n_new = np.empty((1024, len(self.langs))), 0

    def of_unknown(self, word: str) -> np.ndarray:
        """Log frequency per language of the n-grams that cover a word: at each place the longest that is known."""
        w, at, total, n_logs = f"\x02{word}\x03", 0, np.zeros(len(self.langs)), 0
        while at < len(w):
            for n in range(min(LONGEST, len(w) - at), 0, -1):
                row = self.grams[n - 1].index.get(w[at : at + n])
                if row is not None:
                    break
            total += self.unseen if row is None else self.grams[n - 1].of(row)
            n_logs += 1
            at += n
        return total / n_logs

    def judged(self, word: str) -> int:
        """The row of a word outside the model."""
        if self.n_new == len(self.new):
            self.new = np.concatenate([self.new, np.empty_like(self.new)])
        self.new[self.n_new] = self.of_unknown(word)
        row = self.known + self.n_new
        self.n_new += 1
        if len(word) <= WORD_LETTERS:
            self.rows[word] = row
        return row

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        worker.claim("langid")
        worker.trim()
        _current[:] = [self]
        split = [words(t) for t in texts]
        k, n_langs = len(texts), len(self.langs)
        counts = np.array([len(s) for s in split], np.int64)
        if not n_langs or not counts.any():
            return [("und", 0.0)] * k
        if self.n_new * n_langs * 8 > MOST_REMEMBERED:
            self.forget()
        row = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
        text = np.repeat(np.arange(k), counts)
        seen = row < self.known
        total = np.bincount(text[seen], minlength=k)[:, None] * self.words.absent
        first, n = self.words.begin[row[seen]], np.diff(self.words.begin)[row[seen]]
        entry = np.arange(int(n.sum())) + np.repeat(first - np.cumsum(n) + n, n)
        total += np.bincount(np.repeat(text[seen], n) * n_langs + self.words.lang[entry], self.words.adds[entry], k * n_langs).reshape(k, n_langs)
        for i in range(n_langs):
            total[:, i] += np.bincount(text[~seen], self.new[row[~seen] - self.known, i], k)
        mean = total / np.maximum(counts, 1)[:, None]
        share = np.exp(SHARPNESS * (mean - mean.max(1, keepdims=True)))
        best = mean.argmax(1)
        score = share[np.arange(k), best] / share.sum(1)
        return [(self.langs[b], float(s)) if c else ("und", 0.0) for b, s, c in zip(best.tolist(), score.tolist(), counts.tolist())]


def word_counts(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, n) over all rows; every task adds its counts up before they are dealt out."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["lang", "word", "n"])

        for b in batches:
            worker.trim()
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words(text))
            if sum(map(len, counts.values())) > COUNTED:
                yield out()
        if counts:
            yield out()

    found = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).filter("lang is not null and text is not null")
    return found.mapInArrow(of, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def sampled(labelled: DataFrame, rows_per_lang: int, lang_col: str, id_col: str) -> DataFrame:
    """Of each language the rows with the least hashes of their ids, some ``rows_per_lang`` of them."""
    lang = F.col(f"`{lang_col}`").cast("string")
    # One row for each language comes to the driver, and all languages take part.
    share = {r.lang: rows_per_lang / r.n for r in labelled.groupBy(lang.alias("lang")).agg(F.count("*").alias("n")).filter("lang is not null").collect() if r.n > rows_per_lang}
    if not share:
        return labelled
    place = F.pmod(F.xxhash64(F.lit(7), F.col(f"`{id_col}`").cast("long")), F.lit(1 << 53)).cast("double") / (1 << 53)
    most = F.element_at(F.create_map(*[F.lit(x) for pair in share.items() for x in pair]), lang)
    return labelled.filter(place < F.coalesce(most, F.lit(1.0)))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", rows_per_lang: int = ROWS_PER_LANG) -> Model:
    """Learn from a sample of the rows that have a label."""
    counted, path = scratch.table(word_counts(sampled(labelled, rows_per_lang, lang_col, id_col), lang_col, text_col), "words")

    def to_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in b.columns)):
                for g in grams(word):
                    counts[lang, g] += n
            rows = list(counts.items())
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int64())], ["lang", "gram", "n"])

    # What comes to the driver is the model: the units of the bounded sample.
    most = [tuple(r) for r in counted.select("lang", "word", "n").collect()]
    short = [tuple(r) for r in counted.mapInArrow(to_grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()]
    scratch.drop(labelled.sparkSession, path)
    return Model(sorted({m[0] for m in most}), most, short)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a row's id keeps it out of the training rows; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("long").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(True))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [f for i in range(0, b.num_rows, 1000) for f in shared.value.predict(b.column(2).slice(i, 1000).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(of, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """Learn from the rows that are labelled and not held out, and predict all rows."""
    return predict(docs, fit(docs.filter(~held_out(id_col)), lang_col, text_col, id_col, rows_per_lang), id_col, text_col)


def keep_languages(docs: DataFrame, langs: list[str] | None = None, least_score: float = 0.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows whose text is in one of ``langs`` (None: in any language), with at least that score, with all their columns.

    A text of no language (``und``) is rejected. A null label is filled with the prediction; other columns stay as they are.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(docs.filter(~held_out(id_col)), lang_col, text_col, id_col))

    def accepted(texts: pa.Array) -> pa.Array:
        found = [f for i in range(0, len(texts), 1000) for f in shared.value.predict(texts.slice(i, 1000).to_pylist())]
        return pa.array([lang if lang != "und" and score >= least_score and (langs is None or lang in langs) else None for lang, score in found], pa.string())

    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    judge = F.arrow_udf(accepted, T.StringType()).asNondeterministic()  # or the filter below would have it run twice
    judged = docs.select(whole.alias("row"), judge(F.col(f"`{text_col}`").cast("string")).alias("lang_pred")).filter("lang_pred is not null")
    kind = docs.schema[lang_col].dataType
    out = [F.coalesce(F.col("row").getField(c), F.col("lang_pred").cast(kind)).alias(c) if c == lang_col else F.col("row").getField(c).alias(c) for c in docs.columns]
    return judged.select(*out)
