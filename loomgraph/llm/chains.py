"""Fuzzy passages that documents share: joined k-mer seeds, collinear chains, alignments.

1. Seeds. Of every window of ``WINDOW`` word k-mers the one with the least hash is a seed, so any run of
   ``K + WINDOW - 1`` equal words holds a common seed. A task sorts its own seeds and keeps the first place of each
   for the join; every further place is matched there and then with the first and with the place before. So a
   seed that a third of all documents share is one row for each task, never a group of documents.
2. Seeds of all tasks meet by hash in packed blocks and are matched in the same way. Matches meet by pair of documents.
   What comes of them links most documents of a group to its leaders.
3. Chains. Matches on one diagonal are joined to fragments; fragments are chained by a sweep over the first document
   with a Fenwick tree over the second, which holds for every prefix the best chain whose gap costs
   (``GAP`` for each word skipped in either) are still to be paid.
4. Alignment. The words of both sides of each chain are fetched by two equi-joins that adaptive execution may split,
   fragments are compared word by word, gaps by their longest common subsequence, ends extended. A chain less similar than
   asked for is cut at its largest gap and its parts are judged.
5. The rest. Passages that overlap in a document or are matched are one component. Then every place of a seed is matched
   with every other one, but for two places within the same component. A seed that many documents have is matched
   where a second seed within ``REACH`` words is shared too, as a chain of one seed is below the floor. A sentence shorter
   than a passage that g documents share, with more of its seeds than the floor, still makes pairs of all of them here.

   Repetitions of one to ``PERIOD`` words in turn have seeds by their place in the repetition, so that two of them are
   matched once along their length. Here such a seed counts only with one in reach that is not of its own repetition, as
   all documents with a repetition of the same words have it. What a repetition is alone is settled without them: a chain
   of nothing else is a passage only where ``least_words`` words in a row are equal. Either they go beyond the repetition, then their
   hash is a seed (``edges``); or both repetitions are as long, then all of the same words are one passage and are
   matched with the longest of them (``longest``), one row for each.
   Places of another seed that documents repeat more than ``MOST_REPEATS`` times on average are matched in order from both ends
   only, so of such repetitions some middle copies may go unmatched.

One row is returned for each passage of a document and the document that it was matched with. A document that shares a
passage is in some row, not every pair of a group is.

Results for odd input: null and empty texts share nothing; null ids take no part; rows that repeat an id count as one
document and are not compared with each other; an empty table gives an empty result; columns other than
the two named are not read. A passage repeated within one document alone is not reported.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import sliced
from loomgraph.llm.ngram_join import _parts, _texts, mix, word_hashes
from loomgraph.plans import scratch
from loomgraph.plans.components import components

K = 6
WINDOW = 10
#: Cost of each word that a chain skips in either document.
GAP = 0.25
#: Words on either side of a chain that its alignment may extend to, at first and for what the first pass left.
AROUND, FAR_AROUND = 24, 64
#: Longest period of a text that repeats itself.
PERIOD = 3
FLUSH = 1 << 21
#: Seeds whose counter is beyond this, and beyond four times the mean, are matched together with a second seed.
MOST_ALONE = 64
#: Words between the two seeds: the floor's words and another fragment's longest step.
REACH = 32
COUNTERS = 1 << 20
#: Places of a token for each document that has it, from which on they are matched in order.
MOST_REPEATS = 4
#: Matches made at a time.
MOST_PAIRS = 1 << 20
SEED = np.dtype([("token", "<u8"), ("doc", "<i8"), ("at", "<u4")])
#: ``run``: 0, or one more than the place of the repetition that the seed is of.
PLACE = np.dtype([("token", "<u8"), ("at", "<u4"), ("run", "<u4")])
#: A repetition: the words that are repeated, and at which of them, in a fixed order, it begins.
RUN = np.dtype([("token", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("words", "<u4"), ("period", "<u4"), ("turn", "<u4")])
EDGE = np.dtype([("token", "<u8"), ("at", "<u4")])
LABELLED = np.dtype([("token", "<u8"), ("doc", "<i8"), ("label", "<i8"), ("at", "<u4")])
MATCH = np.dtype([("doc", "<i8"), ("other", "<i8"), ("x", "<i4"), ("y", "<i4")])
CHAIN = "doc_id long, other_id long, x0 int, x1 int, y0 int, y1 int, parts binary"


def _grams(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text of each word, the shortest period or 0) of every k-mer of texts given as word hashes."""
    n = len(hashes) - K + 1
    factors = mix(np.arange(1, K + 1, dtype=np.uint64), 17) | np.uint64(1)
    grams = np.zeros(n, np.uint64)
    for j in range(K):
        grams += hashes[j : j + n] * factors[j]
    grams = mix(grams, 18)
    text = np.repeat(np.arange(len(counts)), counts)
    period = np.zeros(n, np.int64)
    for p in range(PERIOD, 0, -1):
        period[p:][(grams[p:] == grams[:-p]) & (text[p:n] == text[: n - p])] = p
    period[text[:n] != text[K - 1 :]] = 0
    return grams, text, period


def seeds(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash, run) of the seeds of texts given as word hashes; ``run`` as in ``PLACE``."""
    n = len(hashes) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    grams, text, period = _grams(hashes, counts)
    begins = np.cumsum(counts) - counts
    within = text[:n] == text[K - 1 :]  # k-mers that do not cross from one text into the next
    # Where a text repeats one word, or two or three in turn, every K-th k-mer is a seed of its place in the repetition.
    again = period > 0
    first = again & ~np.concatenate([[False], again[:-1]])
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    run = np.where(again, begin - begins[text[:n]] + 1, 0)
    first = np.flatnonzero(first)
    for j in range(1, PERIOD + 1):  # the repetition's own first k-mers, which repeat nothing yet
        own = first[(period[first] >= j) & (run[first - j] == 0)]
        run[own - j] = run[own]
    step = np.where(again, np.arange(n) - begin, 0)
    grams[again] = mix(grams[again] + mix(step[again].astype(np.uint64), 29), 30)
    # The least of each window by doubling: of 2, of 4, of 8, then two overlapping ones.
    low, span = grams.copy(), 1
    low[~within | again] = np.iinfo(np.uint64).max
    whole = low
    while 2 * span <= WINDOW:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < WINDOW:
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :]) if len(low) > WINDOW - span else low[:0]
    chosen = np.zeros(n, bool)
    m = len(low)
    for j in range(WINDOW):  # windows of one text alone
        same = text[:m] == text[np.minimum(np.arange(m) + WINDOW - 1 + K - 1, len(text) - 1)]
        hit = np.flatnonzero(same & (whole[j : j + m] == low))
        chosen[hit + j] = True
    short = np.flatnonzero((counts >= K) & (counts < K + WINDOW - 1))
    for t in short.tolist():  # texts shorter than a window have one
        own = grams[begins[t] : begins[t] + counts[t] - K + 1]
        chosen[begins[t] + int(np.argmin(own))] = True
    at = np.flatnonzero((chosen & ~again | again & (step % K == 0)) & within)
    return text[at], at - begins[text[at]], grams[at], run[at]


def runs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, repetition) of all repetitions of texts given as word hashes; places are those of all texts' words, ``doc`` is empty."""
    n = len(hashes) - K + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, RUN)
    grams, text, period = _grams(hashes, counts)
    again = period > 0
    first = np.flatnonzero(again & ~np.concatenate([[False], again[:-1]]))
    last = np.flatnonzero(again & ~np.concatenate([again[1:], [False]]))
    out = np.empty(len(first), RUN)
    out["doc"], out["period"] = 0, period[first]
    out["at"] = first - period[first]
    out["words"] = last + K - out["at"].astype(np.int64)
    turns = np.arange(PERIOD)
    each = np.where(turns < period[first][:, None], grams[np.minimum(out["at"].astype(np.int64)[:, None] + turns, n - 1)], np.iinfo(np.uint64).max)
    out["turn"], out["token"] = each.argmin(1), mix(each.min(1), 31)
    return text[first], out


def edges(hashes: np.ndarray, counts: np.ndarray, text: np.ndarray, found: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in all texts' words, hash) of as many words in a row as a passage has, with a part of a repetition and at least a word beyond.

    Where more than a window's words beyond it are equal on one side, a common seed stands there, so no more are taken in.
    Each has places of so many seeds that they make a fragment.
    """
    beyond = K + WINDOW - 1
    ends = np.cumsum(counts)
    owners, starts = [], []
    for t, s, n in zip(text.tolist(), found["at"].tolist(), found["words"].tolist()):
        if n + 2 * beyond < least_words:
            continue
        low, high = max(s - beyond, int(ends[t] - counts[t])), min(s + n + beyond, int(ends[t])) - least_words
        own = np.arange(low, high + 1)
        own = own[(own < s) & (own + least_words > s) | (own + least_words > s + n) & (own < s + n)]
        own = own[(own >= s - beyond) & (own + least_words <= s + n + beyond)]
        owners.append(np.full(len(own), t))
        starts.append(own)
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    both = np.unique(np.column_stack([np.concatenate(owners), np.concatenate(starts)]), axis=0)
    owner, at = both[:, 0], both[:, 1]
    factors = mix(np.arange(1, least_words + 1, dtype=np.uint64), 32) | np.uint64(1)
    tokens = np.zeros(len(at), np.uint64)
    for j in range(least_words):
        tokens += hashes[at + j] * factors[j]
    steps = np.arange(0, max(least_words - K, 0) + 1, WINDOW + K)
    salted = mix(tokens[:, None] + mix(steps.astype(np.uint64), 33), 34)
    return np.repeat(owner, len(steps)), (at[:, None] + steps).ravel(), salted.ravel()


def longest(rows: np.ndarray) -> np.ndarray:
    """Matches of each repetition with the longest one of the same words, and of those of its document with the longest of another."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], -rows["words"].astype(np.int64), rows["token"]))]
    n = len(rows)
    if not n:
        return np.empty(0, MATCH)
    new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    apart = rows["doc"] != rows["doc"][first]
    other = np.full(n, n)
    np.minimum.at(other, first[apart], np.flatnonzero(apart))  # the longest of another document
    to = np.where(apart, first, other[first])
    me = np.flatnonzero(to < n)
    to = to[me]
    x, y = rows[me], rows[to]
    period = x["period"].astype(np.int64)
    ahead = lambda a, b: (a["turn"].astype(np.int64) - b["turn"].astype(np.int64)) % period  # noqa: E731  words to skip in a
    words = lambda a, b: np.minimum(a["words"].astype(np.int64), b["words"].astype(np.int64) - ahead(b, a))
    of_x, of_y = words(x, y), words(y, x)
    skip_x, skip_y = np.where(of_x >= of_y, 0, ahead(x, y)), np.where(of_x >= of_y, ahead(y, x), 0)
    count = np.maximum(np.maximum(of_x, of_y) - K, 0) // (WINDOW + K) + 1
    pair = np.repeat(np.arange(len(me)), count)
    step = (np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count)) * (WINDOW + K)
    at_x, at_y = (x["at"] + skip_x)[pair] + step, (y["at"] + skip_y)[pair] + step
    swap = x["doc"][pair] < y["doc"][pair]
    out = np.empty(len(pair), MATCH)
    for d, a, own, theirs, at, at_theirs in (("doc", "x", x, y, at_x, at_y), ("other", "y", y, x, at_y, at_x)):
        out[d], out[a] = np.where(swap, theirs["doc"][pair], own["doc"][pair]), np.where(swap, at_theirs, at)
    return np.unique(out)


def matched(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first place of every token, and the matches of the other places with it and with the document before."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["token"]))]
    n = len(rows)
    if not n:
        return rows, np.empty(0, MATCH)
    new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
    new_doc = new | np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    before = np.maximum.accumulate(np.where(new_doc, np.arange(n), 0)) - 1  # the last place of the document before
    far = np.flatnonzero(rows["doc"] != rows["doc"][first])
    near = far[rows["doc"][before[far]] != rows["doc"][first[far]]]
    me, to = np.concatenate([far, near]), np.concatenate([first[far], before[near]])
    out = np.empty(len(me), MATCH)
    out["doc"], out["x"], out["other"], out["y"] = rows["doc"][me], rows["at"][me], rows["doc"][to], rows["at"][to]
    return rows[new], out


def labelled(doc: np.ndarray, at: np.ndarray, token: np.ndarray, run: np.ndarray, label: np.ndarray, often: np.ndarray, apart: int) -> np.ndarray:
    """The places of whole documents to be matched, seeds that ``often`` marks or that are of a repetition once with each seed in reach.

    Two such seeds that begin less than ``apart`` words from each other make no chain of the floor's length. A repetition
    stands for its first seed, and what is in reach of either of its ends is so of all its seeds.
    """
    by = np.lexsort((at, doc))
    doc, at, token, run, label = doc[by], at[by].astype(np.int64), token[by], run[by].astype(np.int64), label[by]
    hot = often[(token >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64)] | (run > 0)
    tokens, mine = [token[~hot]], [np.flatnonzero(~hot)]
    begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (run[1:] != run[:-1]) | (run[1:] == 0)])[: len(doc)])
    size = np.diff(np.append(begin, len(doc)))
    name = token[begin].copy()
    own = np.flatnonzero((run > 0) & (at == run - 1))
    name[np.searchsorted(begin, own, "right") - 1] = token[own]
    low, high, of, warm = at[begin], at[begin + size - 1], doc[begin], hot[begin]
    for step in range(1, REACH + 1):
        near = np.flatnonzero((of[step:] == of[:-step]) & (low[step:] - high[:-step] <= REACH))
        if not len(near):
            break
        near = near[~warm[near] | ~warm[near + step] | (high[near + step] - low[near] >= apart)]
        for unit, other in ((near, near + step), (near + step, near)):
            unit, other = unit[warm[unit]], other[warm[unit]]
            k = size[unit]
            own = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(begin[unit], k)
            tokens.append(mix(token[own] + mix(np.repeat(name[other], k), 23), 24))
            mine.append(own)
    mine = np.concatenate(mine)
    out = np.empty(len(mine), LABELLED)
    out["token"], out["doc"], out["label"], out["at"] = np.concatenate(tokens), doc[mine], label[mine], at[mine]
    out = out[np.lexsort((out["at"], out["doc"], out["token"]))]
    new = (out["token"][1:] != out["token"][:-1]) | (out["doc"][1:] != out["doc"][:-1]) | (out["at"][1:] != out["at"][:-1])
    return out[np.concatenate([[True], new])] if len(out) else out


def aligned(rows: np.ndarray) -> np.ndarray:
    """Rows of tokens that documents repeat over and over get the place's number from either end into their tokens.

    So two documents full of one word are matched place by place, not each place with each.
    """
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["token"]))]
    if not len(rows):
        return rows
    new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
    new_doc = new | np.concatenate([[True], rows["doc"][1:] != rows["doc"][:-1]])
    token = np.cumsum(new) - 1
    often = (np.bincount(token) > MOST_REPEATS * np.bincount(token, new_doc))[token]
    begin = np.flatnonzero(new_doc)
    own = np.cumsum(new_doc) - 1
    end = np.append(begin[1:], len(rows))
    again = rows[often], rows[often]
    again[0]["token"] = mix(again[0]["token"] + mix((np.arange(len(rows)) - begin[own])[often].astype(np.uint64), 25), 26)
    again[1]["token"] = mix(again[1]["token"] + mix((end[own] - np.arange(len(rows)))[often].astype(np.uint64), 27), 28)
    return np.concatenate([rows[~often], *again])


def all_matched(rows: np.ndarray) -> Iterator[np.ndarray]:
    """The matches of all places of a token, but for those of one document or one component; some at a time."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["label"], rows["token"]))]
    n = len(rows)
    if not n:
        return
    number = np.cumsum(np.concatenate([[False], rows["token"][1:] != rows["token"][:-1]]))
    after = np.searchsorted(number, number, "right")
    same = np.concatenate([[True], (rows["label"][1:] != rows["label"][:-1]) | (number[1:] != number[:-1])])
    run_end = np.append(np.flatnonzero(same)[1:], n)[np.cumsum(same) - 1]
    # Sorted by label, the partners of a place in a component are all places behind its own run.
    first = np.where(rows["label"] == 0, np.arange(n) + 1, run_end)
    count = after - first
    total = np.cumsum(count)
    start = 0
    while start < n:
        done = int(total[start - 1]) if start else 0
        stop = max(int(np.searchsorted(total, done + MOST_PAIRS, "right")), start + 1)
        k = count[start:stop]
        me = np.repeat(np.arange(start, stop), k)
        to = np.arange(len(me)) - np.repeat(np.cumsum(k) - k, k) + first[me]
        apart = rows["doc"][me] != rows["doc"][to]
        me, to = me[apart], to[apart]
        swap = rows["doc"][me] < rows["doc"][to]
        me, to = np.where(swap, to, me), np.where(swap, me, to)
        if len(me):
            out = np.empty(len(me), MATCH)
            out["doc"], out["x"], out["other"], out["y"] = rows["doc"][me], rows["at"][me], rows["doc"][to], rows["at"][to]
            yield out
        start = stop


def _dealt(rows: np.ndarray, block: np.ndarray) -> Iterator[tuple[int, bytes]]:
    by = np.argsort(block, kind="stable")
    rows, block = rows[by], block[by]
    cuts = np.flatnonzero(np.diff(block)) + 1
    for start, part in zip(np.concatenate([[0], cuts]).tolist(), np.split(rows, cuts)):
        if len(part):
            yield int(block[start]), part.view(np.uint8).reshape(len(part), -1).T.tobytes()  # byte by byte, to be packed smaller


def _unpacked(packed: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(packed), np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _by_pair(matches: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    matches = matches[np.lexsort((matches["x"], matches["other"], matches["doc"]))]
    key = mix(matches["doc"].astype(np.uint64) * np.uint64(3) + matches["other"].astype(np.uint64), 19)
    return _dealt(matches, (key % np.uint64(blocks)).astype(np.int64))


def _rows(kind: str, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(parts), pa.string()), pa.array([p[0] for p in parts], pa.int32()), pa.array([zlib.compress(p[1], 1) for p in parts], pa.binary())], ["kind", "block", "packed"])


class Fenwick:
    """Greatest (value, payload) over prefixes of 0..n-1."""

    def __init__(self, n: int):
        self.best: list[tuple[float, int]] = [(-1e300, -1)] * (n + 1)

    def put(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def top(self, n: int) -> tuple[float, int]:
        """Over the first n."""
        got = (-1e300, -1)
        while n:
            got = max(got, self.best[n])
            n -= n & -n
        return got


def chain(fragments: list[tuple[int, int, int]], least: float) -> list[list[tuple[int, int, int]]]:
    """Collinear chains of (x, y, words), best first, each fragment in one chain at most, with scores of at least ``least``.

    Fragments may overlap the next by less than a k-mer. A fragment's score is its words plus the best chain that ends
    before it in both documents less the words skipped; ends enter the tree as score + GAP * (x + y).
    """
    if len(fragments) == 1:
        return [fragments] if fragments[0][2] >= least else []
    fragments = sorted(fragments)
    ends = [(x + max(n - K, 0), y + max(n - K, 0)) for x, y, n in fragments]
    ys = sorted({e[1] for e in ends})
    tree = Fenwick(len(ys))
    score, back = [0.0] * len(fragments), [-1] * len(fragments)
    waiting = sorted(range(len(fragments)), key=lambda i: ends[i][0])
    entered = 0
    for i, (x, y, n) in enumerate(fragments):
        while entered < len(waiting) and ends[waiting[entered]][0] < x:
            j = waiting[entered]
            tree.put(bisect.bisect_left(ys, ends[j][1]), (score[j] + GAP * (fragments[j][0] + fragments[j][1] + 2 * fragments[j][2]), j))
            entered += 1
        best, j = tree.top(bisect.bisect_left(ys, y))
        score[i] = float(n)
        if j >= 0 and best - GAP * (x + y) > 0:
            score[i], back[i] = n + min(best - GAP * (x + y), score[j]), j
    used, out = [False] * len(fragments), []
    for i in sorted(range(len(fragments)), key=lambda i: -score[i]):
        if used[i] or score[i] < least:
            continue
        own, j = [], i
        while j >= 0 and not used[j]:
            used[j] = True
            own.append(fragments[j])
            j = back[j]
        if sum(f[2] for f in own) >= least:
            out.append(own[::-1])
    return out


def chains_of(matches: np.ndarray, least: float) -> Iterator[tuple[int, int, list[tuple[int, int, int]]]]:
    """(doc, other, chain) of all pairs in a block of matches."""
    diagonal = matches["y"] - matches["x"]
    by = np.lexsort((matches["x"], diagonal, matches["other"], matches["doc"]))
    m, diagonal = matches[by], diagonal[by]
    pair = np.concatenate([[True], (m["doc"][1:] != m["doc"][:-1]) | (m["other"][1:] != m["other"][:-1])])
    cut = pair | np.concatenate([[True], (diagonal[1:] != diagonal[:-1]) | (m["x"][1:] - m["x"][:-1] > WINDOW + K)])
    start = np.flatnonzero(cut)
    last = np.append(start[1:], len(m)) - 1
    words = m["x"][last] + K - m["x"][start]
    group = np.cumsum(pair)[start]
    total = np.bincount(group, words)
    keep = total[group] >= least
    start, words, group = start[keep], words[keep], group[keep]
    bounds = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]).tolist() if len(group) else [0]
    xs, ys, ns = m["x"][start].tolist(), m["y"][start].tolist(), words.tolist()
    docs, others = m["doc"][start].tolist(), m["other"][start].tolist()
    for a, e in zip(bounds, bounds[1:]):
        for c in chain(list(zip(xs[a:e], ys[a:e], ns[a:e])), least):
            yield docs[a], others[a], c


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, np.int32)
    for v in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == v, row[:-1] + 1, 0)))
    return int(row[-1])


def align(x: np.ndarray, y: np.ndarray, parts: list[tuple[int, int, int]], least_words: int, least_similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages (x start, x words, y start, y words, similarity) of a chain, in places of the two word sequences given."""
    equal, at_x, at_y, gaps = 0, parts[0][0], parts[0][1], []
    for px, py, n in parts:
        skip = max(at_x - px, at_y - py, 0)  # overlaps count once
        px, py, n = px + skip, py + skip, n - skip
        if n <= 0:
            continue
        equal += common(x[at_x:px], y[at_y:py])
        gaps.append(max(px - at_x, py - at_y))
        n = min(n, len(x) - px, len(y) - py)
        equal += int((x[px : px + n] == y[py : py + n]).sum())
        at_x, at_y = px + n, py + n
    x0, y0 = parts[0][:2]
    while x0 and y0 and x[x0 - 1] == y[y0 - 1]:
        x0, y0, equal = x0 - 1, y0 - 1, equal + 1
    while at_x < len(x) and at_y < len(y) and x[at_x] == y[at_y]:
        at_x, at_y, equal = at_x + 1, at_y + 1, equal + 1
    longest, shortest = max(at_x - x0, at_y - y0), min(at_x - x0, at_y - y0)
    similarity = equal / longest if longest else 0.0
    if similarity >= least_similarity:
        return [(x0, at_x - x0, y0, at_y - y0, similarity)] if shortest >= least_words else []
    if len(parts) < 2:
        return []
    widest = max(range(1, len(parts)), key=lambda i: max(parts[i][0] - parts[i - 1][0] - parts[i - 1][2], parts[i][1] - parts[i - 1][1] - parts[i - 1][2]))
    return [p for half in (parts[:widest], parts[widest:]) for p in align(x, y, half, least_words, least_similarity)]


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, least_similarity: float = 0.75) -> DataFrame:
    """Per passage: doc_id, start, n_words, other_id, other_start, other_n_words, similarity; places count words."""
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col).filter("doc_id is not null and text is not null")
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    least = least_words / 2 - K  # of a chain's seeds; windows at both ends of a passage may lie outside

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            first, matches = matched(np.concatenate(waiting))
            waiting.clear()
            size = 0
            yield _rows("seed", list(_dealt(first, (first["token"] % np.uint64(blocks)).astype(np.int64))))
            yield _rows("match", list(_by_pair(matches, blocks)))

        for b in _parts(batches):
            ids = b.column(0).to_numpy()
            text, at, grams, _ = seeds(*word_hashes(b.column(1).to_pylist()))
            rows = np.empty(len(text), SEED)
            rows["token"], rows["doc"], rows["at"] = grams, ids[text], at
            waiting.append(rows)
            size += len(rows)
            if size >= FLUSH:
                yield from flush()
        if size:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for block, packed in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                by.setdefault(block, []).append(_unpacked(packed, SEED))
        for parts in by.values():
            yield _rows("match", list(_by_pair(matched(np.concatenate(parts))[1], blocks)))

    packed = "kind string, block int, packed binary"
    sown, sown_path = scratch.table(texts.mapInArrow(sow, packed), "seeds")
    met = sown.filter("kind = 'seed'").repartitionById(blocks, F.col("block")).mapInArrow(meet, packed)

    def link(floor: float):
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            by: dict[int, list[bytes]] = {}
            for b in batches:
                for block, raw in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    by.setdefault(block, []).append(raw)
            for block in sorted(by):
                matches = np.unique(np.concatenate([_unpacked(raw, MATCH) for raw in by.pop(block)]))
                chains = chains_of(matches, floor)
                while found := [(d, o, c[0][0], max(f[0] + f[2] for f in c), c[0][1], max(f[1] + f[2] for f in c), np.array(c, "<i4").tobytes()) for d, o, c in islice(chains, 5000)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary()))], ["doc_id", "other_id", "x0", "x1", "y0", "y1", "parts"])

        return of

    matches = sown.filter("kind = 'match'").unionByName(met)
    found = scratch.save(matches.repartitionById(blocks, F.col("block")).mapInArrow(link(least), CHAIN), "chains")
    scratch.drop(spark, sown_path)

    linked = scratch.save(_judged(texts, found, least_words, least_similarity), "passages")
    rest = _unlinked(texts, linked, blocks, int(least) - K, least_words).repartitionById(blocks, F.col("block")).mapInArrow(link(least), CHAIN)
    more = _judged(texts, scratch.save(rest, "chains"), least_words, least_similarity, FAR_AROUND)
    return linked.unionByName(more).distinct()


def _covered(linked: DataFrame) -> DataFrame:
    """(doc_id, covered): per document the ranges of words within passages and the component of each."""
    sides = linked.select("doc_id", "start", (F.col("start") + F.col("n_words")).alias("end")).unionByName(linked.select(F.col("other_id").alias("doc_id"), F.col("other_start").alias("start"), (F.col("other_start") + F.col("other_n_words")).alias("end")))
    sides = sides.groupBy("doc_id", "start").agg(F.max("end").alias("end"))
    before = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    opened = sides.withColumn("low", F.when(F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True)), F.col("start")))
    upto = Window.partitionBy("doc_id").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    ranges = scratch.save(opened.withColumn("low", F.max("low").over(upto)).withColumn("node", F.xxhash64("doc_id", "low")), "ranges")
    mine = ranges.select("doc_id", "start", F.col("node").alias("a"))
    theirs = ranges.select(F.col("doc_id").alias("other_id"), F.col("start").alias("other_start"), F.col("node").alias("b"))
    edges = linked.select("doc_id", "start", "other_id", "other_start").join(mine, ["doc_id", "start"]).join(theirs, ["other_id", "other_start"]).select("a", "b")
    whole = ranges.groupBy("doc_id", "low", "node").agg(F.max("end").alias("high"))
    placed = whole.join(components(edges), "node").select("doc_id", F.struct("low", "high", "component").alias("range"))
    return placed.groupBy("doc_id").agg(F.collect_list("range").alias("covered"))


def _unlinked(texts: DataFrame, linked: DataFrame, blocks: int, apart: int, least_words: int) -> DataFrame:
    """Packed matches of all places of each seed that are not within passages of one component, and of repetitions with the longest."""

    def sow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, np.int64)
        for b in _parts(batches):
            hashes, lengths = word_hashes(b.column(1).to_pylist())
            text, at, grams, run = seeds(hashes, lengths)
            by = np.lexsort((text, grams))
            once = by[np.concatenate([[True], (grams[by][1:] != grams[by][:-1]) | (text[by][1:] != text[by][:-1])])] if len(by) else by
            counters += np.bincount((grams[once] >> np.uint64(65 - COUNTERS.bit_length())).astype(np.int64), minlength=COUNTERS)
            rows = np.empty(len(text), PLACE)
            rows["token"], rows["at"], rows["run"] = grams, at, run
            begins, k = np.cumsum(lengths) - lengths, b.num_rows
            of, repeated = runs(hashes, lengths)
            edge_of, edge_at, edge_token = edges(hashes, lengths, of, repeated, least_words)
            edge = np.empty(len(edge_of), EDGE)
            edge["token"], edge["at"] = edge_token, edge_at - begins[edge_of]
            own = repeated["words"] >= least_words
            of, repeated = of[own], repeated[own]
            repeated["at"] -= begins[of].astype(np.uint32)
            parts = [[p.tobytes() for p in np.split(part, np.searchsorted(at_text, np.arange(1, k)))] for part, at_text in ((rows, text), (edge, edge_of), (repeated, of))]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p, pa.binary()) for p in parts), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names)
        for k, packed in sliced.spread(counters):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), *[pa.nulls(1, pa.binary())] * 3, pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names)

    names = ["doc_id", "places", "edges", "runs", "slice", "packed"]
    sown = scratch.save(texts.mapInArrow(sow, "doc_id long, places binary, edges binary, runs binary, slice int, packed binary"), "places")
    mean = (sown.agg(F.sum(F.length("places"))).first()[0] or 0) / PLACE.itemsize / COUNTERS
    often = texts.sparkSession.sparkContext.broadcast(sliced.total(sown.filter("slice is not null").select("slice", "packed"), COUNTERS, lambda s: s > MOST_ALONE + 4 * mean))
    placed = sown.filter("slice is null and length(places) > 0").select("doc_id", "places", "edges", "runs").join(_covered(linked), "doc_id", "left")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = often.value.astype(bool)
        waiting, size = [], 0

        def sent(kind: str, parts: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(parts)
            rows = rows[np.argsort(rows["token"])]
            return _rows(kind, list(_dealt(rows, (rows["token"] % np.uint64(blocks)).astype(np.int64))))

        def of_kind(column: pa.Array, kind: np.dtype, ids: np.ndarray, covers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """(document, row, component) of the packed rows of a kind."""
            each = [np.frombuffer(p, kind) for p in column.to_pylist()]
            counts = np.array([len(p) for p in each])
            rows, begins = np.concatenate(each), np.cumsum(counts) - counts
            label = np.zeros(len(rows), np.int64)
            for k, covered in enumerate(covers):
                own = slice(begins[k], begins[k] + counts[k])
                at = rows["at"][own].astype(np.int64)
                for c in covered or ():
                    label[own][(at + K > c["low"]) & (at < c["high"])] = c["component"]
            return np.repeat(ids, counts), rows, label

        for b in _parts(batches):
            ids, covers = b.column(0).to_numpy(), b.column(4).to_pylist()
            doc, places, label = of_kind(b.column(1), PLACE, ids, covers)
            waiting.append(labelled(doc, places["at"], places["token"], places["run"], label, hot, apart))
            doc, places, label = of_kind(b.column(2), EDGE, ids, covers)
            own = np.empty(len(places), LABELLED)
            own["token"], own["doc"], own["label"], own["at"] = places["token"], doc, label, places["at"]
            waiting.append(own)
            doc, repeated, _ = of_kind(b.column(3), RUN, ids, [None] * len(ids))
            if len(repeated):
                repeated = repeated.copy()
                repeated["doc"] = doc
                yield sent("run", [repeated])
            size += len(waiting[-1]) + len(waiting[-2])
            if size >= FLUSH // 2:
                yield sent("seed", waiting)
                waiting, size = [], 0
        if size:
            yield sent("seed", waiting)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[str, int], list[np.ndarray]] = {}
        for b in batches:
            for kind, block, packed in zip(*(c.to_pylist() for c in b.columns)):
                by.setdefault((kind, block), []).append(_unpacked(packed, RUN if kind == "run" else LABELLED))
        for (kind, _), parts in by.items():
            rows = np.concatenate(parts)
            for matches in [longest(rows)] if kind == "run" else all_matched(aligned(rows)):
                yield _rows("match", list(_by_pair(matches, blocks)))

    packed = "kind string, block int, packed binary"
    return placed.mapInArrow(deal, packed).repartitionById(blocks, F.col("block")).mapInArrow(meet, packed)


def _judged(texts: DataFrame, found: DataFrame, least_words: int, least_similarity: float, around: int = AROUND) -> DataFrame:
    """The passages of chains."""
    spark = texts.sparkSession
    marks = spark.sparkContext.broadcast(sliced.members(found.select(F.explode(F.array("doc_id", "other_id")).alias("id")).distinct()))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            b = b.filter(pa.array(sliced.holds(marks.value, b.column(0).to_numpy())))
            hashes, counts = word_hashes(b.column(1).to_pylist())
            words = (hashes >> np.uint64(32)).astype("<u4")
            ends = np.cumsum(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([words[e - c : e].tobytes() for e, c in zip(ends.tolist(), counts.tolist())], pa.binary())], ["id", "words"])

    words = texts.mapInArrow(fetch, "id long, words binary")
    cut = lambda low, high: F.substring("words", 4 * F.col(low) + 1, 4 * (F.col(high) - F.col(low)))
    edge = lambda c: F.greatest(F.col(c) - around, F.lit(0))
    own = found.withColumns({"xa": edge("x0"), "xe": F.col("x1") + around, "ya": edge("y0"), "ye": F.col("y1") + around})
    with_x = own.join(words.withColumnRenamed("id", "doc_id"), "doc_id").withColumn("x", cut("xa", "xe")).drop("words", "x0", "x1", "y0", "y1")
    with_y = with_x.join(words.withColumnRenamed("id", "other_id"), "other_id").withColumn("y", cut("ya", "ye")).select("doc_id", "other_id", "xa", "ya", "parts", "x", "y")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _parts(batches):
            rows = []
            for d, o, xa, ya, parts, x, y in zip(*(c.to_pylist() for c in b.columns)):
                own = [(px - xa, py - ya, n) for px, py, n in np.frombuffer(parts, "<i4").reshape(-1, 3).tolist()]
                for x0, nx, y0, ny, s in align(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), own, least_words, least_similarity):
                    rows.append((d, xa + x0, nx, o, ya + y0, ny, s))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            names = ["doc_id", "start", "n_words", "other_id", "other_start", "other_n_words", "similarity"]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return with_y.mapInArrow(judge, "doc_id long, start int, n_words int, other_id long, other_start int, other_n_words int, similarity double").distinct()
