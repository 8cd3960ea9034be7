"""Runs of repeated words (loops of generated or broken text), found with an enhanced suffix array.

A run is a stretch of words with smallest period q, at least ``max(least, times * q)`` words long, that no
neighbouring word extends. Its last square (two periods) is a branching tandem repeat: the suffixes at its
start i and at i + q share exactly q words. So it is enough to look at every LCP interval: its depth is the
only period to test, and for each suffix of its smaller side ``ISA[i + depth]`` and ``ISA[i - depth]`` tell by
two look-ups whether the partner lies on the other side. An interval with many children is taken as several
two-sided ones, one for each boundary of the LCP array, so no tree is built: a boundary's sides are bounded by
the next smaller values left and right. A hit's square is rotated left as far as the words agree, which gives
the whole run; hits of the same run under a multiple of its period are merged into the smallest one.

Documents are independent, so Spark deals rows as the scan gives them and nothing is shuffled. In a task,
documents are laid side by side with word codes of their own, up to ``block`` words, and the suffix array is
built by prefix doubling over all of them in numpy; only suffixes that still tie are sorted again. The rank
arrays of the doublings serve for the LCP values and for the rotation. A document in which no five words occur
twice in a row order has no run (any run repeats five words one period on), and leaves before the suffix array.

Nulls: a null text has no words; a null id is never changed by ``planted`` and keeps its row. Repeated rows get
a row each, an empty table gives an empty result, other columns are ignored. A very long text is one block of
its own: memory is about 4 bytes a word for each doubling (at most log2 of the longest repeat).
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logvigil.llm.common import texts

Run = tuple[int, int, int]  # first word, number of words, period


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One document in ten gets a periodic tail whose place and period follow from its id."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    tail = words[start : start + period]
    return words[:start] + (tail * (-(-(n - start) // period)))[: n - start]


class SuffixArray:
    """Suffixes of several documents laid side by side; codes of different documents differ."""

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``ends``: for each place the end of its document."""
        n = len(codes)
        order = np.argsort(codes, kind="stable")
        first = np.r_[True, codes[order][1:] != codes[order][:-1]]
        starts = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        rank = np.empty(n + 1, np.int32)
        rank[order], rank[n] = starts, -1
        #: ``levels[t][i]`` is equal for two places if and only if their next 2^t words are.
        self.levels = []
        open_ = order[~first | ~np.r_[first[1:], True]]  # places in groups of two and more, by rank
        step = 1
        while len(open_):
            self.levels.append(rank)
            after = open_ + step
            key = rank[open_].astype(np.int64) * (n + 1) + np.where(after < ends[open_], rank[np.minimum(after, n)] + 1, 0)
            by = np.argsort(key, kind="stable")
            key, open_ = key[by], open_[by]
            group = key // (n + 1)
            at = np.arange(len(key))
            head = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], at, 0))
            first = np.r_[True, key[1:] != key[:-1]]
            same = np.maximum.accumulate(np.where(first, at, 0))
            rank = rank.copy()
            rank[open_] = group + same - head
            open_ = open_[~first | ~np.r_[first[1:], True]]
            step *= 2
        self.inverse = rank[:n]
        self.order = np.empty(n, np.int64)
        self.order[self.inverse] = np.arange(n)
        a, b = self.order[:-1], self.order[1:]
        self.lcp = np.zeros(n + 1, np.int64)  # lcp[r] between the suffixes of rank r - 1 and r
        if n > 1:
            self.lcp[1:n] = self.common(a, b)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from the places a and b on."""
        length, n = np.zeros(len(a), np.int64), len(self.inverse)
        for t in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[t]
            length += (rank[np.minimum(a + length, n)] == rank[np.minimum(b + length, n)]).astype(np.int64) << t
        return length

    def common_before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words before the places a < b."""
        length = np.zeros(len(a), np.int64)
        for t in range(len(self.levels) - 1, -1, -1):
            rank, back = self.levels[t], length + (1 << t)
            same = (back <= a) & (rank[np.maximum(a - back, 0)] == rank[np.maximum(b - back, 0)])
            length += same.astype(np.int64) << t
        return length

    def sides(self, longest: np.ndarray) -> tuple[np.ndarray, ...]:
        """``left, boundary, right, depth``: suffixes left..boundary-1 and boundary..right-1 share exactly ``depth`` words.

        Boundaries deeper than ``longest`` of their document are left out.
        """
        values = self.lcp.tolist()
        n = len(values) - 1
        left, right, stack = [0] * (n + 1), [n] * (n + 1), [0]
        for r in range(1, n + 1):
            depth = values[r]
            while values[stack[-1]] > depth:
                right[stack.pop()] = r
            left[r] = stack[-1]
            stack.append(r)
        at = np.flatnonzero(self.lcp[:n] > 0)
        at = at[self.lcp[at] <= longest[self.order[at]]]
        return np.array(left, np.int64)[at], at, np.array(right, np.int64)[at], self.lcp[at]

    def branching(self, longest: np.ndarray, chunk: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Starts and periods of all branching tandem repeats with a period of at most ``longest``."""
        left, mid, right, depth = self.sides(longest)
        smaller = mid - left <= right - mid
        low, high = np.where(smaller, left, mid), np.where(smaller, mid, right)
        other_low, other_high = np.where(smaller, mid, left), np.where(smaller, right, mid)
        sizes = high - low
        upto, n = np.cumsum(sizes), len(self.inverse)
        starts, periods, at = [], [], 0
        while at < len(sizes):
            done = upto[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(upto, done + chunk)))
            which = np.repeat(np.arange(at, to), sizes[at:to])
            place = self.order[low[which] + np.arange(len(which)) - (upto[which] - sizes[which] - done)]
            period = depth[which]
            for sign in (1, -1):
                partner = place + sign * period
                rank = self.inverse[np.clip(partner, 0, n - 1)]
                hit = (partner >= 0) & (partner < n) & (rank >= other_low[which]) & (rank < other_high[which])
                starts.append(np.minimum(place, partner)[hit])
                periods.append(period[hit])
            at = to
        return (np.concatenate(starts), np.concatenate(periods)) if starts else (np.zeros(0, np.int64),) * 2


def all_runs(documents: list[np.ndarray], times: int = 4, least: int = 6) -> list[list[Run]]:
    """Runs of each document (word codes), by start and period."""
    sizes = np.array([len(d) for d in documents], np.int64)
    found: list[list[Run]] = [[] for _ in documents]
    if not sizes.sum():
        return found
    own = np.repeat(np.arange(len(documents)), sizes)
    codes = np.concatenate(documents).astype(np.int64)
    ends = np.cumsum(sizes)
    array = SuffixArray(own * (int(codes.max()) + 1) + codes, ends[own])
    start, period = array.branching((sizes // times)[own])
    end = start + 2 * period
    start = start - array.common_before(start, start + period)
    good = end - start >= np.maximum(least, times * period)
    start, end, period = start[good], end[good], period[good]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    first = np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)]
    for s, e, q in sorted(zip(start[first].tolist(), period[first].tolist(), end[first].tolist(), strict=True)):
        document = int(own[s])
        base = int(ends[document] - sizes[document])
        found[document].append((s - base, q - s, e))
    return found


def may_have_runs(documents: list[np.ndarray], width: int = 5) -> np.ndarray:
    """False only for documents in which no ``width`` words in a row occur twice."""
    sizes = np.array([len(d) for d in documents], np.int64)
    may = np.zeros(len(documents), bool)
    if sizes.sum() < width:
        return may
    own = np.repeat(np.arange(len(documents)), sizes)
    codes = np.concatenate(documents).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    codes ^= codes >> np.uint64(29)
    n = len(codes) - width + 1
    grams = own[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        grams = grams * np.uint64(0xBF58476D1CE4E5B9) + codes[k : k + n]
    grams, own = grams[own[:n] == own[width - 1 :]], own[:n][own[:n] == own[width - 1 :]]
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        place = np.minimum(np.searchsorted(twice, grams), len(twice) - 1)
        may[own[twice[place] == grams]] = True
    return may


def collapse(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """Words that no run holds behind its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, n in zip(words, np.cumsum(drop).tolist()) if not n]


def _row(words: list[bytes], runs: list[Run], whole: bool) -> tuple:
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    exponent = 1000 * best[1] // best[2] if runs else None
    short = b" ".join(collapse(words, runs))
    row = (len(runs), *best, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(short).hexdigest())
    if not whole:
        return row
    return (*row, short.decode("utf-8", "replace"), [dict(zip(("start", "length", "period"), r)) for r in runs])


def scan(documents: list[list[bytes]], times: int = 4, least: int = 6) -> list[list[Run]]:
    """Runs of each document, given as words."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    coded = [np.fromiter(map(ids.__getitem__, words), np.int64, len(words)) for words in documents]
    found: list[list[Run]] = [[] for _ in documents]
    chosen = np.flatnonzero(may_have_runs(coded)).tolist()
    for number, runs in zip(chosen, all_runs([coded[i] for i in chosen], times, least)):
        found[number] = runs
    return found


_FIELDS = [
    ("n_runs", pa.int64(), "long"), ("start", pa.int64(), "long"), ("length", pa.int64(), "long"), ("period", pa.int64(), "long"),
    ("exponent_milli", pa.int64(), "long"), ("runs_sha256", pa.string(), "string"), ("collapsed_sha256", pa.string(), "string"),
    ("collapsed", pa.string(), "string"),
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])),
     "array<struct<start: long, length: long, period: long>>"),
]


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", plant: bool = False, whole: bool = True,
              times: int = 4, least: int = 6, block: int = 300_000) -> DataFrame:
    """Per document the number of runs, the greatest one (most words, then first start, then smallest period),
    digests of the runs and of the collapsed text, and with ``whole`` also the collapsed text and all runs.

    ``times`` and ``least`` are at least 3 and 6, so that a run always repeats five words (``may_have_runs``).
    ``plant`` changes the documents with ``planted`` before the search.
    """
    if times < 3 or least < 6:
        raise ValueError("a run has at least three periods and six words")
    rows = texts(docs, id, text)
    fields = _FIELDS if whole else _FIELDS[:7]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, held, size = batch.column(0), 0, [], 0
            for number, (doc_id, body) in enumerate(zip(ids.to_pylist(), batch.column(1).to_pylist())):
                words = body.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
                held.append(planted(words, doc_id) if plant else words)
                size += len(words)
                if size >= block or number + 1 == batch.num_rows:
                    columns = zip(*(_row(words, runs, whole) for words, runs in zip(held, scan(held, times, least))))
                    arrays = [pa.array(column, kind) for column, (_, kind, _) in zip(columns, fields)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)), *arrays], names=["doc_id", *(f[0] for f in fields)])
                    at, held, size = number + 1, [], 0

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, ", ".join([f"doc_id {kind}", *(f"{name} {sql}" for name, _, sql in fields)]))
