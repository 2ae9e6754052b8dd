"""Periodic runs of words by a harmonic grid.

A run is a stretch of words with smallest period q, at least max(MIN_LENGTH, MIN_TIMES * q) words long, that neither
neighbouring word extends. For each period p, the grid points 0, p, 2p, ... are n / p, over all periods n log n in all. A
run of period p has a first grid point x, and x + p is in it too, so the longest common extensions of x and x + p, forward
and backward, give its ends. Extensions are answered by the suffix array of the words, that of the reversed words, and
range minima over their longest common prefixes. At a run's first grid point the words x and x + p, x + 1 and x + p + 1,
x + p and x + 2p are equal; no extension is asked where one of these pairs differs, and texts in which all differ get no
suffix array. A stretch found with several periods has the smallest of them as its own; the others are its multiples.

Texts of a slice are searched together, up to SLICE_WORDS words; each ends with a separator of its own, so that no
extension goes on into the next one. Memory is about the words of a slice times the logarithm of the longest repeat.

Defined results: a null text has no words and no runs. A null doc_id gives an unchanged text in ``grown``. Repeated rows
each have their row. Very long texts are searched whole, in one task. Columns that clash with an output column are replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from geoloom.llm._common import slices, wider

MIN_LENGTH, MIN_TIMES = 24, 3
#: Words that are searched together, and grid points at a time.
SLICE_WORDS, GRID_POINTS = 200_000, 2_000_000

OUT = (("n_runs", "long"), ("start", "long"), ("length", "long"), ("period", "long"), ("exponent_milli", "long"), ("runs_sha256", "string"), ("collapsed_sha256", "string"))


@dataclass
class Extensions:
    """Longest common prefixes of suffixes: the rank of each suffix, and minima of lcp over ranges of 2**k ranks."""

    rank: np.ndarray
    minima: list[np.ndarray]

    @classmethod
    def of(cls, s: np.ndarray) -> Extensions:
        """s: non-negative numbers, the last of which occurs once, as does the last of every text in it."""
        n = len(s)
        order = np.argsort(s, kind="stable")
        new = np.r_[True, s[order][1:] != s[order][:-1]]
        # A suffix has the place of the first of its group as its rank, so that groups can be sorted on their own.
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        ranks, width = [rank.astype(np.int32)], 1
        open_ = ~(new & np.r_[new[1:], True])
        while open_.any():
            at = np.flatnonzero(open_)  # places of suffixes that are not told apart yet
            i = order[at]
            key = rank[i] * n + rank[i + width]  # a repeated stretch of width words has no separator, so i + width < n
            by = np.argsort(key, kind="stable")
            order[at], key = i[by], key[by]
            first = np.r_[True, key[1:] != key[:-1]]
            rank[order[at]] = np.maximum.accumulate(np.where(first, at, 0))
            open_ = np.zeros(n, bool)
            open_[at] = ~(first & np.r_[first[1:], True])
            width *= 2
            ranks.append(rank.astype(np.int32))
        # Neighbours in order: stretches of 2**k words are equal if their ranks at that level are.
        i, j = order[:-1].copy(), order[1:].copy()
        lcp = np.zeros(n, np.int32)
        for k in range(len(ranks) - 2, -1, -1):
            same = np.flatnonzero(ranks[k][i] == ranks[k][j])
            lcp[same + 1] += 1 << k
            i[same] += 1 << k
            j[same] += 1 << k
        minima = [lcp]
        while 2 << len(minima) - 1 <= n:
            half = 1 << len(minima) - 1
            minima.append(np.minimum(minima[-1][:-half], minima[-1][half:]))
        return cls(rank, minima)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and j, which differ, have in common at their starts."""
        a, b = self.rank[i], self.rank[j]
        low, high = np.minimum(a, b) + 1, np.maximum(a, b)
        level = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(i), np.int64)
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            m = self.minima[k]
            out[here] = np.minimum(m[low[here]], m[high[here] + 1 - (1 << k)])
        return out


def grid(sizes: np.ndarray, starts: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(x, p): for each text and each period p that fits ``times`` times, the grid points x with x + p in the text as well."""
    periods = sizes // times
    of = np.repeat(np.arange(len(sizes)), periods)
    p = np.arange(len(of)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    n = (sizes[of] - 2 * p - 1) // p + 1  # x + 2p is in the text too
    ends = np.cumsum(n)
    done = 0
    while done < len(of):
        upto = max(done + 1, int(np.searchsorted(ends, ends[done] - n[done] + GRID_POINTS)))
        part = slice(done, upto)
        m, first = n[part], ends[part] - n[part]
        each = np.repeat(p[part], m)
        step = np.arange(m.sum()) - np.repeat(first - first[0], m)
        yield np.repeat(starts[of[part]], m) + step * each, each
        done = upto


def find_runs(texts: Sequence[np.ndarray], min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> list[np.ndarray]:
    """For each text, given as numbers of its words, its runs (start, length, period) by start, then period."""
    if min_times < 3:
        raise ValueError("the grid finds runs of three periods or more")
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    s = np.empty(int((sizes + 1).sum()), np.int64)
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    for k, (t, at) in enumerate(zip(texts, starts, strict=True)):
        s[at : at + len(t)] = t
        s[at + len(t)] = top + k
    found = []
    for x, p in grid(sizes, starts, min_times):
        good = np.flatnonzero(s[x] == s[x + p])
        x, p = x[good], p[good]
        good = (s[x + 1] == s[x + p + 1]) & (s[x + p] == s[x + 2 * p])
        found.append((x[good], p[good]))
    out = [np.empty((0, 3), np.int64)] * len(texts)
    x, p = (np.concatenate([np.empty(0, np.int64), *c]) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
    if not len(x):
        return out
    # Only texts with such points are sorted: their words are moved together, in the same order.
    text = np.searchsorted(starts, x, side="right") - 1
    used = np.unique(text)
    moved = np.cumsum(sizes[used] + 1) - sizes[used] - 1
    packed = np.concatenate([s[starts[k] : starts[k] + sizes[k] + 1] for k in used])
    slot = np.searchsorted(used, text)
    x = x - starts[text] + moved[slot]
    n = len(packed)
    forward, backward = Extensions.of(packed), Extensions.of(np.r_[packed[:-1][::-1], packed[-1]])
    # The word before packed[x] is at n - 1 - x in the reversed order; nothing goes before the first word of all.
    ahead = forward(x, x + p)
    inner = np.flatnonzero(x > 0)
    behind = np.zeros(len(x), np.int64)
    behind[inner] = backward(n - 1 - x[inner], n - 1 - x[inner] - p[inner])
    start, end = x - behind, x + p + ahead
    long = end - start >= np.maximum(min_length, min_times * p)
    rows = np.stack([slot[long], start[long] - moved[slot[long]], (end - start)[long], p[long]], 1)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    if len(rows):
        rows = rows[np.r_[True, (rows[1:, :3] != rows[:-1, :3]).any(1)]]  # of one stretch the smallest period
        rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
        cuts = np.searchsorted(rows[:, 0], np.arange(len(used) + 1))
        for k, a, b in zip(used, cuts, cuts[1:], strict=False):
            out[k] = rows[a:b, 1:]
    return out


def covered(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges)[:-1] > 0


def grown(n: int, doc_id: int | None) -> np.ndarray | None:
    """For one id in ten the words' numbers after a stretch of them is repeated to the end; None for the others."""
    if doc_id is None or not n:
        return None
    g, tenth = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if tenth:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """One row of OUT."""
    digest = lambda b: hashlib.sha256(b).hexdigest()
    if not len(runs):
        return 0, None, None, None, None, digest(b""), digest(b" ".join(words))
    start, length, period = runs.T
    # Quotients of different fractions of this size differ as doubles, too.
    best = runs[np.lexsort((period, start, -(length / period)))[0]].tolist()
    gone = covered(len(words), runs)
    text = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
    listed = "".join(f"{a},{b},{c}\n" for a, b, c in runs.tolist())
    return len(runs), *best, 1000 * best[1] // best[2], digest(listed.encode()), digest(text)


def _groups(words: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Texts that are searched together, as (first, end)."""
    first = held = 0
    for k, w in enumerate(words):
        if k > first and held + len(w) > SLICE_WORDS:
            yield first, k
            first, held = k, 0
        held += len(w)
    if first < len(words):
        yield first, len(words)


def periodic_runs(docs: DataFrame, text: str = "text", grow: str | None = None) -> DataFrame:
    """docs with the columns OUT. With ``grow``, the name of an id column, the words are first changed as in grown()."""
    names = [n for n, _ in OUT]
    docs = docs.select(*[c for c in docs.columns if c.lower() not in names])
    schema = wider(docs, *OUT)
    types = [pa.int64() if kind == "long" else pa.string() for _, kind in OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [(t.as_py() or "").encode("utf-8", "surrogatepass").split() for t in b.column(text)]
            for k, doc_id in enumerate(b.column(grow).to_pylist() if grow else ()):
                at = grown(len(words[k]), doc_id)
                words[k] = words[k] if at is None else [words[k][i] for i in at.tolist()]
            rows: list[tuple] = []
            for first, end in _groups(words):
                number: dict[bytes, int] = {}
                coded = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int64, len(ws)) for ws in words[first:end]]
                rows += [summary(ws, r) for ws, r in zip(words[first:end], find_runs(coded), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in OUT]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [*b.schema.names, *names])

    return docs.mapInArrow(run, schema)


def run_documents(docs: DataFrame) -> DataFrame:
    """doc_id and OUT of documents whose texts are grown by their ids."""
    return periodic_runs(docs.select(docs.doc_id.cast("long").alias("doc_id"), "text"), grow="doc_id").drop("text")
