"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q and at least ``max(12, 2q)``
words that cannot be extended. All runs of a text are found:

* Names: words are numbered, and every stretch of 2^k words gets the number of
  its pair of halves, so that equal numbers are equal stretches, without doubt.
  They answer how far two places of a text agree, by halving.
* Small periods (below ``4 * base``) are detected on their own: a run of period q
  covers one of the places 0, L, 2L, ... for a fitting stride L, where a word
  equals the one q further.
* Larger ones at dyadic scales t = base, 2 base, ...: a place is selected if the
  hashed name of the t words at it, or t words further, is the least of all
  starts in between; starts inside highly periodic regions (runs found so far of
  a period up to t/3) do not take part. What is selected depends on the 2t words
  at a place alone, so a run of period q in [4t, 8t) holds two selected places q
  apart with equal contexts, unless its first q words lie in a highly periodic
  region. Selected places of one context less than 8t apart propose their
  distance.
* Where they do, the q words after them lie in another region of the same small
  period. Such neighbouring regions propose all distances that bring them in
  phase.

Every proposal is extended to both sides and kept if long enough; the smallest
period of a stretch stays. The texts of a batch are laid end to end, the longest
first and each closed by a number of its own, and go through numpy together in
blocks of ``BLOCK`` words or one longer text. Nothing is shuffled.

Null and empty texts have no words and no runs. Equal rows give equal results, an
empty table none; very long texts are blocks of their own (some 4 bytes for each
word and dyadic length). Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from cartwheel.llm.rows import slim

LEAST = 12
BASE = 16
BLOCK = 1 << 18

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


class Runs(NamedTuple):
    """Runs as three arrays: start, end (exclusive) and smallest period."""

    start: np.ndarray
    end: np.ndarray
    period: np.ndarray


def _mixed(names: np.ndarray) -> np.ndarray:
    """A hash that puts names in an order of its own."""
    x = names.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Block:
    """Texts laid end to end, as numbers; ``sizes`` fall."""

    def __init__(self, numbers: np.ndarray, sizes: Sequence[int], base: int = BASE, least: int = LEAST) -> None:
        self.base, self.least = base, least
        # Shorter runs are of use to smaller scales than the first one only.
        self.needed = min(least, base)
        ends = np.cumsum(np.asarray(sizes, np.int64) + 1)
        spread = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        spread[ends - 1] = -1 - np.arange(len(ends))
        spread[spread == 0] = numbers
        names, _ = pd.factorize(spread)
        self.names = [names.astype(np.int32)]
        falling = -np.asarray(sizes, np.int64)
        longest = -int(falling[0]) if len(ends) else 0
        while (1 << len(self.names)) <= longest:
            length = 1 << len(self.names)
            part = int(ends[np.searchsorted(falling, -length, "right") - 1])
            self.names.append(self._paired(self.names[-1][:part], length // 2))
        self._ends, self._falling, self.longest = ends, falling, longest

    @staticmethod
    def _paired(halves: np.ndarray, half: int) -> np.ndarray:
        """Names of stretches of two halves; those that reach over the end are all different."""
        pairs = (halves[:-half].astype(np.int64) << 32) | halves[half:]
        names, known = pd.factorize(pairs)
        return np.concatenate([names, len(known) + np.arange(half)]).astype(np.int32)

    def prefix(self, length: int) -> int:
        """Where the texts of at least ``length`` words end."""
        n = int(np.searchsorted(self._falling, -length, "right"))
        return int(self._ends[n - 1]) if n else 0

    def agree_after(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from x < y on are equal."""
        x, y = x.copy(), y.copy()
        first = x.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            inside = y < len(names)
            same = np.zeros(len(x), bool)
            same[inside] = names[x[inside]] == names[y[inside]]
            step = same.astype(np.int64) << k
            x += step
            y += step
        return x - first

    def agree_before(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words before x < y are equal."""
        x, y = x.copy(), y.copy()
        first = x.copy()
        for k in range(len(self.names) - 1, -1, -1):
            names = self.names[k]
            inside = (x >= 1 << k) & (y - (1 << k) < len(names))
            same = np.zeros(len(x), bool)
            same[inside] = names[x[inside] - (1 << k)] == names[y[inside] - (1 << k)]
            step = same.astype(np.int64) << k
            x -= step
            y -= step
        return first - x

    def extended(self, at: np.ndarray, period: np.ndarray) -> Runs:
        """The stretches around places where a period is proposed, if they are long enough; each once."""
        start = at - self.agree_before(at, at + period)
        end = at + period + self.agree_after(at, at + period)
        good = end - start >= np.maximum(self.needed, 2 * period)
        return _smallest(Runs(start[good], end[good], period[good]))

    def small(self, limit: int) -> Runs:
        """All runs of a period below ``limit``."""
        names, places, periods = self.names[0], [], []
        for q in range(1, min(limit, len(names))):
            stride = max(self.needed - q, q)
            at = np.arange(0, len(names) - q, stride)
            at = at[names[at] == names[at + q]]
            places.append(at)
            periods.append(np.full(len(at), q, np.int64))
        if not places:
            return _NONE
        return self.extended(np.concatenate(places), np.concatenate(periods))

    def selected(self, k: int, part: int, known: Runs) -> np.ndarray:
        """The synchronising set of scale t = 2^k in the first ``part`` words."""
        t = 1 << k
        starts = part - t + 1
        if starts <= t:
            return np.empty(0, np.int64)
        rank = _mixed(self.names[k][:starts])
        periodic = (3 * known.period <= t) & (known.end - known.start >= t) & (known.end <= part)
        change = np.zeros(starts + 1, np.int64)
        np.add.at(change, known.start[periodic], 1)
        np.add.at(change, known.end[periodic] - t + 1, -1)
        never = np.uint64(0xFFFFFFFFFFFFFFFF)
        rank[np.cumsum(change[:-1]) > 0] = never
        lowest = rank
        for j in range(k):
            step = 1 << j
            lowest = np.minimum(lowest[:-step], lowest[step:])
        lowest = np.minimum(lowest[:-1], lowest[1:])
        n = len(lowest)
        picked = (lowest != never) & ((lowest == rank[:n]) | (lowest == rank[t : t + n]))
        return np.flatnonzero(picked)

    def alike(self, places: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) of selected places of scale 2^k with one context, 4t to 8t apart."""
        t = 1 << k
        names = self.names[k + 1]
        places = places[places < len(names)]
        context = names[places]
        order = np.lexsort((places, context))
        places, context = places[order], context[order]
        at, apart, step = [], [], 1
        while step < len(places):
            same = context[step:] == context[:-step]
            distance = places[step:] - places[:-step]
            near = same & (distance < 8 * t)
            if not near.any():
                break
            found = near & (distance >= 4 * t)
            at.append(places[:-step][found])
            apart.append(distance[found])
            step += 1
        if not at:
            return _NOWHERE
        return np.concatenate(at), np.concatenate(apart)

    def in_phase(self, known: Runs, t: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, distance) that neighbouring regions of one period up to t/3 propose for 4t to 8t."""
        part = (3 * known.period <= t) & (known.end - known.start >= 4 * t)
        start, end, period = (column[part] for column in known)
        order = np.lexsort((start, period))
        start, end, period = start[order], end[order], period[order]
        # Regions of one period overlap by less than it, so only the next one can touch a region.
        touch = np.flatnonzero((period[1:] == period[:-1]) & (start[1:] <= end[:-1]))
        if not len(touch):
            return _NOWHERE
        # Where in a region the first words of the next one stand.
        shifts = np.repeat(touch, period[touch])
        shift = np.arange(len(shifts)) - np.repeat(np.cumsum(period[touch]) - period[touch], period[touch])
        fits = self.agree_after(start[shifts] + shift, start[shifts + 1]) >= period[shifts]
        places, distances = [], []
        for i, r in zip(shifts[fits].tolist(), shift[fits].tolist(), strict=True):
            p, b1, e1, b2, e2 = (int(v) for v in (period[i], start[i], end[i], start[i + 1], end[i + 1]))
            low, high = 4 * t, min(8 * t - 1, e1 - b1, e2 - b2, (e2 - b1) // 2)
            q = np.arange(low + (b2 - b1 - r - low) % p, high + 1, p)
            places.append(np.maximum(b1, b2 - q))
            distances.append(q)
        return (np.concatenate(places), np.concatenate(distances)) if places else _NOWHERE

    def runs(self) -> Runs:
        """All runs, by start and period."""
        known = self.small(4 * self.base)
        t = self.base
        while (part := self.prefix(8 * t)) > 0:
            k = t.bit_length() - 1
            for at, period in (self.alike(self.selected(k, part, known), k), self.in_phase(known, t)):
                if len(at):
                    known = _smallest(Runs(*map(np.concatenate, zip(known, self.extended(at, period), strict=True))))
            t *= 2
        long = known.end - known.start >= self.least
        return _smallest(Runs(*(column[long] for column in known)))


_NOWHERE = (np.empty(0, np.int64), np.empty(0, np.int64))
_NONE = Runs(*[np.empty(0, np.int64)] * 3)


def _smallest(found: Runs) -> Runs:
    """Each stretch once, with its smallest period."""
    order = np.lexsort((found.period, found.end, found.start))
    start, end, period = (column[order] for column in found)
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return Runs(start[order], end[order], period[order])


def found_in(texts: Sequence[Sequence[bytes]], base: int = BASE, least: int = LEAST) -> list[Runs]:
    """The runs of every text (a list of words), places counted from its first word."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number = defaultdict(count(1).__next__)
    numbers = np.fromiter((number[word] for i in order for word in texts[i]), np.int64)
    sizes = [len(texts[i]) for i in order]
    block = Block(numbers, sizes, base, least)
    runs = block.runs()
    ends = np.cumsum(np.asarray(sizes, np.int64) + 1)
    owner = np.searchsorted(ends, runs.start, "right")
    cuts = np.searchsorted(owner, np.arange(len(texts) + 1))
    out: list[Runs] = [_NONE] * len(texts)
    for place in np.unique(owner).tolist():
        offset = ends[place] - sizes[place] - 1
        start, end, period = (column[cuts[place] : cuts[place + 1]] for column in runs)
        out[order[place]] = Runs(start - offset, end - offset, period)
    return out


def repeated(n: int, runs: Runs) -> np.ndarray:
    """Which of n words a run repeats: those after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs.start + runs.period, 1)
    np.add.at(change, runs.end, -1)
    return np.cumsum(change[:-1]) > 0


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space."""
    return text.encode().split()


def with_planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with a period from some word on, by the hash of the id; a null id keeps its words."""
    n = len(words)
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)


def _digest(doc_id: int | None, words: list[bytes], runs: Runs) -> tuple:
    rows = list(zip(runs.start.tolist(), (runs.end - runs.start).tolist(), runs.period.tolist(), strict=True))
    listed = "".join([f"{start},{length},{period}\n" for start, length, period in rows])
    kept = words
    if rows:
        kept = [word for word, gone in zip(words, repeated(len(words), runs).tolist(), strict=True) if not gone]
    start, length, period = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (
        doc_id,
        len(rows),
        start,
        length,
        period,
        1000 * length // period if rows else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def _blocks(batches: Iterator[pa.RecordBatch], rewrite: Rewrite | None, block: int) -> Iterator[list[tuple]]:
    """(doc_id, words) of all rows, in blocks of some ``block`` words."""
    held, size = [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = words_of(text.as_py() or "")
            held.append((doc_id, rewrite(doc_id, words) if rewrite else words))
            size += len(words) + 1
            if size >= block:
                yield held
                held, size = [], 0
    if held:
        yield held


def report(docs: DataFrame, rewrite: Rewrite | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: number of runs, the longest one, digests of all runs and of the text without repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, rewrite, block):
            found = found_in([words for _, words in held])
            rows = [_digest(doc_id, words, runs) for (doc_id, words), runs in zip(held, found, strict=True)]
            kinds = (*[pa.int64()] * 6, pa.string(), pa.string())
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = [part.split()[0] for part in SCHEMA.split(", ")]
    return slim(docs).mapInArrow(run, SCHEMA)


def all_runs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, start, length and period of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, None, block):
            for (doc_id, _), found in zip(held, found_in([words for _, words in held]), strict=True):
                if n := len(found.start):
                    columns = ([doc_id] * n, found.start, found.end - found.start, found.period)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    names = ["doc_id", "start", "length", "period"]
    return slim(docs).mapInArrow(run, ", ".join(f"{name} long" for name in names))


def collapsed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id and text with every run cut to its first period; words are joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _blocks(batches, None, block):
            out = []
            for (_, words), found in zip(held, found_in([words for _, words in held]), strict=True):
                gone = repeated(len(words), found).tolist()
                out.append(b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
            ids = pa.array([doc_id for doc_id, _ in held], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.string())], ["doc_id", "text"])

    return slim(docs).mapInArrow(run, "doc_id long, text string")
