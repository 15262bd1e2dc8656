"""Periodic runs of words, found by multi-scale minimizers.

A run is a maximal stretch of words with smallest period q that is long enough in words and
in periods.  Documents are independent, so they are scanned where they lie, without a
shuffle; a task strings the documents of a batch together, longest first, with a word of its
own between them, and works on whole arrays.

* Periods below ``DIRECT`` are read from direct scans at that lag.
* A scale takes the periods from P to below 1.5 P.  Every place gets the hash of the block of
  L words that begins there, L at least each period of the scale; a place whose hash is the
  least of some window of W places is a minimizer.  A run of three periods holds a window and
  the same window one period on, so their minimizers lie a period apart, and as the blocks of
  a primitive root differ at all places within a period, no equal block lies between: pairs
  of neighbouring equal minimizers suffice, one per minimizer at most.
* Each pair is extended to both sides word by word, so hashes decide only where to look.

Block hashes are doubled, mixed at each step, so a scale costs a few passes over the words.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stratalog.llm.common import bounded_batches, free, others
from stratalog.llm.fuse import mix

LEAST_WORDS, LEAST_PERIODS = 24, 3
DIRECT = 8             # periods below this are scanned at their lag
BATCH_WORDS = 1 << 17  # words strung together; a longer document is a batch of its own
_LEFT, _RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
RUN = "start long, length long, period long"
RESULT = f"n_words long, runs array<struct<{RUN}>>, collapsed string"
_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))


def words(text: str | None) -> list[bytes]:
    """The words of a text, unchanged, cut at space and the controls from tab to carriage return."""
    return (text or "").encode().split()


def scales(longest: int) -> Iterator[tuple[int, int]]:
    """P, Q: the periods P .. Q - 1 of each scale, up to what ``longest`` words can repeat."""
    p = DIRECT
    while LEAST_PERIODS * p <= longest:
        q = p + (p + 1) // 2
        yield p, q
        p = q


class Blocks:
    """Hashes of the blocks of any length at all places of a list of numbers."""

    def __init__(self, numbers: np.ndarray):
        self.doubled = [mix(numbers.astype(np.uint64) * _LEFT + np.uint64(1))]

    def of(self, size: int, upto: int) -> np.ndarray:
        """Hashes of the blocks of ``size`` words within the first ``upto`` words."""
        level = size.bit_length() - 1
        while len(self.doubled) <= level:
            held, half = self.doubled[-1], 1 << len(self.doubled) - 1
            self.doubled.append(mix(held[:-half] * _LEFT + held[half:] * _RIGHT)
                                if len(held) > half else held[:0])
        held = self.doubled[level]
        n, shift = max(0, upto - size + 1), size - (1 << level)
        return mix(held[:n] * _LEFT + held[shift:shift + n] * _RIGHT + np.uint64(size))


def least_ahead(values: np.ndarray, window: int) -> np.ndarray:
    """The least of each window, by the place where it begins; only whole windows."""
    out, covered = values, 1
    while covered < window:
        step = min(covered, window - covered)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        covered += step
    return out


def minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some whole window that holds them."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    lows = least_ahead(hashes, window)
    # The highest of the minima of the windows over a place, that is the least negated.
    pad = np.full(window - 1, ~np.uint64(0))
    over = ~least_ahead(np.concatenate([pad, ~lows, pad]), window)
    return np.flatnonzero(over == hashes)


def seeds(blocks: Blocks, upto: int, low: int, high: int) -> Iterator[tuple[int, int]]:
    """place, distance of neighbouring equal minimizers at a distance of the scale, by place."""
    size = high - 1
    hashes = blocks.of(size, upto)
    at = minimizers(hashes, (LEAST_PERIODS - 1) * low - size + 1)
    held = hashes[at]
    order = np.argsort(held, kind="stable")
    held, at = held[order], at[order]
    gap = at[1:] - at[:-1]
    found = np.flatnonzero((held[1:] == held[:-1]) & (gap >= low) & (gap < high))
    order = np.argsort(at[found], kind="stable")
    yield from zip(at[found][order].tolist(), gap[found][order].tolist())


def equal_until(numbers: np.ndarray, i: int, j: int, end: int) -> int:
    """How many words from i on equal those from j on, j + length at most ``end``."""
    n, step = 0, 32
    while j + n < end:
        stop = min(step, end - j - n)
        differ = numbers[i + n:i + n + stop] != numbers[j + n:j + n + stop]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n, step = n + stop, step * 4
    return n


def equal_before(numbers: np.ndarray, i: int, j: int) -> int:
    """How many words before i equal those before j (i < j)."""
    n, step = 0, 32
    while n < i:
        stop = min(step, i - n)
        differ = (numbers[i - n - stop:i - n] != numbers[j - n - stop:j - n])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return n + first
        n, step = n + stop, step * 4
    return n


def primitive(numbers: np.ndarray, start: int, period: int) -> bool:
    """Whether the root is no repetition of a shorter one."""
    root, rest, d = numbers[start:start + period], period, 2
    while rest > 1:
        if d * d > rest:
            d = rest
        if rest % d == 0:
            part = period // d
            if (root[part:] == root[:-part]).all():
                return False
            while rest % d == 0:
                rest //= d
        d += 1
    return True


def runs_of(numbers: np.ndarray, ends: Sequence[int]) -> list[tuple[int, int, int]]:
    """start, length, period of the runs in numbers of documents strung together.

    ``ends`` are where documents end, the longest document first; a number that occurs
    nowhere else stands at each of them.
    """
    longest = ends[0] if len(ends) else 0
    found: set[tuple[int, int, int]] = set()
    for lag in range(1, DIRECT):
        if len(numbers) <= lag:
            break
        edges = np.concatenate([[-1], np.flatnonzero(numbers[lag:] != numbers[:-lag]),
                                [len(numbers) - lag]])
        equal = edges[1:] - edges[:-1] - 1
        for k in np.flatnonzero(equal + lag >= max(LEAST_WORDS, LEAST_PERIODS * lag)):
            if equal[k]:
                found.add((int(edges[k]) + 1, int(equal[k]) + lag, lag))
    sizes = np.diff(ends, prepend=-1) - 1
    blocks = Blocks(numbers)
    for low, high in scales(longest):
        upto = ends[int(np.searchsorted(-sizes, -LEAST_PERIODS * low, side="right")) - 1]
        last: dict[int, int] = {}  # period -> end of its run found last
        for at, period in seeds(blocks, upto, low, high):
            if at + period < last.get(period, 0):
                continue
            start = at - equal_before(numbers, at, at + period)
            length = at - start + equal_until(numbers, at, at + period, len(numbers)) + period
            last[period] = start + length
            if length >= max(LEAST_WORDS, LEAST_PERIODS * period):
                found.add((start, length, period))
    return sorted(x for x in found if primitive(numbers, x[0], x[2]))


def collapsed(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those in no run after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def scan(texts: Sequence[str | None]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """Number of words, runs and collapsed text of each text, in order."""
    cut = [words(t) for t in texts]
    order = sorted(range(len(cut)), key=lambda i: -len(cut[i]))
    out: list = [None] * len(cut)
    at = 0
    while at < len(order):
        part, total = [], 0
        while at < len(order) and (not part or total + len(cut[order[at]]) <= BATCH_WORDS):
            part.append(order[at])
            total += len(cut[order[at]]) + 1
            at += 1
        known: dict[bytes, int] = {}
        numbers = np.empty(total, np.int64)
        ends, place = [], 0
        for k, i in enumerate(part):
            w = cut[i]
            for x in w:
                known.setdefault(x, len(known))
            numbers[place:place + len(w)] = np.fromiter(map(known.__getitem__, w), np.int64, len(w))
            place += len(w)
            numbers[place] = -1 - k
            ends.append(place)
            place += 1
        found = runs_of(numbers, ends)
        begins = [0, *(e + 1 for e in ends[:-1])]
        of: dict[int, list[tuple[int, int, int]]] = {}
        for doc, (start, length, period) in zip(
                np.searchsorted(begins, [r[0] for r in found], side="right") - 1, found):
            of.setdefault(int(doc), []).append((start - begins[doc], length, period))
        for k, i in enumerate(part):
            w, runs = cut[i], of.get(k, [])
            if runs:
                w = [w[j] for j in np.flatnonzero(collapsed(len(w), runs))]
            out[i] = (len(cut[i]), runs, b" ".join(w).decode())
    return out


def _found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = scan(batch.to_pylist())
        yield pa.StructArray.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()),
             pa.array([[dict(zip(("start", "length", "period"), x)) for x in r[1]] for r in rows],
                      _RUNS),
             pa.array([r[2] for r in rows], pa.string())], names=["n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with n_words, runs (start, length, period; by start, then period), collapsed.

    Words end at space and the controls from tab to carriage return.  ``collapsed`` has the
    words outside any run or in the first period of each run that holds them, joined by
    one blank.  Null, empty and blank texts have no words, no runs and an empty
    ``collapsed``.  Repeated rows are all reported, ties of a start are ordered by period;
    columns of the input with one of the new names are replaced; an empty table gives an
    empty one.
    """
    bounded_batches(docs.sparkSession)
    new = ("n_words", "runs", "collapsed")
    kept = others(docs, new)
    found = free("_found", kept)
    return (docs.select(*kept, F.arrow_udf(_found, RESULT)(F.col(text)).alias(found))
            .select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in new]))
