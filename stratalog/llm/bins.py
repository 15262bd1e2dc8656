"""Bin completion over a histogram of lengths.

Documents of one length are alike, so a packing is a list of patterns: lengths with their
number per bin, and how many bins are filled that way.  A histogram has at most ``capacity``
lengths whatever the corpus, and so has the work.

Best-fit decreasing gives the incumbent.  If it needs more bins than the lower bound, a
depth-first search fills bins around the largest length left.  It enumerates the fillings of
the rest that no other dominates, in the order of what they waste: maximal ones, where no length
left over could replace one item or two and still fit.  Sums that the lengths can reach are known
beforehand as bits, so the enumeration never walks into a dead end; it is lazy, and goes on where
it stopped when a branch has failed.  A filling is used as often as the counts allow, then less often.  A branch is given
up when its waste, or the lower bound of what is left, rules out a better packing, or when
the same lengths were left before in as few bins.  The search stops at the lower bound or
after ``nodes`` fillings, dominated ones counted, its only limit; the incumbent is then the
answer, so a limit never drops a document.
"""

from __future__ import annotations

import random
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from itertools import islice

FEW_LENGTHS = 40  # with no more lengths left, a branch is also held against their lower bound
HELD = 32         # nodes whose enumeration is kept; one further up is begun again when it is its turn


@dataclass(frozen=True)
class Pattern:
    """``times`` bins, each with these (length, number) pairs."""

    items: tuple[tuple[int, int], ...]
    times: int


def lower_bound(counts: Mapping[int, int], capacity: int) -> int:
    """Bins that any packing needs: for each k, lengths over capacity - k share a bin with none
    of at least k, lengths over half with none another, and the rest fills what is left."""
    total = sum(n * c for n, c in counts.items())
    best = -(-total // capacity)
    for k in sorted({n for n in counts if 2 * n <= capacity} | {0}):
        alone = sum(c for n, c in counts.items() if n > capacity - k)
        big = [(n, c) for n, c in counts.items() if capacity - k >= n and 2 * n > capacity]
        small = sum(n * c for n, c in counts.items() if k <= n and 2 * n <= capacity)
        pairs = sum(c for _, c in big)
        room = pairs * capacity - sum(n * c for n, c in big)
        best = max(best, alone + pairs + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: Mapping[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing, all bins of one filling at a time."""
    open_: dict[int, Counter] = {}  # room -> fillings -> bins
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            room = min((r for r in open_ if r >= length), default=None)
            if room is None:
                filling, bins, room = (), -(-left // (capacity // length)), capacity
            else:
                filling, bins = next(iter(open_[room].items()))
            each = min(room // length, left)
            use = min(bins, left // each)
            if room < capacity:
                open_[room][filling] -= use
                if not open_[room][filling]:
                    del open_[room][filling]
                if not open_[room]:
                    del open_[room]
            new = (*filling, (length, each))
            open_.setdefault(room - each * length, Counter())[new] += use
            left -= each * use
    return [Pattern(f, n) for fillings in open_.values() for f, n in fillings.items()]


def fillings(counts: Mapping[int, int], room: int, waste: int
             ) -> Iterator[tuple[tuple[int, int], ...] | None]:
    """Undominated fillings of ``room`` that leave at most ``waste``, the fullest first, lazily; None
    for a dominated one, so that the caller can count what it costs to go on."""
    lengths = sorted((n for n, c in counts.items() if c and n <= room), reverse=True)
    rising = lengths[::-1]
    mask = (1 << room + 1) - 1
    reach = [1] * (len(lengths) + 1)  # bit s: the lengths from here on have the sum s
    for i in range(len(lengths) - 1, -1, -1):
        n, bits = lengths[i], reach[i + 1]
        left, part = min(counts[n], room // n), 1
        while left:
            part = min(part, left)
            bits |= bits << n * part & mask
            left, part = left - part, part * 2
        reach[i] = bits

    def exact(at: int, target: int, chosen: tuple[tuple[int, int], ...]) -> Iterator[tuple]:
        if not target:
            yield chosen
            return
        for i in range(at, len(lengths)):
            n = lengths[i]
            for k in range(min(counts[n], target // n), 0, -1):
                if reach[i + 1] >> target - n * k & 1:
                    yield from exact(i + 1, target - n * k, (*chosen, (n, k)))
            if not reach[i + 1] >> target & 1:
                return

    def dominated(chosen: tuple[tuple[int, int], ...], rest: int) -> bool:
        used = dict(chosen)
        items = [n for n, k in chosen for _ in range(min(k, 2))]

        return any(used.get(n, 0) < counts[n]
                   for s in {0, *items, *(a + b for i, a in enumerate(items) for b in items[i + 1:])}
                   for n in rising[bisect_right(rising, s):bisect_right(rising, s + rest)])

    for rest in range(min(waste, room) + 1):
        if reach[0] >> room - rest & 1:
            for chosen in exact(0, room - rest, ()):
                yield None if rest and dominated(chosen, rest) else chosen


def complete(counts: Mapping[int, int], capacity: int, nodes: int = 5_000) -> list[Pattern]:
    """The patterns of the best packing found; every item of the histogram is in one."""
    counts = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("a length does not fit a bin")
    best = best_fit(counts, capacity)
    bins, least = sum(p.times for p in best), lower_bound(counts, capacity)
    total = sum(n * c for n, c in counts.items())
    left, done, used, visited = dict(counts), [], 0, 0
    # What is left, as one number: a sum of random numbers of 128 bits, one per length.
    rng = random.Random(1)
    mark = {n: rng.getrandbits(128) for n in sorted(counts)}
    state, seen = sum(mark[n] * c for n, c in counts.items()), {}

    def branches(tried: tuple | None) -> Iterator[tuple[tuple | None, int]]:
        """A filling with a number of uses each; the filling used just before is not tried again."""
        largest = max(left)
        now = {**left, largest: left[largest] - 1}
        waste = (bins - 1) * capacity - total - (used * capacity - total + sum(
            n * c for n, c in left.items()))
        for chosen in fillings(now, capacity - largest, waste):
            if chosen is None:
                yield None, 0
                continue
            items = Counter({largest: 1})
            items.update(dict(chosen))
            pattern = tuple(sorted(items.items(), reverse=True))
            if pattern != tried:
                for times in range(min(left[n] // k for n, k in pattern), 0, -1):
                    yield pattern, times

    def apply(pattern: tuple, times: int) -> None:
        nonlocal used, state
        used += times
        for n, k in pattern:
            left[n] = left.get(n, 0) - k * times
            state -= mark[n] * k * times
            if not left[n]:
                del left[n]

    def hopeless() -> bool:
        rest = sum(n * c for n, c in left.items())
        need = -(-rest // capacity)
        if len(left) <= FEW_LENGTHS:
            need = max(need, lower_bound(left, capacity))
        if used + need >= bins or seen.get(state, bins) <= used:
            return True
        seen[state] = used
        return False

    # Nodes from the root down: the filling used before, how many branches were taken, their source.
    stack: list[list] = [[None, 0, None]] if bins > least else []
    while stack and visited < nodes:
        if len(done) == len(stack):
            pattern = done.pop()
            apply(pattern.items, -pattern.times)
        node = stack[-1]
        if node[2] is None:
            node[2] = islice(branches(node[0]), node[1], None)
        found = next(node[2], None)
        if found is None:
            stack.pop()
            continue
        visited += 1
        node[1] += 1
        pattern, times = found
        if pattern is None:
            continue
        apply(pattern, times)
        done.append(Pattern(pattern, times))
        if left:
            if not hopeless():
                stack.append([pattern, 0, None])
                if len(stack) > HELD:
                    stack[-HELD - 1][2] = None
            continue
        if used < bins:
            best, bins = list(done), used
            if bins <= least:
                return best
    return best
