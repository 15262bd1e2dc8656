"""A k-way merge of sorted runs with a loser tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any


class _End:
    """Sorts after everything."""


def merge(runs: Iterable[Iterable[Any]]) -> Iterator[Any]:
    """The items of sorted runs in order, ties by the order of the runs.

    Inner nodes hold the losers of their games and the overall winner stands above them; the
    next item of the winner's run replays only the games on its way up, log k comparisons.
    """
    sources = [iter(r) for r in runs]
    k = len(sources)
    head: list[Any] = [next(s, _End) for s in sources]

    def beats(a: int, b: int) -> bool:
        if head[a] is _End or head[b] is _End:
            return head[b] is _End and (head[a] is not _End or a < b)
        return head[a] < head[b] or (not head[b] < head[a] and a < b)

    # Leaf i is node k + i; the first games fill the losers from the bottom up.
    loser, winner = [0] * max(k, 1), [0] * (2 * max(k, 1))
    for i in range(k):
        winner[k + i] = i
    for node in range(k - 1, 0, -1):
        a, b = winner[2 * node], winner[2 * node + 1]
        winner[node], loser[node] = (a, b) if beats(a, b) else (b, a)
    best = winner[1] if k > 1 else 0
    while k and head[best] is not _End:
        yield head[best]
        head[best] = next(sources[best], _End)
        node = (k + best) // 2
        while node:
            if beats(loser[node], best):
                loser[node], best = best, loser[node]
            node //= 2
