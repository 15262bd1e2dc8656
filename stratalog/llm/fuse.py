"""Static binary-fuse filters over 64-bit keys, built and asked with numpy.

A key has one slot in each of three neighbouring segments and the filter holds one byte per
slot so that the three bytes of a member xor to its fingerprint.  Slots that only one key
uses are peeled off round by round, all of a round at once, and bytes are given out in the
reverse order.  About 1.13 bytes a key on large sets, false positives 1 in 256, members
never missed.
"""

from __future__ import annotations

import math

import numpy as np

_U = np.uint64
# Multipliers and shifts of the 64-bit finaliser by Stafford (variant 13): fixed values.
_MIX = ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; wraps around."""
    for shift, factor in _MIX:
        x = (x ^ (x >> _U(shift))) * _U(factor)
    return x ^ (x >> _U(31))


def geometry(n: int) -> tuple[int, int]:
    """Length of a segment (a power of two) and number of segments for n keys."""
    length = 1 << min(18, max(2, int(math.log(max(n, 2)) / math.log(3.33) + 2.25)))
    room = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    return length, max(3, math.ceil(n * room / length) + 2)


def slots(keys: np.ndarray, seed: int, length: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key (one row per slot) and its fingerprint."""
    h = mix(keys + _U(seed))
    first = ((h >> _U(32)) * _U(segments - 2) >> _U(32)).astype(np.int64) * length
    # Three windows of 18 bits, as long as a segment can be, and a byte of a second hash.
    h = mix(h)
    inside = np.stack([(h >> _U(s)).astype(np.int64) & (length - 1) for s in (0, 18, 36)])
    return first + np.arange(3)[:, None] * length + inside, (h >> _U(56)).astype(np.uint8)


def build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """seed, segment length, segments, bytes for a set of uint64 keys (repeats are dropped)."""
    keys = np.unique(keys.astype(np.uint64))
    length, segments = geometry(len(keys))
    for seed in range(1, 200):
        place, print_ = slots(keys, seed, length, segments)
        order = _peel(place, length * segments)
        if order is not None:
            out = np.zeros(length * segments, np.uint8)
            for key, slot in reversed(order):
                out[slot] = 0
                p = place[:, key]
                out[slot] = print_[key] ^ out[p[0]] ^ out[p[1]] ^ out[p[2]]
            return seed, length, segments, out.tobytes()
        if seed % 10 == 0:
            segments += max(1, segments // 8)
    raise RuntimeError("no seed peels these keys")


def _peel(place: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    n = place.shape[1]
    count = np.bincount(place.ravel(), minlength=size)
    mixed = np.zeros(size, np.int64)  # xor of the keys in a slot: the key itself once it is alone
    for row in place:
        np.bitwise_xor.at(mixed, row, np.arange(n))
    alone, order, done = np.flatnonzero(count == 1), [], 0
    while len(alone):
        key, at = np.unique(mixed[alone], return_index=True)
        order.append((key, alone[at]))
        done += len(key)
        for row in place[:, key]:
            np.subtract.at(count, row, 1)
            np.bitwise_xor.at(mixed, row, key)
        touched = np.unique(place[:, key])
        alone = touched[count[touched] == 1]
    return order if done == n else None


def contains(keys: np.ndarray, seed: int, length: int, segments: int, data: bytes) -> np.ndarray:
    place, print_ = slots(keys.astype(np.uint64), seed, length, segments)
    f = np.frombuffer(data, np.uint8)
    return f[place[0]] ^ f[place[1]] ^ f[place[2]] == print_
