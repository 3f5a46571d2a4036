"""Minimal perfect hash over the keys of one shard, with stored fingerprints.

Hash and displace: keys fall into small buckets; buckets, the largest first, look for a
displacement which sends all their keys to free slots.  ``n`` keys take ``n`` slots, a look-up
costs two hashes and one comparison, and a key which was never stored is refused by its
fingerprint but for one in 2**32.
"""

from __future__ import annotations

import numpy as np

_KEYS_A_BUCKET = 4
#: The mixing constants of the splitmix64 generator.
_MIX_1, _MIX_2, _STEP = (np.uint64(c) for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(keys: np.ndarray, salt) -> np.ndarray:
    """64-bit hashes of integers; ``salt`` is a number or one number a key."""
    with np.errstate(over="ignore"):
        x = np.asarray(keys).astype(np.uint64) + _STEP * (np.asarray(salt).astype(np.uint64) + np.uint64(1))
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, salt, n: int) -> np.ndarray:
    return (mix(keys, salt) % np.uint64(n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, 0) >> np.uint64(32)).astype("<u4")


def build(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacement of each bucket, and the position in ``keys`` for each slot.

    ``keys``: distinct 64-bit integers.  Displacements below zero name a slot outright.
    """
    n = len(keys)
    buckets = max(1, -(-n // _KEYS_A_BUCKET))
    moves, place = np.zeros(buckets, "<i4"), np.full(n, -1, "<i4")
    if not n:
        return moves, place
    bucket = _slots(keys, 1, buckets)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=buckets)
    ends = np.cumsum(sizes)
    for b in np.argsort(-sizes, kind="stable"):
        if sizes[b] < 2:
            break
        own = order[ends[b] - sizes[b] : ends[b]]
        first = 2
        while True:
            tries = np.arange(first, first + 16)
            spots = _slots(np.repeat(keys[own][None, :], 16, 0), tries[:, None], n)
            good = (place[spots] < 0).all(1) & (np.diff(np.sort(spots, 1), axis=1) > 0).all(1)
            if good.any():
                k = int(good.argmax())
                moves[b], place[spots[k]] = tries[k], own
                break
            first += 16
    single, free = np.flatnonzero(sizes == 1), np.flatnonzero(place < 0)
    owners = order[ends[single] - 1]
    moves[single], place[free] = -1 - free, owners
    return moves, place


def look_up(keys: np.ndarray, moves: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Slot of each key, or -1 where the fingerprint says that it was never stored."""
    n = len(marks)
    if not n or not len(keys):
        return np.full(len(keys), -1, np.int64)
    move = moves[_slots(keys, 1, len(moves))].astype(np.int64)
    slot = np.where(move < 0, -1 - move, _slots(keys, np.maximum(move, 0), n))
    return np.where(marks[slot] == fingerprints(keys), slot, -1)
