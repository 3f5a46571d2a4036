"""A compressed set of unit boundaries in a text, with rank and select.

Boundaries are byte positions at which a unit of the UTF-8 text begins.  As in Roaring bitmaps
the positions are dealt to containers by their high bits; each container is kept as runs, as a
sorted array or as a bitmap, whichever is smallest.  Cumulative cardinalities over the containers
find the container of the i-th boundary; a local select finds it there.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import numpy as np

#: Positions of a container.
SPAN = 1 << 16

#: Counts of set bits in the words of a bitmap container.
_WORD = np.dtype("<u8")


@dataclass(frozen=True)
class Runs:
    starts: np.ndarray
    before: np.ndarray  # boundaries in the runs before each run

    def select(self, i: int) -> int:
        run = int(np.searchsorted(self.before, i, side="right")) - 1
        return int(self.starts[run]) + i - int(self.before[run])


@dataclass(frozen=True)
class Array:
    values: np.ndarray

    def select(self, i: int) -> int:
        return int(self.values[i])


@dataclass(frozen=True)
class Bitmap:
    words: np.ndarray
    before: np.ndarray  # boundaries in the words before each word

    def select(self, i: int) -> int:
        at = int(np.searchsorted(self.before, i, side="right")) - 1
        word = int(self.words[at])
        for _ in range(i - int(self.before[at])):
            word &= word - 1  # the lowest set bit goes
        return 64 * at + (word & -word).bit_length() - 1


def container(marks: np.ndarray) -> Runs | Array | Bitmap:
    """The smallest container of the marked positions (booleans, ``SPAN`` at most)."""
    values = np.flatnonzero(marks)
    firsts = np.flatnonzero(np.diff(values, prepend=-2) != 1)
    sizes = {Runs: 4 * len(firsts), Array: 2 * len(values), Bitmap: SPAN // 8}
    kind = min(sizes, key=sizes.get)
    if kind is Runs:
        return Runs(values[firsts].astype(np.uint16), firsts.astype(np.uint32))
    if kind is Array:
        return Array(values.astype(np.uint16))
    padded = np.zeros(SPAN, bool)
    padded[: len(marks)] = marks
    words = np.packbits(padded, bitorder="little").view(_WORD)
    counts = np.bitwise_count(words).astype(np.uint32)
    return Bitmap(words, np.cumsum(counts) - counts)


class BoundarySet:
    """The marked positions of a text and, as the last boundary, its end."""

    def __init__(self, marks: np.ndarray):
        pieces = [marks[at : at + SPAN] for at in range(0, len(marks), SPAN)]
        self.containers = [container(p) for p in pieces]
        self.upto = np.cumsum([np.count_nonzero(p) for p in pieces], dtype=np.int64).tolist()
        self.end = len(marks)

    @classmethod
    def of_code_points(cls, data: bytes) -> BoundarySet:
        return cls(np.frombuffer(data, np.uint8) & 0xC0 != 0x80)

    def __len__(self) -> int:
        """Units of the text."""
        return self.upto[-1] if self.upto else 0

    def select(self, i: int) -> int:
        """The byte at which unit ``i`` begins; the end of the text for ``i`` = number of units."""
        if i == len(self):
            return self.end
        at = bisect_right(self.upto, i)
        return at * SPAN + self.containers[at].select(i - (self.upto[at - 1] if at else 0))
