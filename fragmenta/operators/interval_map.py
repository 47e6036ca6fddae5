"""An ordered map of disjoint intervals, the state behind period merging."""

from __future__ import annotations

from bisect import bisect_left, bisect_right


class IntervalMap:
    """Disjoint closed intervals of integers, ordered by start.

    ``starts`` and ``ends`` are parallel sorted lists; as the intervals are disjoint,
    both ascend, so either can be searched by bisection. ``add`` finds the run of
    stored intervals that the new one overlaps or touches and replaces it by their
    union, so the gaps are always those between stored neighbours.
    """

    __slots__ = ("ends", "starts")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts = list(starts or [])
        self.ends = list(ends or [])

    def __len__(self) -> int:
        return len(self.starts)

    def add(self, start: int, end: int) -> bool:
        """Insert ``[start, end]``; False if it was covered already."""
        lo = bisect_left(self.ends, start)
        hi = bisect_right(self.starts, end, lo)
        if lo == hi:
            self.starts.insert(lo, start)
            self.ends.insert(lo, end)
            return True
        first, last = self.starts[lo], self.ends[hi - 1]
        if first <= start and end <= last and hi - lo == 1:
            return False
        self.starts[lo:hi] = [min(first, start)]
        self.ends[lo:hi] = [max(last, end)]
        return True

    def gaps(self) -> list[tuple[int, int]]:
        """The stretches between neighbours."""
        return list(zip(self.ends, self.starts[1:]))
