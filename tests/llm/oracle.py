"""Best-fit packing on the counts of lengths alone, one sweep after another: what the distributed sweeps are held against."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, after the last rank, first sequence, pieces in each sequence, offset), sorted.

    counts: how many pieces there are of each length. Its size, and that of all state here, goes with the
    capacity and not with the number of pieces.
    """
    left = {n: c for n, c in counts.items() if c}
    rank = dict.fromkeys(left, 0)
    gaps: dict[int, list[list[int]]] = {}  # by size: runs of (first sequence, how many)
    sizes: list[int] = []  # of gaps, sorted
    rows: list[tuple[int, int, int, int, int, int]] = []
    sequences = 0

    def give(size: int, first: int, n: int) -> None:
        if n and size:
            if size not in gaps:
                insort(sizes, size)
            gaps.setdefault(size, []).append([first, n])

    def place(n: int, size: int, first: int, many: int) -> int:
        """Puts pieces of length n into up to `many` gaps from sequence `first` on; how many gaps it took."""
        each, offset = size // n, capacity - size
        whole, rest = divmod(left[n], each)
        used = min(many, whole)
        last = int(used < many and rest > 0)
        for start, k, per in ((first, used, each), (first + used, last, rest)):
            if k:
                rows.append((n, rank[n], rank[n] + k * per, start, per, offset))
                rank[n] += k * per
                left[n] -= k * per
                fresh.append((size - n * per, start, k))
        if not left[n]:
            del left[n]
        return used + last

    while left:
        fresh: list[tuple[int, int, int]] = []
        meet: dict[int, list[int]] = {}
        for n in sorted(left, reverse=True):  # the longest rank first where they meet
            at = bisect_left(sizes, n)
            if at < len(sizes):
                meet.setdefault(sizes[at], []).append(n)
        for size, lengths in meet.items():
            runs = gaps.pop(size)
            del sizes[bisect_left(sizes, size)]
            for n in lengths:
                while n in left and runs:
                    first, many = runs.pop()
                    used = place(n, size, first, many)
                    if used < many:
                        runs.append([first + used, many - used])
            for first, many in runs:
                give(size, first, many)
        if not meet:
            longest = max(left)
            alone = sorted((n for n in left if 2 * n > capacity), reverse=True) or [longest]  # these can't share
            for n in alone:
                many = -(-left[n] // (capacity // n))
                place(n, capacity, sequences, many)
                sequences += many
        for size, first, many in fresh:
            give(size, first, many)
    return np.array(sorted(rows), np.int64).reshape(-1, 6)
