"""Strings of a length that occur more than once, from a Burrows-Wheeler transform.

The suffixes are sorted to the depth that matters by prefix doubling. Backward extension then visits intervals of the
transform breadth first, strings of one letter, two letters and so on: the first interval that ends at a boundary of
two suffixes tells how long their common prefix is. Lengths come out in increasing order, each boundary is set once,
and the search stops at the minimum length: boundaries that are not set by then part suffixes that agree that far.
"""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of text (numbers of 0 to 511) in the order of its rotations, of which depth letters count at least."""
    n, letters = len(text), 7
    padded = np.concatenate([text.astype(np.int64), np.resize(text, letters).astype(np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(letters):
        key = (key << 9) | padded[j : j + n]
    order = np.argsort(key, kind="stable")
    new = np.ones(n, bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = first
    while letters < depth:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))  # slots of groups of more than one
        if not len(tied):
            break
        own = order[tied]
        key = rank[own] * n + rank[(own + letters) % n]
        by = np.argsort(key, kind="stable")
        key, own = key[by], own[by]
        order[tied] = own
        fresh = np.ones(len(tied), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[tied] = fresh
        rank[own] = tied[np.maximum.accumulate(np.where(fresh, np.arange(len(tied)), 0))]
        letters *= 2
    return order


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at lo and have size."""
    out = np.ones(int(size.sum()), np.int64)
    ends = np.cumsum(size)
    out[0] = lo[0]
    out[ends[:-1]] = lo[1:] - (lo[:-1] + size[:-1] - 1)
    return np.cumsum(out)


def repeated(text: np.ndarray, length: int) -> np.ndarray:
    """For each position of text (numbers of 0 to 511), whether the length letters from it on, going round at the end, occur elsewhere in text too."""
    n = len(text)
    if n < 2:
        return np.zeros(n, bool)
    order = suffix_order(text, length)
    last = text[order - 1].astype(np.int64)  # the transform; before the first letter comes the final one
    by = np.argsort(last, kind="stable")
    stacked = last[by] * (n + 1) + by  # of letter c and row i: the searched rank is the row that c + suffix i has
    before = np.full(n, -1, np.int64)  # the row before that has the same letter
    same = last[by[1:]] == last[by[:-1]]
    before[by[1:][same]] = by[:-1][same]
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = hi - lo
        rows = _ranges(lo, size)
        left = before[rows] < np.repeat(lo, size)
        letter, of = last[rows[left]], np.repeat(np.arange(len(lo)), size)[left]
        base = letter * (n + 1)
        end = np.searchsorted(stacked, base + hi[of])
        open_ = ~known[end]
        lo = np.searchsorted(stacked, base[open_] + lo[of[open_]])
        hi = end[open_]
        known[hi] = True
        if not len(hi):
            break
    agree = ~known
    out = np.zeros(n, bool)
    out[order] = agree[:n] | agree[1:]
    return out
