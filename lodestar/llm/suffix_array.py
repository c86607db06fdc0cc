"""Suffix arrays by induced sorting, and the common prefixes of neighbours in text order (permuted LCP)."""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int], top: int) -> list[int]:
    """Positions of s (values from 0 to top) in the order of the suffixes that begin there; time in proportion to len(s) + top.

    A suffix is S if it is less than the next one, else L; an S after an L is leftmost-S. The leftmost-S ones are sorted
    by their substrings (to the next leftmost-S), equal substrings get equal names, and if names repeat the string of names is
    sorted by recursion; from their order that of the L suffixes follows, and from theirs that of the S suffixes."""
    n = len(s)
    if n < 2:
        return list(range(n))
    a = np.asarray(s, np.int64)
    # classes: where neighbours are equal the class is that of the next unequal pair; the last suffix is L
    less = np.append(np.sign(a[1:] - a[:-1]), -1)
    known = np.flatnonzero(less)
    is_s = (less[known] > 0)[np.searchsorted(known, np.arange(n))]
    left = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    size = np.bincount(a, minlength=top + 1)
    small = np.bincount(a[is_s], minlength=top + 1)
    end = np.cumsum(size)
    heads, first_s, ends = (end - size).tolist(), (end - small).tolist(), end.tolist()
    kind = is_s.tolist()

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        at = first_s.copy()
        for i in order:
            c = s[i]
            sa[at[c]] = i
            at[c] += 1
        at = heads.copy()
        c = s[n - 1]
        sa[at[c]] = n - 1
        at[c] += 1
        for i in range(n):
            j = sa[i] - 1
            if j >= 0 and not kind[j]:
                c = s[j]
                sa[at[c]] = j
                at[c] += 1
        at = ends.copy()
        for i in range(n - 1, -1, -1):
            j = sa[i] - 1
            if j >= 0 and kind[j]:
                c = s[j]
                at[c] = k = at[c] - 1
                sa[k] = j
        return sa

    if not len(left):
        return induce([])
    sa = induce(left.tolist())
    place = np.full(n, -1, np.int64)
    place[left] = np.arange(len(left))
    order = place[np.asarray(sa)]
    order = order[order >= 0]  # leftmost-S suffixes, by number, sorted by their substrings
    stop = np.append(left[1:] + 1, n)
    names = [0] * len(left)
    name, before = 0, -1
    starts, stops, sorted_ = left.tolist(), stop.tolist(), order.tolist()
    for x in sorted_:
        if before >= 0:
            b, e = starts[before], starts[x]
            # the last one has no end mark after it, so it equals no other
            if x == len(starts) - 1 or before == len(starts) - 1 or s[b : stops[before]] != s[e : stops[x]]:
                name += 1
        names[x] = name
        before = x
    if name + 1 < len(left):
        order = np.asarray(suffix_array(names, name))
    return induce(left[order].tolist())


def permuted_lcp(s: list[int], sa: list[int]) -> list[int]:
    """For each position the length that its suffix shares with the one before it in the suffix array; linear time."""
    n = len(s)
    before = [-1] * n
    last = -1
    for i in sa:
        before[i] = last
        last = i
    out, k = [0] * n, 0
    for i in range(n):
        j = before[i]
        if j < 0:
            k = 0
            continue
        most = n - max(i, j)
        while k < most and s[i + k] == s[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return out
