"""Suffix arrays by induced sorting, a bucket at a time on NumPy arrays.

Suffixes are classified as smaller (S) or larger (L) than their right
neighbour; leftmost-smaller substrings are sorted by one induction, named, and
the string of their names is sorted recursively; a second induction places all
suffixes.  An induction goes over the buckets once, and every entry is moved
once, so a shard costs linear work; the recursion goes on until all names differ,
with however many letters, and each level is at most half as long as the one above.
"""

from __future__ import annotations

import numpy as np

def _induce(s: np.ndarray, larger: np.ndarray, lms: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffixes of ``s`` in order, given its leftmost-smaller ones in order
    (``lms``; only their first letters need be in order for the first pass)."""
    sa = np.full(len(s), -1, np.int64)
    used = np.flatnonzero(end > start)
    seeds = np.split(lms, np.searchsorted(s[lms], used[1:]))
    fill = start.copy()

    def place(j: np.ndarray, pointer: np.ndarray, sign: int) -> None:
        letter = s[j]
        order = np.argsort(letter, kind="stable")
        j, letter = j[order], letter[order]
        new = np.concatenate([[True], letter[1:] != letter[:-1]])
        first = np.flatnonzero(new)
        rank = np.arange(len(j)) - first[np.cumsum(new) - 1]
        sa[pointer[letter] + sign * rank - (sign < 0)] = j
        pointer[letter[first]] += sign * np.diff(np.append(first, len(j)))

    for c, seed in zip(used.tolist(), seeds):
        at = start[c]
        while at < fill[c]:
            j, at = sa[at : fill[c]] - 1, fill[c]
            j = j[j >= 0]
            if len(j := j[larger[j]]):
                place(j, fill, 1)
        j = seed - 1
        if len(j := j[j >= 0]):
            place(j, fill, 1)
    tail = end.copy()
    for c in used[::-1].tolist():
        at = end[c]
        while at > tail[c]:
            j, at = sa[tail[c] : at][::-1] - 1, tail[c]
            j = j[j >= 0]
            if len(j := j[~larger[j]]):
                place(j, tail, -1)
        j = sa[start[c] : fill[c]][::-1] - 1
        j = j[j >= 0]
        if len(j := j[~larger[j]]):
            place(j, tail, -1)
    return sa


def _induce_singly(s: list[int], larger: list[bool], lms: list[int], start: list[int], end: list[int]) -> np.ndarray:
    """As ``_induce``, entry by entry: where buckets hold a few suffixes each, as those
    of names do, array operations on each bucket cost more than its entries."""
    sa, tail, head = [-1] * len(s), end.copy(), start.copy()
    for j in reversed(lms):
        tail[s[j]] -= 1
        sa[tail[s[j]]] = j
    for i in range(len(s)):
        j = sa[i] - 1
        if j >= 0 and larger[j]:
            c = s[j]
            sa[head[c]] = j
            head[c] += 1
    tail = end.copy()
    for i in range(len(s) - 1, -1, -1):
        j = sa[i] - 1
        if j >= 0 and not larger[j]:
            c = s[j]
            tail[c] -= 1
            sa[tail[c]] = j
    return np.array(sa, np.int64)


def suffix_array(s: np.ndarray, letters: int) -> np.ndarray:
    """Suffix array of ``s`` (integers in [0, letters)), whose last letter is
    smaller than all others and unique."""
    n = len(s)
    if n < 3:
        return np.argsort(s, kind="stable")
    s = s.astype(np.int16 if letters < 1 << 15 else np.int32)
    differs = np.flatnonzero(s[:-1] != s[1:])
    next_change = differs[np.searchsorted(differs, np.arange(n - 1))]
    larger = np.zeros(n, bool)
    larger[:-1] = s[next_change] > s[next_change + 1]
    lms = np.flatnonzero(~larger[1:] & larger[:-1]) + 1
    count = np.bincount(s, minlength=letters)
    end = np.cumsum(count)
    start = end - count
    if len(s) < 64 * letters:
        lists = s.tolist(), larger.tolist(), start.tolist(), end.tolist()
        induce = lambda seeds: _induce_singly(lists[0], lists[1], seeds.tolist(), lists[2], lists[3])
    else:
        induce = lambda seeds: _induce(s, larger, seeds, start, end)
    sa = induce(lms[np.argsort(s[lms], kind="stable")])
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    # the end letter is an S suffix without an S successor: place() never yields it
    sa[0] = n - 1
    ordered = sa[is_lms[sa]]
    names = np.zeros(len(lms), np.int64)
    if len(lms) > 1:
        where = np.searchsorted(lms, ordered)
        stop = np.append(lms[1:], n - 1)[where]
        same = _equal(s, ordered[:-1], stop[:-1], ordered[1:], stop[1:])
        name = np.concatenate([[0], np.cumsum(~same)])
        names[where] = name
        if name[-1] + 1 < len(lms):
            ordered = lms[suffix_array(names, int(name[-1]) + 1)]
    sa = induce(ordered)
    sa[0] = n - 1
    return sa


def _equal(s: np.ndarray, a: np.ndarray, a_stop: np.ndarray, b: np.ndarray, b_stop: np.ndarray) -> np.ndarray:
    """Whether s[a:a_stop + 1] and s[b:b_stop + 1] are the same, pair by pair."""
    same = (a_stop - a) == (b_stop - b)
    live, k = np.flatnonzero(same), 0
    while len(live):
        ok = s[a[live] + k] == s[b[live] + k]
        same[live[~ok]] = False
        live = live[ok]
        k += 1
        live = live[a[live] + k <= a_stop[live]]
    return same


def permuted_lcp(data: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each position, the common prefix of its suffix with the one before it
    in ``sa``, counted up to ``most`` at least (longer ones may be cut there).

    Where the letters to the left agree, a value is its left neighbour's less one;
    only the others are compared, eight letters at a time."""
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    left = np.zeros(n, bool)
    both = np.flatnonzero(before[1:] > 0) + 1
    left[both] = data[both - 1] == data[before[both] - 1]
    left[1:] &= before[:-1] == before[1:] - 1
    head = np.flatnonzero(~left)
    padded = np.concatenate([data.astype(np.uint8), np.zeros(most + 16, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", buffer=padded.data, strides=(1,))
    far = most + len_of_longest_drop(left)
    value = np.zeros(n, np.int64)
    live = head[before[head] >= 0]
    at = np.zeros(len(live), np.int64)
    while len(live):
        a, b = live + at, before[live] + at
        room = np.minimum(n - a, n - b)
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.floor(np.log2(np.maximum(low, 1).astype(np.float64))).astype(np.int64) >> 3)
        at = at + np.minimum(equal, room)
        value[live] = at
        more = (equal == 8) & (room > 8) & (at < far)
        live, at = live[more], at[more]
    source = np.maximum.accumulate(np.where(left, 0, np.arange(n)))
    return np.maximum(value[source] - (np.arange(n) - source), 0)


def len_of_longest_drop(left: np.ndarray) -> int:
    """How far values are carried on from the position they were counted at."""
    heads = np.flatnonzero(~left)
    return int(np.diff(np.append(heads, len(left))).max()) if len(heads) else len(left)
