"""Simple-8b: varying counts of integers in each 64-bit word.

The four highest bits of a word select how many integers of how many bits fill
the other 60.  Selector 0 is an escape: the next word is one raw 64-bit value.
Selector 1 is 120 zeros.  Both directions work on whole NumPy arrays.
"""

from __future__ import annotations

import numpy as np

COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
_SHIFT = np.uint64(60)


def _reach(x: np.ndarray, n: int) -> np.ndarray:
    """max(x[i:i + n]) for each i; windows over the end count as too wide."""
    span, out = 1, x
    while 2 * span <= n:
        out = np.maximum(out[:-span], out[span:])
        span *= 2
    if span < n:
        out = np.maximum(out[: len(out) - (n - span)], out[n - span :])
    return out


def encode(ids: np.ndarray) -> np.ndarray:
    """uint64 words of unsigned integers."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64)
    bits = np.zeros(n, np.uint8)
    rest = ids.copy()
    for step in (32, 16, 8, 4, 2, 1):
        over = rest >> np.uint64(step) > 0
        bits[over] += step
        rest[over] >>= np.uint64(step)
    bits += rest > 0
    select = np.full(n, 15, np.uint8)
    select[bits > 60] = 0
    for s in range(14, 0, -1):
        size = int(COUNTS[s])
        if size <= n:
            fits = _reach(bits, size) <= WIDTHS[s]
            select[: len(fits)][fits] = s
    jump, at, heads = COUNTS[select].tolist(), 0, []
    while at < n:
        heads.append(at)
        at += jump[at]
    heads = np.array(heads)
    chosen = select[heads]
    slots = np.where(chosen == 0, 2, 1)
    place = np.cumsum(slots) - slots
    out = np.zeros(int(slots.sum()), np.uint64)
    out[place] = chosen.astype(np.uint64) << _SHIFT
    for s in np.unique(chosen).tolist():
        own = heads[chosen == s]
        to = place[chosen == s]
        if s == 0:
            out[to + 1] = ids[own]
        elif s > 1:
            for k in range(int(COUNTS[s])):
                out[to] |= ids[own + k] << np.uint64(k * int(WIDTHS[s]))
    return out


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` integers of ``words``."""
    words = np.ascontiguousarray(words, np.uint64)
    select = (words >> _SHIFT).astype(np.int64)
    if (select == 0).any():  # a raw word after an escape is no selector, whatever its bits
        raw, at = np.zeros(len(words), bool), 0
        for at in np.flatnonzero(select == 0).tolist():
            if not raw[at] and at + 1 < len(words):
                raw[at + 1] = True
        head = np.flatnonzero(~raw)
    else:
        head = np.arange(len(words))
    size = COUNTS[select[head]]
    place = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint64)
    for s in np.unique(select[head]).tolist():
        own = select[head] == s
        if s == 0:
            out[place[own]] = words[head[own] + 1]
        elif s > 1:
            width = int(WIDTHS[s])
            for k in range(int(COUNTS[s])):
                out[place[own] + k] = (words[head[own]] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out[:n]
