"""Word shingles as 64-bit hashes, straight from the bytes of an Arrow column."""

from __future__ import annotations

import numpy as np

from .common import MULT, mix64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, base in enumerate((_BASE, _BACK)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                _powers[k] = np.cumprod(x)
    return _powers[0][:n], _powers[1][:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased; split at space and \\t-\\r) in order,
    and the number of words before each text (len(offsets) entries)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    begin, stop = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTE[_LOWER[data]] * up, out=total[1:])
        hashes = mix64((total[stop] - total[begin]) * down[begin])
    return hashes, np.searchsorted(begin, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles of ``k`` words, sorted; with fewer words the
    whole sequence is one shingle; without words the set is empty.  Returns the
    concatenated sets and their offsets."""
    sets, counts, at, rows = [], [], 0, len(offsets) - 1
    while at < rows:  # whole texts, about ``block`` bytes at a time
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, "right")) - 1)
        part = offsets[at : to + 1]
        hashes, before = words(data[part[0] : part[-1]], part - part[0])
        n_words = np.diff(before)
        size = np.where(n_words >= k, n_words - k + 1, (n_words > 0).astype(np.int64))
        text = np.repeat(np.arange(to - at), size)
        first = before[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size))
        used = np.minimum(n_words, k)[text]
        with np.errstate(over="ignore"):
            mixed = used.astype(np.uint64) * MULT
            for j in range(k):
                mixed += np.where(j < used, hashes[np.minimum(first + j, max(len(hashes) - 1, 0))] * _STEP[j], np.uint64(0)) if len(hashes) else np.uint64(0)
        mixed = mix64(mixed)
        order = np.lexsort((mixed, text))
        mixed, text = mixed[order], text[order]
        fresh = np.ones(len(mixed), bool)
        fresh[1:] = (mixed[1:] != mixed[:-1]) | (text[1:] != text[:-1])
        sets.append(mixed[fresh])
        counts.append(np.bincount(text[fresh], minlength=to - at))
        at = to
    count = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(count)]).astype(np.int64)


def minhash(sets: np.ndarray, offsets: np.ndarray, n_hashes: int) -> np.ndarray:
    """Signatures [text, hash] of 32 bits; texts with empty sets get all ones."""
    rows = len(offsets) - 1
    out = np.full((rows, n_hashes), np.uint32(0xFFFFFFFF), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    rng = np.random.default_rng(7)
    a = rng.integers(1, 1 << 63, n_hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, n_hashes, dtype=np.uint64)
    at = 0
    with np.errstate(over="ignore"):
        while at < len(full):  # some 64k shingles at a time stay in cache
            to = max(at + 1, int(np.searchsorted(offsets[full], offsets[full[at]] + 65536)))
            rows_here = full[at:to]
            begin = offsets[rows_here]
            part = sets[begin[0] : offsets[rows_here[-1] + 1]]
            for p in range(n_hashes):
                out[rows_here, p] = np.minimum.reduceat(part * a[p] + b[p], begin - begin[0]) >> np.uint64(32)
            at = to
    return out
