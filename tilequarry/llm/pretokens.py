"""Splitting whole Arrow columns of text into pre-tokens.

For the byte-level pattern below, the split is computed on arrays of code points:
a class for each (space, letter, number, other, as the tokenizer library itself
tells them apart), a token start wherever the class changes, and the pattern's rules
for spaces and contractions as corrections.  The tokens cover every text without
gaps, so they are an Arrow array over the texts' own bytes.  Any other pattern is
split text by text with the ``regex`` module.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import text_buffer

#: Fixed value: the pattern of byte-level vocabularies.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE, LETTER, NUMBER, OTHER = range(4)
_KINDS = ((SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}"))


def _everything() -> str:
    """All code points that could be letters, numbers or spaces: surrogates, the
    unassigned planes 4 to 13 and the private planes 15 and 16 are others."""
    return "".join(map(chr, (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000))))


def _table(matched) -> bytes:
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in _KINDS:
        out[np.frombuffer(matched(pattern).encode("utf-32-le"), "<u4")] = kind
    return out.tobytes()


@lru_cache(maxsize=None)
def classes_of_tiktoken() -> bytes:
    """The class of each code point in tiktoken's pattern engine."""
    import tiktoken

    single, text = {bytes([b]): b for b in range(256)}, _everything()

    def matched(pattern: str) -> str:
        plain = tiktoken.Encoding(f"class {pattern}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        return bytes(plain.encode_ordinary(text)).decode()

    return _table(matched)


@lru_cache(maxsize=None)
def classes_of_tokenizers() -> bytes:
    """The class of each code point in the pattern engine of tokenizers."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    text = _everything()
    return _table(lambda pattern: "".join(p for p, _ in Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(text)))


def starts_of(points: np.ndarray, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a token starts at each code point; ``first`` marks the starts of texts."""
    n = len(points)
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # the last space of a run goes with what follows, and is cut off from the run before it
    into = 1 + np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~first[1:])
    start[into - 1] = True
    start[into[points[into - 1] == 32]] = False
    # contractions are tokens where a token starts at their apostrophe
    at = np.flatnonzero((points == 39) & start)
    beyond = np.concatenate([first, np.ones(4, bool)])
    later = np.concatenate([points, np.zeros(4, points.dtype)])
    at = at[~beyond[at + 1]]
    one, two = later[at + 1], np.where(beyond[at + 2], 0, later[at + 2])
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    for which, size in ((short, 2), (long, 3)):
        begin = at[which]
        start[begin + 1] = False
        stop = begin + size
        start[stop[stop < n]] = True
    return start


class Splitter:
    """Texts to pre-tokens by ``pattern``; ``classes`` has a byte for each code point."""

    def __init__(self, pattern: str, classes: bytes):
        self.findall = None
        if pattern != BYTE_LEVEL:
            import regex

            self.findall = regex.compile(pattern).findall
        self.classes = np.frombuffer(classes, np.uint8)

    def tokens(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(tokens as large_binary, number of tokens before each text and in all)."""
        if self.findall is not None:
            found = [self.findall(t) if t else [] for t in texts.to_pylist()]
            flat = pa.array([w.encode() for own in found for w in own], pa.large_binary())
            return flat, np.concatenate([[0], np.cumsum([len(own) for own in found])]).astype(np.int64)
        data, offsets = text_buffer(texts)
        if not len(data):
            return pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
        points, lead, first = _points(data, offsets)
        begin = np.flatnonzero(starts_of(points, self.classes[points], first))
        return _cut(data, begin if lead is None else lead[begin], offsets)


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray | None, np.ndarray]:
    """Code points of UTF-8 bytes, the bytes they begin at (None: at their own place),
    and whether a text begins at each."""
    lead = None
    if data.max() < 128:
        points = data
    else:
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
    first = np.zeros(len(points) + 1, bool)
    first[offsets if lead is None else np.searchsorted(lead, offsets)] = True
    return points, lead, first[:-1]


def _cut(data: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    bounds = np.append(begin, len(data)).astype(np.int64)
    tokens = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    return tokens, np.searchsorted(begin, offsets)


@lru_cache(maxsize=None)
def _word_letters() -> np.ndarray:
    """Whether a code point is one of ``\\w``."""
    return np.array([chr(c).isalnum() for c in range(0x40000)] + [False] * (0x110000 - 0x40000)) | (np.arange(0x110000) == ord("_"))


def lower_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The ``\\w+`` words of texts in lower case (code point by code point): distinct
    values as large_binary, each word's place among them, and the number of words before
    each text and in all."""
    data, offsets = text_buffer(pc.utf8_lower(texts))
    if not len(data):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    points, lead, first = _points(data, offsets)
    inside = _word_letters()[points]
    start, last = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | first[1:]
    last[:-1] &= ~inside[1:] | first[1:]
    begin, stop = np.flatnonzero(start), np.flatnonzero(last) + 1
    if lead is not None:
        lead = np.append(lead, len(data))
        inside = np.repeat(inside, np.diff(lead))
        begin, stop = lead[begin], lead[stop]
    bounds = np.concatenate([[0], np.cumsum(stop - begin)])
    words = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(bounds), pa.py_buffer(data[inside])])
    told = words.dictionary_encode()
    return told.dictionary, told.indices.to_numpy(), np.searchsorted(begin, offsets)


def parts(values: pa.Array, bounds: np.ndarray) -> pa.Array:
    """Runs of a large_binary array joined: element i is values[bounds[i]:bounds[i+1]]
    as one value; no bytes are copied."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    joined = np.ascontiguousarray(offsets[bounds])
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(joined), values.buffers()[2] if len(values) else pa.py_buffer(b"")])
