"""Public tokenizer files and the per-process codecs built from them.

Files are read on the driver and shipped as broadcast bytes: a vocabulary file
is a few megabytes, refused above ``MAX_VOCABULARY_BYTES``.  With them goes a
megabyte of character classes, as the tokenizer library itself tells them apart.
"""

from __future__ import annotations

import base64
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from .pretokens import Splitter, classes_of_tiktoken

MAX_VOCABULARY_BYTES = 64 << 20
#: Distinct words a worker remembers at most.
CACHE_WORDS = 600_000


def vocabulary(spark: SparkSession, path: str, classes=None):
    """Broadcast of a vocabulary file's bytes (checked size), or of the pair of them
    and the character classes that the function ``classes`` gives."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path}: vocabulary files are limited to {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast((data, classes()) if classes else data)


class WordIds(dict):
    """Maps the bytes of a word to its ids as bytes (little-endian unsigned 32-bit);
    subclasses say how in ``word_ids``.  Bounded: it starts over when full."""

    def word_ids(self, word: bytes) -> list[int]:
        raise NotImplementedError

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = ids = np.array(self.word_ids(word), "<u4").tobytes()
        return ids

    def of(self, words: pa.Array) -> pa.Array:
        """The ids of each word as large_binary."""
        return pa.array([self[w] for w in words.to_pylist()], pa.large_binary())


class RankCodec(WordIds):
    """Byte-pair ranks and the pattern that splits text before the merges."""

    def __init__(self, data: bytes, classes: bytes, pattern: str):
        import tiktoken

        super().__init__()
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        encoding = tiktoken.Encoding("ranks-" + hashlib.sha1(data).hexdigest(), pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.word_ids = encoding._core_bpe.encode_single_piece
        self.splitter = Splitter(pattern, classes)
        table = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            table[i] = token
        self.table = pa.array(table, pa.large_binary())


@lru_cache(maxsize=4)
def _rank_codec(data: bytes, classes: bytes, pattern: str) -> RankCodec:
    return RankCodec(data, classes, pattern)


def ranks(spark: SparkSession, path: str):
    """A ranks file and its library's character classes, broadcast."""
    return vocabulary(spark, path, classes_of_tiktoken)


def rank_codec(shipped, pattern: str) -> RankCodec:
    return _rank_codec(*shipped.value, pattern)
