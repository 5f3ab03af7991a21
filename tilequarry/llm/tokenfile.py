"""Token-id files: Simple-8b blocks of whole documents, written and read back.

Documents are dealt by ranges of their ids, so shards follow one another in id
order.  A shard's task encodes each text with the tokenizers library, ends each
document with one id and cuts the ids into blocks of whole documents.  A block
carries its documents' ids and counts, its Simple-8b words, and the number of
ids before it in its shard, so that any block is decoded alone and whole arrays at
a time.  The only thing the driver sees is one total a shard.

Blocks lie in the binary column of a Parquet table: Spark's committed writer
reaches every store, and a repeated task attempt leaves nothing behind.

Defined cases: null and empty texts hold the end id only; rows that share an id
are ordered by text; rows with null ids come first; an empty table gives empty
files and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from .common import as_documents, by_bytes, shared_path, shuffle_width
from .pretokens import BYTE_LEVEL, Splitter, classes_of_tokenizers, parts
from .tokens import WordIds, vocabulary

BLOCK_IDS = 1 << 18
#: Text bytes split at once.
BATCH_BYTES = 4 << 20
_HEAD = np.dtype([("magic", "S4"), ("docs", "<u4"), ("ids", "<u8"), ("words", "<u8"), ("start", "<u8")])


class LibraryIds(WordIds):
    """Ids of whole texts as the library gives them.  For byte-level models that split
    by ``pattern``, the library's model is run once for each distinct pre-token of a
    batch that is not remembered; texts that hold a control string, and other models,
    go to the library whole."""

    def __init__(self, data: bytes, classes: bytes, pattern: str | None):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(data.decode())
        self.model = self.tokenizer.model
        spec = json.loads(data)
        pre = spec.get("pre_tokenizer") or {}
        plain = pattern == BYTE_LEVEL and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.splitter = Splitter(pattern, classes) if plain else None
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        # the letters of a byte-level alphabet: printable bytes stand for themselves
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in shown]
        self.letters = {b: b for b in shown} | {b: 256 + k for k, b in enumerate(rest)}

    def word_ids(self, word: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(word.decode("latin-1").translate(self.letters))]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, texts: pa.Array) -> list:
        """A bytes-like value of little-endian unsigned 32-bit ids for each text."""
        if self.splitter is None:
            return [self.whole(t) for t in texts.to_pylist()]
        tokens, first = self.splitter.tokens(texts)
        told = tokens.dictionary_encode()
        out = [x.as_buffer() for x in parts(self.of(told.dictionary).take(told.indices), first)]
        for added in self.added:
            for k in np.flatnonzero(pc.match_substring(texts, added).to_numpy(zero_copy_only=False)).tolist():
                out[k] = self.whole(texts[k].as_py())
        return out


@lru_cache(maxsize=2)
def _library(data: bytes, classes: bytes, pattern: str | None) -> LibraryIds:
    return LibraryIds(data, classes, pattern)


def pack_block(doc_ids: list[int | None], ids: list[np.ndarray], start: int) -> bytes:
    """One block: head, then ids of documents, their presence, counts, and words."""
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    words = simple8b.encode(flat)
    head = np.array([(b"S8B1", len(ids), len(flat), len(words), start)], _HEAD)
    return b"".join([head.tobytes(), np.array([0 if i is None else i for i in doc_ids], "<i8").tobytes(), np.array([i is not None for i in doc_ids], np.uint8).tobytes(), np.array([len(x) for x in ids], "<u8").tobytes(), words.astype("<u8").tobytes()])


def unpack_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """Document ids, counts, all ids in a row, and the ids before the block in its shard."""
    head = np.frombuffer(data, _HEAD, 1)[0]
    if head["magic"] != b"S8B1":
        raise ValueError("not a block of token ids")
    n, at = int(head["docs"]), _HEAD.itemsize
    doc_ids = np.frombuffer(data, "<i8", n, at)
    there = np.frombuffer(data, np.uint8, n, at + 8 * n)
    counts = np.frombuffer(data, "<u8", n, at + 9 * n).astype(np.int64)
    words = np.frombuffer(data, "<u8", int(head["words"]), at + 17 * n)
    return [i if t else None for i, t in zip(doc_ids.tolist(), there.tolist())], counts, simple8b.decode(words, int(head["ids"])), int(head["start"])


def write(docs: DataFrame, path: str, tokenizer_path: str, pattern: str | None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all texts under ``path`` in ascending order of document id."""
    shipped = vocabulary(docs.sparkSession, tokenizer_path, classes_of_tokenizers)
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library, shard = _library(*shipped.value, pattern), TaskContext.get().partitionId()
        keys, held, total, start, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal keys, held, total, start, block
            row = pa.record_batch({"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([total], pa.int64()), "payload": pa.array([pack_block(keys, held, start)], pa.binary())})
            keys, held, start, total, block = [], [], start + total, 0, block + 1
            return row

        for batch in by_bytes(batches, text_col, BATCH_BYTES):
            for key, found in zip(batch.column(id_col).to_pylist(), library.ids(batch.column(text_col))):
                ids = np.concatenate([np.frombuffer(found, "<u4"), end])
                keys.append(key)
                held.append(ids)
                total += len(ids)
                if total >= block_ids:
                    yield flush()
        if held:
            yield flush()

    rows = as_documents(docs, id_col, text_col).repartitionByRange(shuffle_width(docs.sparkSession), F.col(id_col).asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col(id_col).asc_nulls_first(), text_col)
    rows.mapInArrow(run, "shard int, block int, n_ids long, payload binary").write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids binary) of each document in the files under ``path``."""
    blocks = spark.read.schema("shard int, block int, n_ids long, payload binary").parquet(path)
    totals = sorted(blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())  # one row a shard
    base, before = {}, 0
    for shard, n in totals:
        base[shard], before = before, before + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload")):
                keys, counts, ids, start = unpack_block(payload.as_buffer())
                stop = np.cumsum(counts)
                first = stop - counts
                raw = ids.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(first + start + base[shard]), pa.array(counts), pa.array([raw[4 * a : 4 * b] for a, b in zip(first.tolist(), stop.tolist())], pa.binary())], ["id", "start", "n_tokens", "ids"])

    return blocks.select("shard", "payload").mapInArrow(run, "id long, start long, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def roundtrip(docs: DataFrame, tokenizer_path: str, pattern: str | None, end_id: int = 0) -> DataFrame:
    """Write ``docs`` into a new folder of the shared one and read them back."""
    path = shared_path(docs.sparkSession, "token-ids")
    write(docs, path, tokenizer_path, pattern, end_id)
    return read(docs.sparkSession, path)
