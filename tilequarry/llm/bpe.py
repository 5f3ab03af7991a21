"""Byte-level BPE encoding and decoding over a global distinct-word shuffle.

1. Texts in the order of their partition are packed into chunks of a bounded number
   of bytes, and dealt by chunk.
2. Each chunk splits its texts into pre-tokens with their positions and sends every
   distinct word it holds once, in one block of words a bucket.  Words are dealt to
   buckets by their bytes, so all chunks ask one bucket for one word, and a bucket
   encodes each of its distinct words once.  Blocks come back as blocks of ids.
3. The chunk joins the ids to its distinct words, and each text is reassembled by
   the positions of its pre-tokens: a gather over whole Arrow arrays.
4. Decoding joins each id with the token-byte table, which every worker holds
   (bounded by the vocabulary file) and which is indexed by id: again one gather.

A frequent word costs one entry a chunk, never one a use, so no key is hot; equal
rows are dealt like any others.  Blocks number chunks times buckets; buckets are
``BUCKETS`` up to 16 times as many chunks and never beyond ``MAX_BUCKETS``, so blocks
grow with the chunks and hold some tens of words or more.

Texts of every script are split and shuffled alike (``pretokens``).  A chunk is the
same in question and answer as long as the partitions of ``docs`` hold the same rows
when they are computed again, as tables do; otherwise the job fails, never silently.

Defined cases: null text counts as empty (no ids, empty bytes); repeated ids or
rows stay separate rows; null ids stay null; an empty table gives an empty
result; other columns of the input are ignored.  A longer text than ``chunk_bytes``
is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, by_bytes, give_back, mix64, shuffle_width, text_buffer
from .pretokens import parts
from .shingles import powers
from .tokens import rank_codec, ranks

#: Text bytes of a chunk.
CHUNK_BYTES = 6 << 20
BUCKETS, MAX_BUCKETS = 256, 4096
_LETTER = np.random.default_rng(20250511).integers(1, 1 << 63, 256, dtype=np.uint64)
_ZSTD = pa.Codec("zstd")


def _squeezed(*columns: np.ndarray) -> bytes:
    """Arrays of one block: their sizes, then all their bytes, compressed.  Integers
    lie byte plane by byte plane, as their high bytes are mostly equal."""
    raw = [np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.dtype.itemsize).T.tobytes() for c in columns]
    sizes = np.array([len(x) for x in raw], "<u4").tobytes()
    return sizes + _ZSTD.compress(b"".join(raw)).to_pybytes()


def _unsqueezed(data: bytes, *kinds: str) -> list[np.ndarray]:
    sizes = np.frombuffer(data, "<u4", len(kinds))
    raw = _ZSTD.decompress(memoryview(data)[4 * len(kinds) :], decompressed_size=int(sizes.sum())).to_pybytes()
    at, out = 0, []
    for n, kind in zip(sizes.tolist(), kinds):
        planes = np.frombuffer(raw, np.uint8, n, at).reshape(np.dtype(kind).itemsize, -1)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n
    return out


def _joined(sizes: np.ndarray, data: np.ndarray) -> pa.Array:
    """Values of ``sizes`` bytes that lie one after another in ``data``."""
    bounds = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def _bucket_of(words: pa.Array, n_buckets: int) -> np.ndarray:
    data, offsets = text_buffer(words)
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[data] * up[:-1])])
        hashes = mix64((total[offsets[1:]] - total[offsets[:-1]]) * down[offsets[:-1]])
    return (hashes % np.uint64(n_buckets)).astype(np.int64)


class _Chunk:
    """The pre-tokens of a chunk's texts, and its distinct words in the order of bucket
    and word, which is the same whatever order the texts come in."""

    def __init__(self, packs: pa.ChunkedArray, splitter, n_buckets: int):
        self.keys, self.firsts, found = [], [], []
        for data in packs:
            batch = next(iter(pa.ipc.open_stream(data.as_buffer())))
            tokens, first = splitter.tokens(batch.column("text"))
            self.keys.append(batch.column("id"))
            self.firsts.append(first)
            found.append(tokens)
        told = pa.chunked_array(found, pa.large_binary()).dictionary_encode().unify_dictionaries()
        words = told.chunk(0).dictionary if told.num_chunks else pa.array([], pa.large_binary())
        index = np.concatenate([np.zeros(0, np.int32), *(c.indices.to_numpy() for c in told.chunks)])
        bucket = _bucket_of(words, n_buckets)
        order = pc.sort_indices(pa.table({"b": bucket, "w": words}), sort_keys=[("b", "ascending"), ("w", "ascending")])
        self.words, self.bucket = words.take(order), bucket[order.to_numpy()]
        place = np.empty(len(words), np.int32)
        place[order.to_numpy()] = np.arange(len(words), dtype=np.int32)
        self.index = pa.array(place[index])
        self.cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(words)]]) if len(words) else np.zeros(1, np.int64)


def _pack(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, pack): some texts of a partition; chunks follow one another."""
    task, total = TaskContext.get().partitionId() << 32, 0
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in by_bytes(batches, "text", min(1 << 20, chunk_bytes)):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
            out.write_batch(batch)
        yield pa.record_batch({"chunk": pa.array([task + total // chunk_bytes], pa.int64()), "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
        total += batch.column("text").nbytes


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(id, ids binary: little-endian unsigned 32-bit ids of the whole text)."""
    spark = docs.sparkSession
    shipped = ranks(spark, ranks_path)
    total = docs.select(F.sum(F.octet_length(F.col(text_col))).alias("n")).first()["n"] or 0
    n_chunks = max(1, -(-total // chunk_bytes))
    width = max(shuffle_width(spark), n_chunks)
    n_buckets = min(MAX_BUCKETS, max(BUCKETS, n_chunks // 16))
    source = as_documents(docs, id_col, text_col).withColumnsRenamed({id_col: "id", text_col: "text"}).select("id", "text")
    packs = source.mapInArrow(lambda b: _pack(b, chunk_bytes), "chunk long, pack binary").repartition(width, "chunk")

    def ask(group: pa.Table) -> pa.Table:
        own = _Chunk(group.column("pack"), rank_codec(shipped, pattern).splitter, n_buckets)
        data, offsets = text_buffer(own.words)
        size = np.diff(offsets).astype("<u4")
        cuts = list(zip(own.cuts[:-1].tolist(), own.cuts[1:].tolist()))
        blocks = [_squeezed(size[a:b], data[offsets[a] : offsets[b]]) for a, b in cuts]
        give_back()
        return pa.table({"chunk": pa.array([group.column("chunk")[0].as_py()] * len(cuts), pa.int64()), "bucket": pa.array(own.bucket[own.cuts[:-1]].astype(np.int32)), "words": pa.array(blocks, pa.binary())})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = rank_codec(shipped, pattern)
        for batch in by_bytes(batches, "words"):
            replies = []
            for block in batch.column("words"):
                ids = codec.of(_joined(*_unsqueezed(block.as_buffer(), "<u4", "u1")))
                data, offsets = text_buffer(ids)
                replies.append(_squeezed((np.diff(offsets) // 4).astype("<u4"), data.view("<u4")))
            yield pa.record_batch({"chunk": batch.column("chunk"), "bucket": batch.column("bucket"), "reply": pa.array(replies, pa.binary())})
        codec.clear()  # other tasks have other buckets

    def assemble(group: pa.Table, replies: pa.Table) -> pa.Table:
        own = _Chunk(group.column("pack"), rank_codec(shipped, pattern).splitter, n_buckets)
        order = np.argsort(replies.column("bucket").to_numpy())
        blocks = replies.column("reply")
        got = [_unsqueezed(blocks[int(i)].as_buffer(), "<u4", "<u4") for i in order]
        if [len(n) for n, _ in got] != np.diff(own.cuts).tolist():
            raise RuntimeError("a chunk of texts changed between its question and its answer: give a stored table")
        size = np.concatenate([np.zeros(0, "<u4"), *(n for n, _ in got)])
        word_ids = _joined(4 * size.astype(np.int64), np.concatenate([np.zeros(0, "<u4"), *(x for _, x in got)]).view(np.uint8))
        at, out = 0, []
        for first in own.firsts:
            out.append(parts(word_ids.take(own.index.slice(at, int(first[-1]))), first).cast(pa.binary()))
            at += int(first[-1])
        give_back()
        return pa.table({"id": pa.chunked_array(own.keys, pa.int64()), "ids": pa.chunked_array(out, pa.binary())})

    replies = packs.groupBy("chunk").applyInArrow(ask, "chunk long, bucket int, words binary").repartition(max(shuffle_width(spark), min(width, n_buckets)), "bucket").mapInArrow(answer, "chunk long, bucket int, reply binary")
    return packs.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(assemble, "id long, ids binary").select(F.col("id").alias(id_col), "ids")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): each id joined with its bytes in the token table."""
    shipped = ranks(encoded.sparkSession, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank_codec(shipped, pattern).table
        for batch in by_bytes(batches, "ids"):
            data, offsets = text_buffer(batch.column("ids"))
            tokens = table.take(pa.array(np.ascontiguousarray(data).view("<u4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, parts(tokens, offsets // 4).cast(pa.binary())], ["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).cast("long").alias("id"), F.col("ids").cast("binary").alias("ids"))
    return rows.mapInArrow(run, "id long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The query's columns: count and SHA-256 of the ids and of the decoded bytes."""
    return decoded.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
