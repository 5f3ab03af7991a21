"""Helpers the operators of this subpackage share: Arrow text access, grouped streams,
and the library's shared-folder tables and components under one name."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilequarry.tables import components, delete, shared_path, shuffle_width, written

__all__ = ["components", "delete", "shared_path", "shuffle_width", "written"]


def width_for(df: DataFrame, bytes_total: int, per_task: int) -> int:
    """Partitions so that each holds about ``per_task`` bytes, at least the
    session's width."""
    return max(shuffle_width(df.sparkSession), -(-bytes_total // per_task))


def as_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id long, text string), null text as empty; other columns are left out."""
    return df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary array as one byte buffer and int64 offsets; nulls are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar(b"" if kind == pa.large_binary() else "", kind))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return free memory to the system: workers outlive their tasks and stay beside
    the executor's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_bytes(batches: Iterable[pa.RecordBatch], column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose ``column`` holds about ``limit`` bytes (one
    row at least, so a longer text is a batch of its own)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < batch.num_rows:
            yield batch.slice(begin)
    give_back()


def runs_of(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Whole runs of equal ``key`` (never null) from a stream sorted by it.  Many
    runs come in one table; no run is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if (keys != keys[-1]).any() else 0
        if held and (cut or held[-1].column(key)[0].as_py() != keys[-1]):
            head = [*held, batch.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(head)
            held = [batch.slice(cut)]
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
    give_back()


MULT = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64 (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
