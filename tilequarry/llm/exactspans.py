"""Exact substring deduplication: every byte under a ``length``-byte string that
starts anywhere else in the corpus goes.

Every ``length``-byte string has an anchor: the smallest hash among its K-byte
strings (leftmost of equals).  It depends on the string's content alone, so equal
strings have equal anchors at equal offsets, and consecutive starts share one
anchor: a text is a sequence of runs, one per anchor.

1. Of equal runs in one batch of texts all are covered at once and one goes on for
   them, so a passage costs a row a batch at most, whatever share of the corpus
   holds it.  What goes on is dealt by the anchor's fingerprint and streamed in
   order.  Runs whose whole content occurs again are covered, however many there
   are; only one of them goes on, and only where the anchor has differing
   surroundings.
2. Those surroundings are fetched from their documents and form shards of whole
   anchors.  Each shard gets a suffix array by induced sorting and its permuted
   common prefixes; neighbours that agree on ``length`` bytes are covered.
   Anchors with more than ``hot`` differing surroundings are not gathered: their
   strings are hashed (128 bits), dealt by the hash and streamed as in 1.
3. Covered stretches go back to their documents.

Documents are known by a 64-bit hash of id and text, so rows that share an id
are told apart; repeated rows are further occurrences like any other.  Null text
is empty; texts shorter than ``length`` are never touched; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, as_documents, by_bytes, mix64, runs_of, shuffle_width, text_buffer, written
from .shingles import _BYTE, powers
from .suffix import permuted_lcp, suffix_array

K = 64
SHARD_BYTES = 1 << 20
ROW = "fp long, seg long, uid long, pos long"
FOLDED = ROW + ", state byte"
ALONE, SEVERAL, DONE = 0, 1, 2  # a run alone in its batch, one for several, one of several


def _prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return total, down


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def _runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(fp, seg, uid, pos) of each run; pos = first start << 16 | (starts - 1) << 8 |
    the anchor's offset from the first start."""
    w = length - K + 1
    with np.errstate(over="ignore"):
        for batch in by_bytes(batches, "text"):
            data, offsets = text_buffer(batch.column("text"))
            if len(data) < length:
                continue
            total, down = _prefix_hash(data)
            n = len(data) - K + 1
            gram = mix64((total[K:] - total[:n]) * down[:n])
            key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
            anchor = (_sliding_min(key, w) & np.uint64(0xFFFFFFFF)).astype(np.int64)
            starts = np.maximum(np.diff(offsets) - length + 1, 0)
            text = np.repeat(np.arange(len(starts)), starts)
            p = np.arange(len(text)) + np.repeat(offsets[:-1] - (np.cumsum(starts) - starts), starts)
            if not len(p):
                continue
            a = anchor[p]
            fresh = np.ones(len(p), bool)
            fresh[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
            first = np.flatnonzero(fresh)
            many = np.diff(np.append(first, len(p)))
            begin, a, text = p[first], a[first], text[first]
            stop = begin + many - 1 + length
            seg = mix64((total[stop] - total[begin]) * down[begin] + (many.astype(np.uint64) << np.uint64(8) | (a - begin).astype(np.uint64)) * MULT)
            uid = batch.column("uid").to_numpy()[text]
            pos = (begin - offsets[text]) << 16 | (many - 1) << 8 | (a - begin)
            yield pa.RecordBatch.from_arrays([pa.array(gram[a].view(np.int64)), pa.array(seg.view(np.int64)), pa.array(uid), pa.array(pos)], ["fp", "seg", "uid", "pos"])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The runs with their state among those of their batch."""
    for batch in batches:
        fp, seg, pos = (batch.column(c).to_numpy() for c in ("fp", "seg", "pos"))
        order = np.argsort(seg, kind="stable")
        a, b = order[:-1], order[1:]
        same = (seg[a] == seg[b]) & (fp[a] == fp[b]) & ((pos[a] & 0xFFFF) == (pos[b] & 0xFFFF))
        state = np.full(len(seg), ALONE, np.int8)
        state[a[same]] = SEVERAL
        state[b[same]] = DONE
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(state)], [*batch.schema.names, "state"])


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From runs in state DONE and then the others sorted by (fp, seg): (covered true,
    ...) for each run whose segment occurs again, and (covered false, ...) for the
    first run of each segment of an anchor with several.  Holds one batch and two
    rows, whatever a key's size."""
    held = np.zeros((5, 0), np.int64)  # the row before, not yet decided
    held_same = held_new = False
    head = np.zeros((5, 0), np.int64)  # the first run of the current anchor while it has one segment

    def decide(rows: np.ndarray, same_before: np.ndarray, new: np.ndarray, same_after: np.ndarray, opens: np.ndarray):
        nonlocal head
        twice = same_before | same_after | (rows[4] == SEVERAL)
        out = [_marked(1, rows[:, twice])]
        asked = np.flatnonzero(new & ~opens)
        if len(asked):
            opening = np.flatnonzero(opens)
            own = np.searchsorted(opening, asked, "right") - 1  # the anchor's first row, -1: before this batch
            heads = np.unique(own[own >= 0])
            asked_rows = [rows[:, asked], rows[:, opening[heads]]]
            if (own < 0).any() and head.shape[1]:
                asked_rows.append(head)
                head = head[:, :0]
            out += [_marked(0, x) for x in asked_rows]
            if len(opening) and opening[-1] < asked[-1]:
                head = head[:, :0]
            elif len(opening):
                head = rows[:, opening[-1] : opening[-1] + 1]
        elif opens.any():
            last = int(np.flatnonzero(opens)[-1])
            head = rows[:, last : last + 1]
        return pa.Table.from_batches(out).combine_chunks().to_batches() if any(len(x) for x in out) else ()

    same = lambda x, y: (x[0] == y[0]) & (x[1] == y[1]) & ((x[3] & 0xFFFF) == (y[3] & 0xFFFF))
    opens_held = np.zeros(1, bool)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.vstack([batch.column(c).to_numpy() for c in ("fp", "seg", "uid", "pos", "state")])
        if rows[4, 0] == DONE:
            yield _marked(1, rows[:, rows[4] == DONE])
            rows = rows[:, rows[4] != DONE]
            if not rows.shape[1]:
                continue
        had = held.shape[1]
        rows = np.concatenate([held, rows], axis=1)
        equal = same(rows[:, 1:], rows[:, :-1])
        before = np.concatenate([[held_same if had else False], equal])
        new = np.concatenate([[held_new if had else True], ~equal])
        opens = np.concatenate([opens_held if had else [True], rows[0, 1:] != rows[0, :-1]])
        if rows.shape[1] > 1:
            yield from decide(rows[:, :-1], before[:-1], new[:-1], equal, opens[:-1])
        held, held_same, held_new, opens_held = rows[:, -1:], bool(before[-1]), bool(new[-1]), opens[-1:]
    if held.shape[1]:
        yield from decide(held, np.array([held_same]), np.array([held_new]), np.zeros(1, bool), opens_held)


def _marked(covered: int, rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(rows.shape[1], bool(covered))), *(pa.array(x) for x in rows[:4])], ["covered", "fp", "seg", "uid", "pos"])


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """(fp, uid, at, seg): the bytes of each asked run of a document."""
    for batch in by_bytes(batches, "text"):
        data, offsets = text_buffer(batch.column("text"))
        asks = batch.column("asks")
        fp, pos = asks.flatten().field("fp"), asks.flatten().field("pos").to_numpy()
        count = asks.value_lengths().to_numpy()
        text = np.repeat(np.arange(len(count)), count)
        begin = offsets[text] + (pos >> 16)
        size = ((pos >> 8) & 0xFF) + length
        raw = data.tobytes()
        yield pa.RecordBatch.from_arrays([fp, batch.column("uid").take(pa.array(text)), pa.array(pos >> 16), pa.array([raw[b : b + n] for b, n in zip(begin.tolist(), size.tolist())], pa.binary())], ["fp", "uid", "at", "seg"])


def _shard_covers(table: pa.Table, length: int) -> pa.RecordBatch:
    """(uid, pos): stretches of starts in one shard whose ``length``-byte string is
    found twice in the shard."""
    data, offsets = text_buffer(table.column("seg"))
    size = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(size))  # one separator after each segment
    s = np.ones(len(data) + len(size) + 1, np.int16)
    s[-1] = 0
    text = np.repeat(np.arange(len(size)), size)
    s[np.arange(len(data)) + text] = data.astype(np.int16) + 2
    sa = suffix_array(s, 258)
    # separators sort below every byte; 254 and 255 never occur in UTF-8
    lcp = permuted_lcp(np.minimum(s, 255), sa, length)
    left = np.zeros(len(s), np.int64)
    left[np.arange(len(data)) + text] = np.repeat(offsets[1:], size) - np.arange(len(data))
    found = np.minimum(lcp, left) >= length
    before = np.zeros(len(s), np.int64)
    before[sa[1:]] = sa[:-1]
    hit = np.flatnonzero(found)
    hit = hit[left[before[hit]] >= length]
    mark = np.zeros(len(s), bool)
    mark[hit] = mark[before[hit]] = True
    on = np.flatnonzero(mark)
    if len(on):
        first = on[np.concatenate([[True], np.diff(on) > 1])]
        last = on[np.concatenate([np.diff(on) > 1, [True]])]
        own = np.searchsorted(begin, first, "right") - 1
        uid = table.column("uid").to_numpy()[own]
        at = table.column("at").to_numpy()[own] + first - begin[own]
    else:
        uid = at = first = last = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(uid), pa.array(at << 16 | (last - first) << 8)], ["uid", "pos"])


def _covers(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for table in runs_of(batches, "fp"):
        fp = table.column("fp").to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(fp)) + 1, len(fp))
        ends = np.cumsum(np.diff(text_buffer(table.column("seg"))[1]))
        begin = 0
        for cut in cuts.tolist():
            if total + ends[cut - 1] - (ends[begin - 1] if begin else 0) >= SHARD_BYTES:
                yield _shard_covers(pa.concat_tables([*held, table.slice(begin, cut - begin)]), length)
                held, total, begin = [], 0, cut
        if begin < len(fp):
            held.append(table.slice(begin))
            total += int(ends[-1] - (ends[begin - 1] if begin else 0))
    if held:
        yield _shard_covers(pa.concat_tables(held), length)


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of hot segments as a run of one start, known by 128 bits."""
    with np.errstate(over="ignore"):
        for batch in by_bytes(batches, "seg"):
            data, offsets = text_buffer(batch.column("seg"))
            total, down = _prefix_hash(data)
            other = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(mix64(_BYTE[data]) * down[:-1], out=other[1:])  # another polynomial, in the inverse base
            up = powers(len(data) + 1)[0]
            many = np.diff(offsets) - length + 1
            row = np.repeat(np.arange(len(many)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            p = offsets[row] + at
            fp = mix64((total[p + length] - total[p]) * down[p])
            seg = mix64((other[p + length] - other[p]) * up[p])
            pos = (batch.column("at").to_numpy()[row] + at) << 16
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(seg.view(np.int64)), pa.array(batch.column("uid").to_numpy()[row]), pa.array(pos)], ["fp", "seg", "uid", "pos"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, "text"):
        data, offsets = text_buffer(batch.column("text"))
        raw, out = data.tobytes(), []
        for i, covers in enumerate(batch.column("covers").to_pylist()):
            text = raw[offsets[i] : offsets[i + 1]]
            if covers:
                pos = np.sort(np.array(covers, np.int64))
                begin, stop = pos >> 16, (pos >> 16) + ((pos >> 8) & 0xFF) + length
                reach = np.maximum.accumulate(stop)
                fresh = np.concatenate([[True], begin[1:] > reach[:-1]])
                starts, stops = begin[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(reach) - 1)]
                kept = [text[a:b] for a, b in zip([0, *stops.tolist()], [*starts.tolist(), len(text)])]
                out.append((len(text), int((stops - starts).sum()), len(starts), b"".join(kept)))
            else:
                out.append((len(text), 0, 0, text))
        cols = list(zip(*out)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(cols[k], pa.int64()) for k in range(3)), pa.array([hashlib.sha256(x).hexdigest() for x in cols[3]], pa.string()), pa.array(cols[3] if with_text else [None] * len(out), pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in cols[3]] if with_text else [None] * len(out), pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"])


def remove_repeats(docs: DataFrame, length: int = 200, hot: int = 20000, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept binary, kept_text]) for
    every row.  ``kept`` may cut characters in two where differing characters share
    bytes; ``kept_text`` is ``kept`` without such remains."""
    if not K < length <= 256 + K - 1:
        raise ValueError(f"length must be over {K} and under {256 + K}")
    width = shuffle_width(docs.sparkSession)
    source = as_documents(docs, id_col, text_col).toDF("id", "text").withColumn("uid", F.xxhash64("id", "text"))
    found = "covered boolean, " + ROW

    def dealt(rows: DataFrame, *keys: str) -> DataFrame:
        key = F.when(F.col("state") == DONE, F.xxhash64("uid", "pos")).otherwise(F.xxhash64(*keys))
        return rows.repartition(width, key).sortWithinPartitions(F.col("state") != DONE, "fp", "seg", F.col("pos").bitwiseAND(0xFFFF)).mapInArrow(_repeats, found)

    runs = source.where(F.octet_length("text") >= length).select("uid", "text").mapInArrow(lambda b: _folded(_runs(b, length)), FOLDED)
    first = written(dealt(runs, "fp"), "repeats")
    asked = first.where("NOT covered")
    per_doc = asked.groupBy("uid").agg(F.collect_list(F.struct("fp", "pos")).alias("asks"))
    segments = written(source.join(per_doc, "uid").select("uid", "text", "asks").mapInArrow(lambda b: _segments(b, length), "fp long, uid long, at long, seg binary"), "segments")
    crowded = segments.groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("fp")
    crowded = written(crowded, "crowded")  # at most rows / hot keys
    shards = segments.join(crowded, "fp", "left_anti").repartition(width, "fp").sortWithinPartitions("fp")
    covers = [first.where("covered").select("uid", "pos"), shards.mapInArrow(lambda b: _covers(b, length), "uid long, pos long")]
    if not crowded.isEmpty():
        strings = segments.join(crowded, "fp").mapInArrow(lambda b: _folded(_strings(b, length)), FOLDED)
        covers.append(dealt(strings, "fp", "seg").where("covered").select("uid", "pos"))
    for more in covers[1:]:
        covers[0] = covers[0].unionByName(more)
    per_doc = covers[0].groupBy("uid").agg(F.collect_list("pos").alias("covers"))
    out = source.join(per_doc, "uid", "left").select("id", "text", "covers")
    out = out.mapInArrow(lambda b: _cut(b, length, with_text), "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string").withColumnRenamed("id", id_col)
    return out if with_text else out.drop("kept", "kept_text")
