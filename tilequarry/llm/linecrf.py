"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad; its evidence is the binned features of the line and
of its two neighbours.  Trained on whole labelled documents (each line takes its
document's label), the field's forward-backward marginals, weighted by line
length, give a document's share of good text, and a two-parameter logistic fit on
the training documents turns that share into a probability.

The fit takes at most ``train_docs`` labelled documents of at most
``train_bytes`` bytes each (the smallest by a hash of the id), so it costs the
same at every size; scoring reads every document whole.

Defined cases: null and empty texts are one empty line and get a score; null ids
stay null and are never training rows; labels other than 0 and 1 are ignored; a
document with repeated labels takes the larger; without both labels present every
score is the training share of label 1 (0.5 without any); empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, by_bytes, text_buffer
from .shingles import words

BINS, FEATURES = 16, 14
_KIND = np.full(256, 5, np.uint8)  # 0 lower 1 upper 2 digit 3 space 4 sentence mark 5 symbol 6 beyond ASCII
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 0, 1, 2, 6
_KIND[[32, 9, 11, 12, 13, 10]] = 3
_KIND[[ord(c) for c in ".,;:'\"-"]] = 4


def _bins(x: np.ndarray) -> np.ndarray:
    """Shares in [0, 1] in 16 bins, finer near 0."""
    return np.minimum(np.sqrt(np.clip(x, 0, 1)) * BINS, BINS - 1).astype(np.uint8)


def _logs(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(x + 1.0) * 1.5, BINS - 1).astype(np.uint8)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins [line, feature], bytes of each line, and lines before each text."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    before = np.searchsorted(breaks, offsets) + np.arange(len(offsets))
    stop = np.empty(int(before[-1]), np.int64)
    stop[before[1:] - 1] = offsets[1:]
    inner = np.ones(len(stop), bool)
    inner[before[1:] - 1] = False
    stop[inner] = breaks
    begin = np.empty(len(stop), np.int64)
    begin[before[:-1]] = offsets[:-1]  # every text opens with a line, empty or not
    opens = np.zeros(len(stop), bool)
    opens[before[:-1]] = True
    begin[~opens] = breaks + 1
    size = stop - begin
    kinds = _KIND[data]

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[stop] - total[begin]

    lower, upper, digit, mark, symbol, far = (count(kinds == k) for k in (0, 1, 2, 4, 5, 6))
    bar, shout = count(data == ord("|")), count((data == ord("!")) | (data == ord("?")))
    bounds = np.concatenate([begin, [n]])
    hashes, first = words(data, bounds)
    many = np.diff(first)
    text = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((hashes, text))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (text[order][1:] != text[order][:-1])
    distinct = np.bincount(text[order][fresh], minlength=len(many))
    with np.errstate(over="ignore"):
        flat = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes)])
        content = flat[first[1:]] - flat[first[:-1]]
    own = np.searchsorted(before, np.arange(len(many)), "right") - 1
    order = np.lexsort((content, own))
    run = np.ones(len(order), bool)
    run[1:] = (content[order][1:] != content[order][:-1]) | (own[order][1:] != own[order][:-1])
    where = np.cumsum(run) - 1
    copies = np.empty(len(order), np.int64)
    copies[order] = np.bincount(where)[where] if len(order) else 0
    copies[many == 0] = 1
    one, w = np.maximum(size, 1), np.maximum(many, 1)
    last = np.where(size > 0, data[np.maximum(stop - 1, 0)] if n else 0, 0)
    lead = np.where(size > 0, kinds[np.minimum(begin, max(n - 1, 0))] if n else 0, 7)
    lines = before[1:] - before[:-1]
    out = np.stack([_logs(size), _logs(many), np.minimum((size - many) / w * 1.5, BINS - 1).clip(0).astype(np.uint8), _bins(upper / one), _bins(digit / one), _bins(symbol / one), _bins(shout / w), _bins(bar / w), _bins(mark / one), _bins((w - distinct) / w), _logs(copies - 1), _bins(far / one), np.where(size == 0, 0, np.where(last == 46, 1, np.where(last == 33, 2, 3 + _KIND[last] % 8))).astype(np.uint8), np.minimum(lead + 8 * (lines[own] == 1), BINS - 1).astype(np.uint8)], axis=1)
    return out, size, before


@dataclass
class Field:
    """Weights of a fitted field; emissions and transitions are log-odds of good."""

    w: np.ndarray  # [3, FEATURES * BINS]: the line, the one before, the one after
    t: np.ndarray  # [2, 2] from, to; 1 is good
    scale: float
    shift: float
    prior: float
    fitted: bool

    def evidence(self, bins: np.ndarray, before: np.ndarray) -> np.ndarray:
        at = bins.astype(np.int64) + np.arange(FEATURES) * BINS
        own, prev, nxt = (self.w[k][at].sum(1) for k in range(3))
        e = own
        inner = np.ones(len(bins), bool)
        inner[before[:-1][np.diff(before) > 0]] = False
        e[inner] += prev[np.flatnonzero(inner) - 1]
        left = np.flatnonzero(inner) - 1
        e[left] += nxt[left + 1]
        return e

    def messages(self, e: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Forward log-odds (with the line's own evidence) and backward ones."""
        size = np.diff(before)
        order = np.argsort(-size, kind="stable")
        live = np.searchsorted(-size[order], -np.arange(1, (size.max() if len(size) else 0) + 1), "right")
        f, b = e.copy(), np.zeros(len(e))
        t = self.t
        for k in range(1, len(live)):
            at = before[order[: live[k]]] + k
            p = f[at - 1]
            f[at] += np.logaddexp(t[1, 1] + p, t[0, 1]) - np.logaddexp(t[1, 0] + p, t[0, 0])
        for k in range(len(live) - 1, 0, -1):
            at = before[order[: live[k]]] + k
            q = e[at] + b[at]
            b[at - 1] = np.logaddexp(t[1, 1] + q, t[1, 0]) - np.logaddexp(t[0, 1] + q, t[0, 0])
        return f, b

    def share(self, bins: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
        f, b = self.messages(self.evidence(bins, before), before)
        good = _sigmoid(f + b)
        weight = size + 1.0
        total = np.concatenate([[0], np.cumsum(weight)])
        part = np.concatenate([[0], np.cumsum(weight * good)])
        return (part[before[1:]] - part[before[:-1]]) / (total[before[1:]] - total[before[:-1]])

    def score(self, share: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(share), self.prior)
        return _sigmoid(self.scale * _logit(share) + self.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p) - np.log1p(-p)


def fit(bins: np.ndarray, size: np.ndarray, before: np.ndarray, label: np.ndarray, rounds: int = 80, rate: float = 0.08, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by Adam; documents weigh the same whatever their length."""
    prior = float(label.mean()) if len(label) else 0.5
    field = Field(np.zeros((3, FEATURES * BINS)), np.zeros((2, 2)), 1.0, 0.0, prior, 0 < prior < 1)
    if not field.fitted:
        return field
    lines = np.diff(before)
    y = np.repeat(label.astype(float), lines)
    weight = np.repeat(1.0 / lines, lines) / len(label)
    at = bins.astype(np.int64) + np.arange(FEATURES) * BINS
    inner = np.ones(len(bins), bool)
    inner[before[:-1]] = False
    mid = np.flatnonzero(inner)
    m, v = np.zeros(3 * FEATURES * BINS + 4), np.zeros(3 * FEATURES * BINS + 4)
    for k in range(1, rounds + 1):
        e = field.evidence(bins, before)
        f, b = field.messages(e, before)
        gap = weight * (y - _sigmoid(f + b))
        grad = np.zeros((3, FEATURES * BINS))
        for x in range(FEATURES):
            grad[0] += np.bincount(at[:, x], gap, FEATURES * BINS)
            grad[1] += np.bincount(at[mid - 1, x], gap[mid], FEATURES * BINS)
            grad[2] += np.bincount(at[mid, x], gap[mid - 1], FEATURES * BINS)
        q = e[mid] + b[mid]
        joint = np.stack([np.full(len(mid), field.t[0, 0]), field.t[0, 1] + q, f[mid - 1] + field.t[1, 0], f[mid - 1] + field.t[1, 1] + q])
        joint = np.exp(joint - joint.max(0))
        joint /= joint.sum(0)
        turn = np.zeros(4)
        for x in range(4):
            seen = (2 * y[mid - 1] + y[mid]) == x
            turn[x] = (weight[mid] * (seen - joint[x])).sum()
        g = np.concatenate([grad.ravel() - ridge * field.w.ravel() / 100, turn - ridge * field.t.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        field.w = field.w + step[:-4].reshape(3, -1)
        field.t = field.t + step[-4:].reshape(2, 2)
    x = _logit(field.share(bins, size, before))
    for _ in range(30):
        p = _sigmoid(field.scale * x + field.shift)
        r, c = label - p, p * (1 - p) + 1e-9
        h = np.array([[(c * x * x).sum() + 1e-3, (c * x).sum()], [(c * x).sum(), c.sum() + 1e-3]])
        d = np.linalg.solve(h, [(r * x).sum(), r.sum()])
        field.scale, field.shift = field.scale + float(np.clip(d[0], -1, 1)), field.shift + float(np.clip(d[1], -1, 1))
    return field


def train(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_bytes: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """Fit on labelled documents with crc32(id as text) % 5 <> 0."""
    learn = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 != 0))
    learn = learn.groupBy(F.col(id_col).cast("long").alias("key")).agg(F.max(label_col).cast("int").alias("label"))
    learn = learn.orderBy(F.xxhash64("key"), "key").limit(train_docs)  # bounded: safe to broadcast
    rows = as_documents(docs, id_col, text_col).toDF("key", "text").where(F.octet_length("text") <= train_bytes).join(F.broadcast(learn), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text"):
            bins, size, before = line_features(*text_buffer(batch.column("text")))
            cut = [(bins[a:b].tobytes(), size[a:b].astype(np.int32).tobytes()) for a, b in zip(before[:-1], before[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array([x for x, _ in cut], pa.binary()), pa.array([x for _, x in cut], pa.binary())], ["key", "label", "bins", "size"])

    got = rows.select("key", "label", "text").mapInArrow(run, "key long, label int, bins binary, size binary").toArrow().sort_by("key")
    bins = np.frombuffer(b"".join(got.column("bins").to_pylist()), np.uint8).reshape(-1, FEATURES)
    sizes = [np.frombuffer(x, np.int32) for x in got.column("size").to_pylist()]
    before = np.concatenate([[0], np.cumsum([len(x) for x in sizes])]).astype(np.int64)
    return fit(bins, np.concatenate(sizes) if sizes else np.zeros(0), before, got.column("label").to_numpy())


def score(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """(id, held_out, score, predicted) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            value = field.score(field.share(*line_features(*text_buffer(batch.column(text_col)))))
            held = [None if x is None else zlib.crc32(b"%d" % x) % 5 == 0 for x in batch.column(id_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(held, pa.bool_()), pa.array(value), pa.array((value >= threshold).astype(np.int32))], [id_col, "held_out", "score", "predicted"])

    return as_documents(docs, id_col, text_col).mapInArrow(run, f"{id_col} long, held_out boolean, score double, predicted int")
