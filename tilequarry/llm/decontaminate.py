"""Benchmark decontamination by latent semantic retrieval.

1. Passages are overlapping windows of words, long enough that every benchmark
   item lies inside one.  Document frequencies of the benchmark's terms are
   counted over the passages of all documents.
2. A distributed randomised singular value decomposition of the TF-IDF passages A:
   each task adds up its share of A'(A W) for random probes W, 8 more than ``rank``;
   the orthogonal basis Q of the sum spans the range, and a second pass adds up
   (A Q)'(A Q), whose eigenvectors and values give the right singular vectors V and
   the singular values S.  Only the benchmark's terms count (others have no part in a
   product with an item), so sums are bounded by the benchmark; they are reduced on
   the cluster, and one array reaches the driver.  Texts are split into terms once, in
   a table of its own.
3. Passages and items are compared by their left singular coordinates x V / S.
   Candidates are the passages whose cosine with an item reaches ``cosine``.
   As the text around an item can turn a passage away from it, passages that hold
   enough of an item's answer terms are candidates as well: with them no leak is lost
   to the cosine, whatever the rank.
4. Each candidate is aligned with its item by their longest common subsequence of
   words; it is a leak if that covers ``share`` of the item and the aligned stretch
   holds ``answers`` of the item's answer terms: its rarest quarter in the corpus (two
   at least).

Words are ``\\w+`` in lower case.  Defined cases: null and empty texts hold no
passage and are clean; items that are null or have no words match nothing;
repeated items or rows count as often as they stand; of equal shares the
smallest item id is reported; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, by_bytes, text_buffer, written
from .pretokens import lower_words

#: Benchmarks are held by every worker; larger ones are to be given in parts.
MAX_BENCHMARK_BYTES = 32 << 20
#: Text bytes taken up at once.
BATCH_BYTES = 2 << 20


class Items:
    """The benchmark: words by item, and the passage geometry they ask for."""

    def __init__(self, ids: list[int], texts: list[str]):
        words, place, before = lower_words(pa.array(texts, pa.string()))
        full = [i for i in range(len(ids)) if before[i] < before[i + 1] and ids[i] is not None]
        self.ids = [ids[i] for i in full]
        names = words.take(pa.array(np.unique(np.concatenate([np.zeros(0, np.int32), *(place[before[i] : before[i + 1]] for i in full)])))).sort()
        self.vocabulary = names
        number = pc.index_in(words, names).to_numpy(zero_copy_only=False)
        self.words = [number[place[before[i] : before[i + 1]]].astype(np.int64) for i in full]
        longest = max(map(len, self.words), default=1)
        self.stride = max(32, longest // 2)
        self.window = longest + self.stride
        self.masks = []
        for w in self.words:
            mask: dict[int, int] = defaultdict(int)
            for k, t in enumerate(w.tolist()):
                mask[t] |= 1 << k
            self.masks.append(dict(mask))
        self.counts = [{t: b.bit_count() for t, b in m.items()} for m in self.masks]

    @property
    def kind(self) -> str:
        """The integers that hold a term."""
        return "<i2" if len(self.vocabulary) < 1 << 15 else "<i4"

    def terms(self, texts: pa.Array) -> pa.Array:
        """Each text's words as terms (-1: not in the benchmark), as bytes."""
        words, place, before = lower_words(texts)
        number = pc.fill_null(pc.index_in(words, self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(self.kind)
        bounds = before.astype(np.int64) * number.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(bounds), pa.py_buffer(number[place])]).cast(pa.binary())

    def passages(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms of all texts in a row, each passage's first and last + 1, and the number
        of passages before each text."""
        data, offsets = text_buffer(column)
        terms = np.ascontiguousarray(data).view(self.kind)
        before = offsets // terms.itemsize
        size = np.diff(before)
        many = np.where(size > 0, np.maximum(1, -(-(size - self.window + self.stride) // self.stride)), 0)
        ahead = np.concatenate([[0], np.cumsum(many)])
        text = np.repeat(np.arange(len(many)), many)
        begin = before[text] + self.stride * (np.arange(len(text)) - ahead[text])
        return terms, begin, np.minimum(begin + self.window, before[text + 1]), ahead


class _Live:
    """The benchmark terms among a batch's words, and each passage's share of them."""

    def __init__(self, terms: np.ndarray, begin: np.ndarray, stop: np.ndarray):
        at = np.flatnonzero(terms >= 0)
        self.term = terms[at].astype(np.int64)
        self.a, self.b = np.searchsorted(at, begin), np.searchsorted(at, stop)

    def sums(self, rows: np.ndarray) -> np.ndarray:
        """For each passage the sum of its terms' rows."""
        out = np.empty((len(self.a), rows.shape[1]))
        for c in range(0, rows.shape[1], 8):  # eight columns at a time stay in cache
            part = rows[:, c : c + 8]
            run = np.zeros((len(self.term) + 1, part.shape[1]))
            np.cumsum(part[self.term], axis=0, out=run[1:])
            out[:, c : c + 8] = run[self.b] - run[self.a]
        return out

    def spread(self, values: np.ndarray, n_terms: int) -> np.ndarray:
        """The transpose: for each term the sum of its passages' rows."""
        total = np.zeros((n_terms, values.shape[1]))
        if not len(self.term):
            return total
        order = np.argsort(self.term, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], np.diff(self.term[order]) > 0]))
        for c in range(values.shape[1]):
            step = np.bincount(self.a, values[:, c], len(self.term) + 1) - np.bincount(self.b, values[:, c], len(self.term) + 1)
            total[self.term[order[heads]], c] = np.add.reduceat(np.cumsum(step)[:-1][order], heads)
        return total


def lcs_span(mask: dict[int, int], m: int, terms: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence of an item (its letters' bit
    masks, ``m`` of them) and ``terms``, and the position after which it is complete."""
    row, best, at = (1 << m) - 1, 0, 0
    full = row
    for k, t in enumerate(terms):
        u = row & mask.get(t, 0)
        if u:
            row = ((row + u) | (row - u)) & full
            n = m - row.bit_count()
            if n > best:
                best, at = n, k + 1
    return best, at


def _summed(parts: DataFrame, fan: int = 32) -> np.ndarray | None:
    """The sum of float64 arrays in column ``part``, by levels of ``fan`` partitions a
    task, so that one array reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column("part"):
                x = np.frombuffer(x.as_buffer(), np.float64)
                total = x.copy() if total is None else total + x
        if total is not None:
            yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

    width = parts.rdd.getNumPartitions()
    while width > 1:
        width = -(-width // fan)
        parts = parts.repartition(width).mapInArrow(add, "part binary")
    row = parts.first()
    return None if row is None else np.frombuffer(row["part"], np.float64)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = 0.6, answers: float = 0.5, rank: int = 32, cosine: float = 0.6, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, contaminated, item_id, lcs_share, latent_cosine, n_items, n_retrieved) for
    every row: the best item, its share and its passage's cosine (null if clean), the
    items leaked, and those of them that the cosine alone retrieves."""
    spark = docs.sparkSession
    known = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col("text").alias("t"))
    if (known.select(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0) > MAX_BENCHMARK_BYTES:
        raise ValueError(f"a benchmark is limited to {MAX_BENCHMARK_BYTES} bytes a call")
    got = sorted(((r["item"], r["t"]) for r in known.collect()), key=lambda r: (r[0] is None, r[0] or 0))
    items = Items([i for i, _ in got], [t for _, t in got])
    n_terms = max(1, len(items.vocabulary))
    shipped = spark.sparkContext.broadcast(items)
    source = as_documents(docs, id_col, text_col).toDF("id", "text")

    def termed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("id"), shipped.value.terms(batch.column("text"))], ["id", "terms"])

    source = written(source.mapInArrow(termed, "id long, terms binary"), "terms")  # texts are split once for all passes

    def pass_over(task) -> np.ndarray | None:
        """The sum over all tasks of the arrays that ``task`` adds a batch's part to."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items, total = shipped.value, None
            for batch in by_bytes(batches, "terms", BATCH_BYTES):
                terms, begin, stop, _ = items.passages(batch.column("terms"))
                part = task(_Live(terms, begin, stop))
                total = part if total is None else total + part
            if total is not None:
                yield pa.record_batch({"part": pa.array([total.tobytes()], pa.binary())})

        return _summed(source.select("terms").mapInArrow(run, "part binary"))

    def frequencies(live: _Live) -> np.ndarray:
        """The passages that hold each term, and their number: those round a use that
        don't reach back to the use before it."""
        order = np.argsort(live.term, kind="stable")
        before = np.full(len(order), -1)
        again = live.term[order[1:]] == live.term[order[:-1]]
        before[order[1:][again]] = order[:-1][again]
        at = np.arange(len(order))
        begun = np.searchsorted(live.a, at, "right")
        count = begun - np.maximum(np.searchsorted(live.b, at, "right"), np.searchsorted(live.a, before, "right"))
        return np.append(np.bincount(live.term, np.maximum(count, 0), n_terms), len(live.a)).astype(np.float64)

    df = pass_over(frequencies)
    df = np.zeros(n_terms + 1) if df is None else df
    idf = np.log1p(df[-1]) - np.log1p(df[:-1]) + 1e-3
    probes = spark.sparkContext.broadcast(np.random.default_rng(11).standard_normal((n_terms, min(n_terms, rank + 8))) * idf[:, None])
    gram = pass_over(lambda live: live.spread(live.sums(probes.value), n_terms))
    gram = np.zeros(probes.value.shape) if gram is None else gram.reshape(probes.value.shape) * idf[:, None]
    wide = np.linalg.qr(gram)[0]
    basis = spark.sparkContext.broadcast(wide * idf[:, None])

    def coordinates(live: _Live) -> np.ndarray:
        z = live.sums(basis.value)
        return z.T @ z

    inner = pass_over(coordinates)
    if inner is not None:
        square, turn = np.linalg.eigh(inner.reshape(wide.shape[1], -1))
        # coordinates over singular values, so that what all passages share doesn't outweigh the rest
        wide = wide @ turn / np.sqrt(np.maximum(square, square[-1] * 1e-12 + 1e-30))
    singular = wide * idf[:, None]
    latent = np.array([singular[w].sum(0) for w in items.words]).reshape(-1, singular.shape[1])
    latent = latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    rare: list[set[int]] = []
    owners: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(items.words):
        distinct = np.unique(w)
        rare.append(set(distinct[np.lexsort((distinct, -idf[distinct]))][: max(2, -(-len(distinct) // 4))].tolist()))
        for t in rare[-1]:
            owners[t].append(i)
    needed = [max(1, int(np.ceil(answers * len(r)))) for r in rare]
    model = spark.sparkContext.broadcast((singular, latent, rare, dict(owners), needed))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, (singular, latent, rare, owners, needed) = shipped.value, model.value
        is_rare = np.zeros(n_terms + 1, bool)
        is_rare[list(owners)] = True
        least = min(needed, default=1)
        for batch in by_bytes(batches, "terms", BATCH_BYTES):
            terms, begin, stop, ahead = items.passages(batch.column("terms"))
            found: list[dict[int, tuple[float, float]]] = [{} for _ in range(batch.num_rows)]
            near: list[set[int]] = [set() for _ in range(batch.num_rows)]
            z = _Live(terms, begin, stop).sums(singular)
            z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
            asked: dict[int, dict[int, float]] = defaultdict(dict)  # passage: item: cosine
            for at in range(0, len(z), 4096):
                p, i = np.nonzero((likeness := z[at : at + 4096] @ latent.T) >= cosine)
                for k, item, c in zip((p + at).tolist(), i.tolist(), likeness[p, i].tolist()):
                    asked[k][item] = c
            hits = np.flatnonzero(is_rare[terms])
            a, b = np.searchsorted(hits, begin), np.searchsorted(hits, stop)
            for k in np.flatnonzero(b - a >= least).tolist():
                places: dict[int, set[int]] = defaultdict(set)
                for t in terms[hits[a[k] : b[k]]].tolist():
                    for i in owners[t]:
                        places[i].add(t)
                for i, held in places.items():
                    if len(held) >= needed[i] and i not in asked[k]:
                        asked[k][i] = float(z[k] @ latent[i])
            for k, candidates in asked.items():
                word = terms[begin[k] : stop[k]].tolist()
                present = frozenset(word)
                d = int(np.searchsorted(ahead, k, "right")) - 1
                for i, c in candidates.items():
                    m = len(items.words[i])
                    # no common subsequence is longer than the item's words that stand here
                    if len(rare[i] & present) < needed[i] or sum(items.counts[i][t] for t in items.counts[i].keys() & present) < share * m:
                        continue
                    n, end = lcs_span(items.masks[i], m, word)
                    if n < share * m:
                        continue
                    head = lcs_span(_mirrored(items.masks[i], m), m, word[:end][::-1])[1]
                    if len(rare[i].intersection(word[end - head : end])) >= needed[i]:
                        found[d][i] = max(found[d].get(i, (0.0, -1.0)), (n / m, c))
                        if c >= cosine:
                            near[d].add(i)
            best = [min(f.items(), key=lambda kv: (-kv[1][0], items.ids[kv[0]]), default=None) for f in found]
            columns = {"id": batch.column("id"), "contaminated": pa.array([x is not None for x in best], pa.bool_()), "item_id": pa.array([None if x is None else items.ids[x[0]] for x in best], pa.int64()), "lcs_share": pa.array([None if x is None else x[1][0] for x in best], pa.float64()), "latent_cosine": pa.array([None if x is None else x[1][1] for x in best], pa.float64())}
            yield pa.record_batch(columns | {"n_items": pa.array(map(len, found), pa.int64()), "n_retrieved": pa.array(map(len, near), pa.int64())})

    return source.mapInArrow(search, "id long, contaminated boolean, item_id long, lcs_share double, latent_cosine double, n_items long, n_retrieved long").withColumnRenamed("id", id_col)


def _mirrored(mask: dict[int, int], m: int) -> dict[int, int]:
    return {t: int(format(b, f"0{m}b")[::-1], 2) for t, b in mask.items()}
