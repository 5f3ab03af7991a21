"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of distinct word shingles; texts with equal sets
   are one class, represented by the smallest id (copies are never expanded).
2. Representatives that share a signature band are candidates.  Bands only join
   each representative to the smallest of its bucket, so that a bucket of any
   size costs one row a member; the connected groups of these rows are families,
   and every candidate pair lies inside one family.
3. Within a family, signatures are compared a batch of hashes at a time.  A pair
   leaves when the posterior probability (uniform prior) that its similarity
   reaches the threshold falls under ``miss``.  Survivors are confirmed on their
   full sets, unless earlier links already connect them.  Families beyond
   ``block`` members are cut into blocks, and each pair of blocks is a group of
   its own, so no task holds more than two blocks.
4. Links give components; the smallest id of a component is kept.

Defined cases: null and wordless texts have an empty set, link with nothing and
are kept; rows that share an id are one node; a row with a null id gets the
component of its class and is never the kept one; empty tables give no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_documents, by_bytes, components, mix64, runs_of, shuffle_width, text_buffer, written
from .shingles import minhash, shingle_sets

ROWS, BANDS = 5, 30  # a pair at 0.8 shares no band with probability 7e-6, at 0.85 2e-8
STEP = 30  # hashes a batch in verification


@lru_cache(maxsize=None)
def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of ``n`` hashes with P(similarity >= threshold) >= miss."""
    grid = (np.arange(20000) + 0.5) / 20000
    for m in range(n + 1):
        log = m * np.log(grid) + (n - m) * np.log1p(-grid)
        p = np.exp(log - log.max())
        if p[grid >= threshold].sum() / p.sum() >= miss:
            return m
    return n + 1


def profiles(docs: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, s1, s2, bands): set size, a 128-bit order-free digest of
    the set, and the band keys (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, text_col):
            sets, offsets = shingle_sets(*text_buffer(batch.column(text_col)), k)
            size = np.diff(offsets)
            full = size > 0
            digest = np.zeros((2, len(size)), np.uint64)
            keys = np.zeros((int(full.sum()), BANDS), np.uint64)
            if full.any():
                sig = minhash(sets, offsets, ROWS * BANDS)[full].astype(np.uint64)
                with np.errstate(over="ignore"):
                    for d, salt in enumerate((0x51ED270B, 0x2545F491)):
                        digest[d, full] = np.add.reduceat(mix64(sets ^ np.uint64(salt)), offsets[:-1][full])
                    for b in range(BANDS):
                        key = np.full(len(keys), b + 1, np.uint64)
                        for r in range(ROWS):
                            key = mix64(key * np.uint64(0x100000001B3) + sig[:, b * ROWS + r])
                        keys[:, b] = key
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(size, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], ["id", "n_shingles", "s1", "s2", "bands"])

    return as_documents(docs, id_col, text_col).mapInArrow(run, "id long, n_shingles long, s1 long, s2 long, bands array<long>")


class _Verifier:
    """Links within one group of texts."""

    def __init__(self, sets, offsets, sig, percent: int, miss: float):
        self.sets, self.offsets, self.sig, self.percent = sets, offsets, sig, percent
        self.size = np.diff(offsets)
        self.least = [least_matches(n, percent / 100, miss) for n in range(STEP, ROWS * BANDS + 1, STEP)]

    def survivors(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs no batch of hashes rules out, and their matches."""
        small, large = np.minimum(self.size[a], self.size[b]), np.maximum(self.size[a], self.size[b])
        ok = (small > 0) & (100 * small >= self.percent * large)
        a, b = a[ok], b[ok]
        seen = np.zeros(len(a), np.int64)
        for k, least in enumerate(self.least):
            cut = slice(k * STEP, (k + 1) * STEP)
            seen = seen + (self.sig[a, cut] == self.sig[b, cut]).sum(1)
            ok = seen >= least
            a, b, seen = a[ok], b[ok], seen[ok]
            if not len(a):
                break
        return a, b, seen

    def linked(self, i: int, j: int) -> bool:
        x, y = self.sets[self.offsets[i] : self.offsets[i + 1]], self.sets[self.offsets[j] : self.offsets[j + 1]]
        if len(x) > len(y):
            x, y = y, x
        at = np.searchsorted(y, x)
        both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)

    def links(self, rows: np.ndarray, cross: np.ndarray | None) -> Iterator[tuple[int, int]]:
        """A spanning set of the links among ``rows``; with ``cross``, only pairs on
        different sides are looked at."""
        group = np.arange(len(rows))
        for i in range(len(rows) - 1):
            later = np.arange(i + 1, len(rows))
            if cross is not None:
                later = later[cross[later] != cross[i]]
            later = later[group[later] != group[i]]
            _, b, seen = self.survivors(np.full(len(later), rows[i]), rows[later])
            if not len(b):
                continue
            place = later[np.searchsorted(rows[later], b)]
            for j in place[np.argsort(-seen, kind="stable")]:
                if group[j] != group[i] and self.linked(rows[i], rows[j]):
                    group[group == group[j]] = group[i]
                    yield rows[i], rows[j]


def verified_links(members: DataFrame, k: int, percent: int, miss: float) -> DataFrame:
    """(a, b) confirmed links.  members: (g, side, cross, id, text), dealt by g."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, "g"):
            sets, offsets = shingle_sets(*text_buffer(table.column("text")), k)
            check = _Verifier(sets, offsets, minhash(sets, offsets, ROWS * BANDS), percent, miss)
            g, ids = table.column("g").to_numpy(), table.column("id").to_numpy()
            side, cross = table.column("side").to_numpy(), table.column("cross").to_numpy()
            begin = np.concatenate([[0], np.flatnonzero(np.diff(g)) + 1, [len(g)]])
            size = np.diff(begin)
            found = []
            twos = begin[:-1][(size == 2) & ~cross[begin[:-1]]]  # most groups: all at once
            a, b, _ = check.survivors(twos, twos + 1)
            found += [(i, j) for i, j in zip(a.tolist(), b.tolist()) if check.linked(i, j)]
            for at, n in zip(begin[:-1], size):
                if n > 2 or n == 2 and cross[at]:
                    found += check.links(np.arange(at, at + n), side[at : at + n] if cross[at] else None)
            pairs = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(ids[pairs[:, 1]])], ["a", "b"])

    return members.sortWithinPartitions("g").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = 1e-6, block: int = 2000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row, where texts are linked if
    100 * |intersection| >= percent * |union| of their sets of k-word shingles."""
    known = written(profiles(docs, k, id_col, text_col), "profiles")
    classes = written(known.where("n_shingles > 0 AND id IS NOT NULL").groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.min_by("bands", "id").alias("bands")), "classes")
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("rep").alias("b"), F.max("rep").alias("last")).where("b <> last").select("key", "b")
    star = keys.join(buckets, "key").where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    families = components(star, "families")
    sizes = families.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    member = families.join(sizes, "component").select(F.col("node").alias("id"), "component", "blocks", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    routed = as_documents(docs, id_col, text_col).withColumnRenamed(id_col, "id").withColumnRenamed(text_col, "text").join(member.hint("merge"), "id").withColumn("other", other)
    low, high = F.least("own", "other"), F.greatest("own", "other")
    routed = routed.select(F.xxhash64("component", low, high).alias("g"), F.col("own").alias("side"), (F.col("own") != F.col("other")).alias("cross"), low.alias("low"), high.alias("high"), "id", "text")
    # both blocks of a pair meet under one key; "cross" must hold for the whole group
    routed = routed.withColumn("cross", F.col("low") != F.col("high")).drop("low", "high")
    links = written(verified_links(routed.repartition(shuffle_width(docs.sparkSession), "g"), k, percent, miss), "links")
    joined = components(links, "linked")
    top = classes.select("s1", "s2", "rep").join(joined.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = known.select("id", "n_shingles", "s1", "s2").join(top, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
