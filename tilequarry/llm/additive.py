"""Approximate nearest neighbours by additive quantisation.

A vector (scaled to length 1) is the sum of one full-dimensional codeword from
each of several codebooks, each fitted to what the ones before leave over; a beam
keeps the best partial sums while encoding.  A row of the index holds the codes
and the stored norm of its sum.  A query scores all rows by table lookups (its
products with all codewords), the best ``rerank`` of a block are scored exactly on
the original vectors, and the best of all blocks are the result.

The codebooks are fitted on at most ``sample`` rows (smallest by a hash of the
id); every row is indexed.  Equal vectors are one row of the index with the
smallest ``k + 1`` ids, all that any result can name; where an id has many vectors,
they count once among the ``rerank``.  Queries come in packs and
stream past blocks of the index, so a task holds one block and one pack.

Defined cases: vectors that are null, zero, hold null or non-finite components, or
have another dimension than most take no part, neither as query nor as candidate;
rows that share a query's id count as its own; repeated rows count once, and an id
with several vectors is named once a query, by its largest score; null ids take no part; equal scores
go to the smaller id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_width, written

BEAM = 4


def fit_codebooks(x: np.ndarray, books: int = 8, words: int = 256, rounds: int = 8) -> np.ndarray:
    """Residual codebooks [book, word, dimension] by k-means on unit vectors."""
    rng, rest, out = np.random.default_rng(5), x.astype(np.float32).copy(), []
    words = max(1, min(words, len(x)))
    for _ in range(books):
        centre = rest[rng.choice(len(rest), words, replace=False)].copy()
        for _ in range(rounds):
            near = (rest @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centre)
            np.add.at(total, near, rest)
            centre[count > 0] = total[count > 0] / count[count > 0, None]
        near = (rest @ centre.T - 0.5 * (centre**2).sum(1)).argmax(1)
        rest -= centre[near]
        out.append(centre)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Codes [row, book] and the norms of the coded vectors."""
    n, (m, words, dim) = len(x), books.shape
    rest, codes, rows = x.astype(np.float32)[:, None, :], np.zeros((n, 1, 0), np.uint8), np.arange(n)[:, None]
    for book in books:
        cost = (rest**2).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book**2).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        source, word = best // words, best % words
        rest = rest[rows, source] - book[word]
        codes = np.concatenate([codes[rows, source], word[:, :, None].astype(np.uint8)], axis=2)
    best = (rest**2).sum(2).argmin(1)
    coded = x.astype(np.float32) - rest[np.arange(n), best]
    return codes[np.arange(n), best], np.linalg.norm(coded, axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    top = np.abs(x).max(1, keepdims=True)
    x = x / top
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _near_one(x: np.ndarray) -> np.ndarray:
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def cosines(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine in double precision on the original components.  Each vector is first
    scaled by a power of two, which is exact, so that no square leaves the range."""
    q, x = _near_one(query.astype(np.float64)[None])[0], _near_one(x.astype(np.float64))
    return (x @ q) / (np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum()))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, rerank: int = 128, sample: int = 8192, books: int = 8, words: int = 256, block: int = 32768, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` rows of largest cosine found for each
    row whose id is divisible by ``every``, the nearest first."""
    spark = vectors.sparkSession
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", bad) & F.exists("v", lambda v: v != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    dim = sizes[0]["d"] if sizes else 1
    rows = rows.where(F.size("v") == dim).distinct()
    smallest = Window.partitionBy("v").orderBy("id")
    classes = rows.withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    classes = written(classes, "vectors")
    total = classes.count()
    learn = classes.select("v", F.col("ids")[0].alias("id")).orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow().column("v").combine_chunks()
    learn = learn.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    model = spark.sparkContext.broadcast(fit_codebooks(_unit(learn), books, words) if len(learn) else np.zeros((1, 1, dim), np.float32))
    n_blocks = max(-(-total // block), min(shuffle_width(spark), -(-total // 2048)), 1)
    schema = "block int, query boolean, ids binary, codes binary, norms binary, vectors binary"

    def floats(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = floats(part.column("v"))
                codes, norms = encode(_unit(x), model.value)
                ids = np.full((len(x), k + 1), np.iinfo(np.int64).max)
                for i, own in enumerate(part.column("ids").to_pylist()):
                    ids[i, : len(own)] = own
                own = part.column("block").to_numpy()
                for b in np.unique(own):
                    pick = own == b
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([False]), *(pa.array([a[pick].tobytes()], pa.binary()) for a in (ids, codes, norms, x))], ["block", "query", "ids", "codes", "norms", "vectors"])

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.slice(0, 1).column("id").cast(pa.int64()), pa.array([part.column("id").to_numpy().tobytes()], pa.binary()), pa.array([floats(part.column("v")).tobytes()], pa.binary())], ["pack", "ids", "vectors"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, at, held, ready = model.value, None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    at, held, ready = row["block"], [], None
                if not row["query"]:
                    held.append(row)
                    continue
                if not held:
                    continue
                if ready is None:
                    join = lambda c, t: np.concatenate([np.frombuffer(r[c], t) for r in held])
                    ready = join("ids", np.int64).reshape(-1, k + 1), join("codes", np.uint8).reshape(-1, len(books)), join("norms", np.float32), join("vectors", np.float64).reshape(-1, dim)
                    order = np.lexsort(ready[0].T[::-1])
                    ready = tuple(a[order] for a in ready)
                    same = (ready[0][1:] == ready[0][:-1]).all(1)
                    heads = np.flatnonzero(np.concatenate([[True], ~same]))  # of runs of vectors with the same ids
                    runs = np.diff(heads, append=len(order))
                ids, codes, norms, x = ready
                who, q = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
                table = np.einsum("qd,mwd->mqw", _unit(q), books, optimize=True)
                found = []
                for i in range(len(who)):
                    approx = np.zeros(len(codes), np.float32)
                    for m in range(len(books)):
                        approx += table[m, i][codes[:, m]]
                    approx /= np.maximum(norms, 1e-6)
                    approx = np.maximum.reduceat(approx, heads)
                    best = np.argpartition(-approx, rerank)[:rerank] if rerank < len(approx) else np.arange(len(approx))
                    if len(heads) < len(codes):
                        chosen = np.zeros(len(heads), bool)
                        chosen[best] = True
                        best = np.flatnonzero(np.repeat(chosen, runs))
                    score = np.repeat(cosines(q[i], x[best]), k + 1)
                    near = ids[best].ravel()
                    ok = (near != np.iinfo(np.int64).max) & (near != who[i])
                    score, near = score[ok], near[ok]
                    top = np.lexsort((near, -score))
                    top = top[np.sort(np.unique(near[top], return_index=True)[1])[:k]]
                    found.append((np.full(len(top), who[i]), near[top], score[top]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)], ["query_id", "vec_id", "score"])

    dealt = classes.withColumn("block", F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(n_blocks)).cast("int")).mapInArrow(index, schema)
    asked = rows.where(F.col("id") % every == 0).mapInArrow(packs, "pack long, ids binary, vectors binary")
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.lit(True).alias("query"), "ids", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("binary").alias("norms"), "vectors")
    found = dealt.union(asked).repartition(n_blocks, "block").sortWithinPartitions("block", "query").mapInArrow(search, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
