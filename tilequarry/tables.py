"""Tables in the cluster's shared folder, and connected components over them."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Links that one task unites at most.
ONE_TASK_LINKS = 20_000
#: Tables of each session that ``release`` has not deleted yet.
_kept: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, one under the
    system's temporary folder in local mode (tests), and an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "tilequarry-shared")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; ``release`` deletes what is written there."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _kept.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove one table of the shared folder, whose readers are all done."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    kept = _kept.get(spark.sparkContext.applicationId, [])
    if path in kept:
        kept.remove(path)


def release(spark: SparkSession) -> int:
    """Delete every intermediate table this session has written so far and return how
    many there were.  Results that are not stored yet can't be read afterwards."""
    paths = list(_kept.get(spark.sparkContext.applicationId, []))
    for path in paths:
        delete(spark, path)
    return len(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and
    return the reread table (survives the loss of any executor)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """``df`` for a join that deals both sides out and merges them, whatever their sizes
    are thought to be: those of compressed tables, exploded rows and Python functions are
    put far too low, and what is broadcast goes through the driver."""
    return df.hint("merge")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _stored(df: DataFrame, name: str) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's links (a, b) by union of trees."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    kind = None
    for batch in batches:
        kind = batch.schema.types[0]
        plain = (lambda x: tuple(x.values())) if pa.types.is_struct(kind) else (lambda x: x)
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(plain(a)), root(plain(b))
            up[max(a, b)] = min(a, b)
    if kind is not None:
        names = [f.name for f in kind] if pa.types.is_struct(kind) else None
        column = lambda xs: pa.array([dict(zip(names, x)) for x in xs] if names else xs, kind)
        yield pa.record_batch([column(list(up)), column(list(map(root, list(up))))], ["node", "up"])


def components(links: DataFrame, name: str = "components", one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """(node, component): the smallest node reachable over undirected ``links``
    (a, b: any one orderable type), for every node in them.

    The graph is contracted until few links are left.  In a round each node takes the
    name of one node next to it, or keeps its own: in the first round the smallest
    (which settles stars about their smallest node), then the one of the smallest
    random rank, new in each round, so that an expected share of the names goes
    whatever the shape.  Links carry on between names; those within one name and
    repeated ones are dropped, so the rounds together handle a small multiple of the
    links.  Their number is logarithmic in expectation and not limited.  Once at most
    ``one_task`` links are left (none with 0), one task unites them; names are then
    resolved from the last round back to the first.

    Hubs are aggregated before their shuffle; in the joins their rows share a key that
    adaptive execution splits.  Links with a null end join nothing and are dropped;
    self-links only name their node; tables of earlier rounds are deleted."""
    spark = links.sparkSession
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    path, edges = _stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-links")
    rounds: list[tuple[str, DataFrame]] = []
    while edges.limit(one_task + 1).count() > one_task:
        k = len(rounds)
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("y")).union(edges.select("b", "a"))
        if k == 0:
            took = both.groupBy("node").agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("up"))
        else:
            rank = lambda c: F.xxhash64(F.lit(k), c)
            took = both.groupBy("node").agg(F.min_by("y", rank("y")).alias("y")).select("node", F.when(rank("y") < rank("node"), F.col("y")).otherwise(F.col("node")).alias("up"))
        rounds.append(_stored(took, f"{name}-{k}"))
        names = rounds[-1][1]
        ends = edges.join(dealt(names.select(F.col("node").alias("a"), F.col("up").alias("p"))), "a").join(dealt(names.select(F.col("node").alias("b"), F.col("up").alias("q"))), "b")
        after, left = _stored(ends.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), f"{name}-links")
        delete(spark, path)
        path, edges = after, left
    kind = edges.schema["a"].dataType.simpleString()
    after, top = _stored(edges.coalesce(1).mapInArrow(_settled, f"node {kind}, up {kind}"), f"{name}-names")
    delete(spark, path)
    path = after
    if not rounds:
        return top.select("node", F.col("up").alias("component"))
    while rounds:
        lower, names = rounds.pop()
        resolved = names.join(dealt(top.select(F.col("node").alias("up"), F.col("up").alias("over"))), "up", "left")
        after, above = _stored(resolved.select("node", F.coalesce("over", "up").alias("up")), f"{name}-names")
        delete(spark, path)
        delete(spark, lower)
        path, top = after, above
    least = top.groupBy("up").agg(F.min("node").alias("component"))
    out = written(top.join(dealt(least), "up").select("node", "component"), name)
    delete(spark, path)
    return out
