"""The corpus pipeline: documents to token ids in five stages.

Each stage takes (spark, docs, sf_dir), works on every row of ``docs`` and
returns the columns of ``documents``; the last returns the encoded documents.
Rows are known by their texts and ids throughout: repeated ids stay separate rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilequarry.llm import bpe, decontaminate, exactspans, linecrf, neardup
from tilequarry.llm.common import written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _row(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``row``, a key of id and text; null text as empty.
    Rows that agree on both are one as far as any stage can tell, and share its
    verdict."""
    return docs.select(*COLUMNS).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("row", F.xxhash64("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier predicts to be bad go."""
    field = linecrf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = _row(docs)
    bad = linecrf.score(keyed, field, id_col="row").where("predicted = 0").select("row")
    return keyed.join(bad, "row", "left_anti").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8), the
    document of the smallest id stays (of rows that share it, one).  Each row has a key
    of its own in the order of ids, so that only the rows found go; rows with null ids
    have none and stay."""
    placed = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("place")).orderBy("doc_id", F.xxhash64("text"), "place")
    keyed = written(placed.select(*COLUMNS, F.monotonically_increasing_id().alias("at")), "rows").withColumn("row", F.when(F.col("doc_id").isNotNull(), F.col("at")))
    gone = neardup.near_duplicates(keyed, k=5, percent=80, id_col="row").where("NOT kept AND row IS NOT NULL").select("row")
    return keyed.join(gone, "row", "left_anti").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every byte under a repeated 200-byte string goes; of a character cut in two,
    the rest goes as well."""
    keyed = _row(docs)
    cut = exactspans.remove_repeats(keyed, length=200, id_col="row").where("n_removed > 0").dropDuplicates(["row"])
    cut = cut.select("row", F.col("kept_text").alias("rest"))
    text = F.coalesce("rest", "text")
    return keyed.join(cut, "row", "left").select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    keyed = _row(docs)
    bad = decontaminate.leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row").where("contaminated").select("row")
    return keyed.join(bad, "row", "left_anti").select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): byte-level BPE ids of every text that is left, as
    little-endian unsigned 32-bit integers."""
    ids = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("decontaminated", decontaminated), ("encoded", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
