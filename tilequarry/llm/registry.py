"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive, bpe, chat, decontaminate, exactspans, linecrf, neardup, tokenfile, unigram, warc

PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), PIECES)


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe.digests(bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactspans.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), length=200, with_text=False)


def op4_additive_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op5_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return linecrf.score(docs, linecrf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = "</s>[INST] ok [/INST]"
    turns = turns.unionByName(spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text")))
    return chat.digests(chat.read_back(chat.conversations(chat.best_paths(chat.chain(turns)))))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=85)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokenfile.roundtrip(spark.read.parquet(f"{sf_dir}/documents.parquet"), TOKENIZER, public_tokenizers.PATTERN)
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_bpe_roundtrip, op3_suffix_dedup, op4_additive_neighbours, op5_warc_roundtrip, op6_decontaminate, op7_line_crf, op8_reply_trees, op9_near_duplicates, op10_token_files)}
ORACLES: dict[str, str] = {
    "op5_warc_roundtrip": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
     f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
""",
    "op8_reply_trees": chat.ORACLE,
    "op9_near_duplicates": r"""
WITH RECURSIVE word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
     own AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN [w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM word),
     sh AS (SELECT doc_id, unnest(list_distinct(s)) AS g FROM own),
     n AS (SELECT doc_id, len(list_distinct(s)) AS n FROM own),
     met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
     link AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
     edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
     walk AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, w.root FROM walk w JOIN edge e ON e.a = w.doc_id),
     top AS (SELECT doc_id, min(root) AS component_id FROM walk GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN top USING (doc_id)
""",
}
