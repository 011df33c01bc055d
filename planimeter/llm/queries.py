"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planimeter.llm import licenses, mixing, neighbours, perplexity, pieces, pii, quality_rules, sharding, simhash, suffix_dedup


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.simhash_components(table(spark, sf_dir, "documents"), shingle=4, words=1, max_bits=4)
    return out.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op3_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.quality_by_perplexity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"))


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("src")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), limit_bytes=4_000_000)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_perplexity": op3_perplexity,
        "op4_sentencepiece": op4_sentencepiece,
        "op5_simhash": op5_simhash,
        "op6_neighbours": op6_neighbours,
        "op7_licenses": op7_licenses,
        "op8_mixing": op8_mixing,
        "op9_pii": op9_pii,
        "op10_sharding": op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_sharding": SHARDING_SQL}


SHARDING_SQL = """
WITH RECURSIVE d AS MATERIALIZED (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(coalesce(doc_id::VARCHAR, 't' || text, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents
), b(prefix, depth, bytes) AS (
  SELECT '', 0::BIGINT, sum(n_bytes)::BIGINT FROM d
  UNION ALL
  SELECT s.prefix || s.bit, s.depth + 1, sum(d.n_bytes)::BIGINT
  FROM (SELECT * FROM b CROSS JOIN (VALUES ('0'), ('1')) v(bit) WHERE bytes > 4000000 AND depth < 60) s
  JOIN d ON starts_with(d.bits, s.prefix || s.bit)
  GROUP BY s.prefix, s.bit, s.depth
)
SELECT d.doc_id, d.n_bytes, b.prefix AS shard, b.depth, 0::BIGINT AS page, b.bytes AS shard_bytes
FROM d JOIN b ON starts_with(d.bits, b.prefix) AND b.bytes <= 4000000
"""
