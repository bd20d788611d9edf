"""The operators' queries over the test tables, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _repair_sql, _vector_sql, bpe, hnsw, jaccard, langid, linededup, mixing, packing, pii_crf, quality, secretscan, tokenfile, turnrepair, vectorcode
from ._common import documents


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(documents(spark, sf_dir))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.report(documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.report(documents(spark, sf_dir))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(documents(spark, sf_dir))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcode.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = turnrepair.damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turnrepair.report(damaged, F.col("present"), F.col("copies"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.report(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"))


_MIX_SQL = r"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n_docs FROM sized GROUP BY source),
named AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM per),
placed AS (SELECT *, cap::DOUBLE / weight AS cap_rate, row_number() OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST) AS place FROM named),
rated AS (SELECT *, (sum(source_size) OVER () - sum(cap) OVER (ORDER BY place) + cap)::DOUBLE / (sum(weight) OVER () - sum(weight) OVER (ORDER BY place) + weight)::DOUBLE AS rate FROM placed),
level AS (SELECT min_by(rate, place) AS rate FROM rated WHERE rate <= cap_rate),
aimed AS (SELECT source, source_size, n_docs, least(cap::DOUBLE, coalesce((SELECT rate FROM level), 0) * weight) AS target FROM rated),
sources AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aimed),
joined AS (SELECT d.*, s.source_size, s.target, s.whole, s.target - s.whole * s.source_size AS rest, s.source_size::DOUBLE / nullif(s.n_docs, 0) AS mean,
  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
ranked AS (SELECT *, u / (1 - u) / (rest / source_size / (1 - rest / source_size) * (size / mean)) AS q FROM joined WHERE size > 0 AND rest > 0),
run AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id) AS upto FROM ranked),
more AS (SELECT doc_id FROM run WHERE 2 * upto - size <= 2 * rest)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN whole + (doc_id IN (SELECT doc_id FROM more))::BIGINT ELSE 0 END) * size AS taken,
  CASE WHEN size > 0 THEN whole + (doc_id IN (SELECT doc_id FROM more))::BIGINT ELSE 0 END AS copies
FROM joined
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_token_files": op4_token_files,
    "op5_quality_rules": op5_quality_rules,
    "op6_language_id": op6_language_id,
    "op7_secret_scan": op7_secret_scan,
    "op8_personal_data": op8_personal_data,
    "op9_source_mix": op9_source_mix,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_codes": op11_vector_codes,
    "op12_turn_repair": op12_turn_repair,
    "op13_packing": op13_packing,
}

ORACLES: dict[str, str] = {
    "op9_source_mix": _MIX_SQL,
    "op11_vector_codes": _vector_sql.sql(),
    "op12_turn_repair": _repair_sql.SQL,
}
