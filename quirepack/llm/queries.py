"""The registered queries of this subpackage and their SQL forms for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, licenses, oracles, pieces, pii, quality, sharding, substrings, token_files, warc

SHARDS = 16


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op1(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op2(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"), "doc_id", "text", [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.op4(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op5(_table(spark, sf_dir, "pages"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op6(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.op7(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.op8(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op10(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_jaccard_join, op2_decontamination, op3_sharding, op4_substring_dedup, op5_warc, op6_license_scan, op7_token_files, op8_pieces, op9_pii, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard_join": oracles.jaccard(),
        "op2_decontamination": oracles.decontamination(),
        "op3_sharding": oracles.sharding(SHARDS),
        "op4_substring_dedup": oracles.substrings(),
        "op5_warc": oracles.archives(),
        "op6_license_scan": licenses.oracle(),
    }
