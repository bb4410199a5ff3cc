"""One query per operator, over the whole of its table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.ctw import lm_scores
from tidemark.llm.decontam import contaminated_pairs
from tidemark.llm import audit, licences, products
from tidemark.llm.lines import line_report
from tidemark.llm.mixing import mix_sources
from tidemark.llm.near import near_duplicates
from tidemark.llm.pieces import token_counts
from tidemark.llm.products import top_products
from tidemark.llm.quality import quality_verdicts
from tidemark.llm.repeats import repeated_strings
from tidemark.llm.secrets import secret_digest
from tidemark.llm.turns import damage_report


#: a sentencepiece model on the driver
VOCABULARY = os.environ.get("TIDEMARK_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    return licences.licence_matches(_table(spark, folder, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_strings(_table(spark, folder, "documents")).drop("removed")


def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scores(_table(spark, folder, "documents"))


def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(_table(spark, folder, "documents"), VOCABULARY)


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(_table(spark, folder, "documents"))


def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_verdicts(_table(spark, folder, "documents"))


def op7_temperature_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(_table(spark, folder, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated_pairs(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op9_secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digest(_table(spark, folder, "documents"))


def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_report(_table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return damage_report(_table(spark, folder, "conversations"))


def op12_top_products(spark: SparkSession, folder: str) -> DataFrame:
    return top_products(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.filter_audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scans": op1_license_scans,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_temperature_mixing": op7_temperature_mixing,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_secret_scans": op9_secret_scans,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_top_products": op12_top_products,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {"op1_license_scans": licences.ORACLE, "op12_top_products": products.ORACLE, "op13_filter_audit": audit.ORACLE}
