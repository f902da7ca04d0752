"""The queries of this subpackage, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licences, mixing, quality, secrets
from .common import table
from .htmltext import extract
from .mih import search
from .packing import best_fit
from .passages import repeated_passages
from .records import token_records
from .simhash import fingerprint_hex, near_duplicates


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(table(spark, sf_dir, "documents"))


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op5_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op6_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", fingerprint_hex().alias("fingerprint"), "component_id")


def op9_licence_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.digest(table(spark, sf_dir, "documents"))


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_ownership": op1_secret_ownership,
        "op2_quality_ledger": op2_quality_ledger,
        "op3_token_records": op3_token_records,
        "op4_multi_index_hashing": op4_multi_index_hashing,
        "op5_text_density": op5_text_density,
        "op6_curriculum": op6_curriculum,
        "op7_repeated_passages": op7_repeated_passages,
        "op8_simhash": op8_simhash,
        "op9_licence_dice": op9_licence_dice,
        "op10_best_fit": op10_best_fit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_secret_ownership": secrets.SQL,
        "op2_quality_ledger": quality.SQL,
        "op6_curriculum": mixing.SQL,
        "op9_licence_dice": licences.SQL,
    }
