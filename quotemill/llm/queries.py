"""The queries of this subpackage, each over the whole of its tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quotemill.llm import chat, decontaminate, html, licenses, merkle, mixing, packing, phrases, repeats, secret_scan, simhash, topk, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_digest(_read(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(_read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents")).drop("secret")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_main_text(_read(spark, sf_dir, "pages"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_digest(_read(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_digest(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op10_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(_read(spark, sf_dir, "conversations"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packing_digest(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest_digest(_read(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations_digest(_read(spark, sf_dir, "documents"))


QUERIES = (
    op1_repeats, op2_mixing, op3_topk, op4_toxicity, op5_secret_scan, op6_html_text, op7_license_scan, op8_simhash, op9_decontaminate,
    op10_chat_perspectives, op11_packing, op12_manifest, op13_collocations,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op3_topk": topk.ORACLE, "op7_license_scan": licenses.oracle(), "op10_chat_perspectives": chat.ORACLE, "op12_manifest": merkle.ORACLE, "op13_collocations": phrases.oracle()}
