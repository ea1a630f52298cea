"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, decontaminate, language_model, licenses, mixing, packing, quality, secrets, simhash, substrings, token_counts, urls, whitening


def _over(table: str, run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": _over("documents", quality.query),
        "op2_secret_scans": _over("documents", secrets.query),
        "op3_url_filters": _over("pages", urls.judge),
        "op4_token_counts": _over("documents", token_counts.query),
        "op5_source_mixing": _over("documents", mixing.query),
        "op6_substring_dedup": _over("documents", substrings.query),
        "op7_decontamination": lambda spark, sf_dir: decontaminate.links(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")),
        "op8_license_scans": _over("documents", licenses.query),
        "op9_language_model": _over("documents", language_model.query),
        "op10_simhash": _over("documents", simhash.query),
        "op11_packing": _over("documents", packing.query),
        "op12_whitening": _over("embeddings", whitening.query),
        "op13_tokenizer_alignment": _over("documents", alignment.query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality.oracle(), "op3_url_filters": urls.oracle(), "op5_source_mixing": mixing.oracle()}
