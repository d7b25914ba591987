"""The subpackage's queries: ``opN_<name>``, each over its whole input table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, decontam, html_text, langid, mixing, neardup, packing, quality, runs, spelling, tokens, topk, toxicity
from ..session import materialize
from .common import read_table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_table(read_table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_table(read_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_table(materialize(mixing.sized(read_table(spark, sf_dir, "documents")), "mixing-sizes"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.neardup_table(read_table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_table(read_table(spark, sf_dir, "documents"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_table(read_table(spark, sf_dir, "embeddings"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_table(read_table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_table(read_table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_table(read_table(spark, sf_dir, "documents"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_table(read_table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontamination_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_quality, op3_html_text, op4_mixing, op5_toxicity, op6_near_dedup, op7_token_counts, op8_exact_top_k, op9_ann, op10_packing,
                                      op11_spelling, op12_runs, op13_decontaminate)}


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": mixing.ORACLE_SQL, "op6_near_dedup": neardup.ORACLE_SQL, "op8_exact_top_k": topk.ORACLE_SQL,
            "op11_spelling": spelling.ORACLE_SQL, "op13_decontaminate": decontam.ORACLE_SQL}
