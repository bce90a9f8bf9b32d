"""The registered queries of this subpackage: thin bindings of the operators to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, mixing, rules, topk
from ..session import table as _table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_report

    return secret_report(_table(spark, sf_dir, "documents"))


def op9_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import line_rules

    return line_rules(_table(spark, sf_dir, "documents")).drop("removed")


def op4_mix_by_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op3_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import document_languages

    return document_languages(_table(spark, sf_dir, "documents"))


def op7_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import nearest_products

    return nearest_products(_table(spark, sf_dir, "embeddings"))


def op5_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_table(spark, sf_dir, "documents"))


def op6_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import written_documents

    return written_documents(_table(spark, sf_dir, "documents"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import classes

    return classes(_table(spark, sf_dir, "documents"))


def op10_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substrings import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op11_tiled_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .runs import run_report, with_loops

    return run_report(with_loops(_table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op13_decontaminate": op13_decontaminate,
    "op12_source_divergence": op12_source_divergence,
    "op11_tiled_runs": op11_tiled_runs,
    "op10_gear_chunks": op10_gear_chunks,
    "op2_dart_minhash": op2_dart_minhash,
    "op5_pattern_packing": op5_pattern_packing,
    "op6_rans_token_files": op6_rans_token_files,
    "op7_pivot_top_k": op7_pivot_top_k,
    "op3_quality_neighbours": op3_quality_neighbours,
    "op8_language_viterbi": op8_language_viterbi,
    "op4_mix_by_raking": op4_mix_by_raking,
    "op9_line_frequency_rules": op9_line_frequency_rules,
    "op1_secret_scan": op1_secret_scan,
}

ORACLE_SQL: dict[str, str] = {"op4_mix_by_raking": mixing.SQL, "op7_pivot_top_k": topk.SQL, "op12_source_divergence": divergence.SQL, "op13_decontaminate": decontaminate.SQL, "op9_line_frequency_rules": rules.SQL}
