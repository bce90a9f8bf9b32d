"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again before the next.

Quality rules drop rejected documents and boilerplate lines; near-dedup keeps one document of each class; secret scans mask what they find and
drop nothing; mixing samples half of the tokens by calibrated probabilities; packing returns the pieces' places in the training sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from orewell.llm.common import stage
from orewell.llm.mixing import HOLD, sample
from orewell.llm.neardup import keep_one
from orewell.llm.packing import pack_documents
from orewell.llm.rules import apply_rules
from orewell.llm.secrets import redact_secrets
from orewell.session import ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return apply_rules(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return sample(docs, hold=HOLD)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Dart signatures, redaction and token ids are beyond SQL; tests compare the rows with a brute-force version.
ORACLE_SQL = None
