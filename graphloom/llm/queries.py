"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversations, rules, variants
from .common import table


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import document_versions

    return document_versions(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_documents

    return identify_documents(table(spark, sf_dir, "documents"))


def op7_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private import private_spans

    return private_spans(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import license_labels

    return license_labels(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op2_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import classes

    return classes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.prefix_trie(table(spark, sf_dir, "conversations"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op6_language": op6_language,
    "op7_private": op7_private,
    "op10_licenses": op10_licenses,
    "op2_jaccard": op2_jaccard,
    "op3_decontamination": op3_decontamination,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op8_packing": op8_packing,
    "op9_main_text": op9_main_text,
    "op11_variants": op11_variants,
    "op12_conversations": op12_conversations,
    "op13_rules": op13_rules,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op11_variants": variants.oracle(), "op12_conversations": conversations.oracle(), "op13_rules": rules.oracle()}
