"""Corpus pipeline over `documents`: language ID, line dedup, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and is written as Parquet and
read again before the next one. All stages but the last return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, jaccard, language, line_dedup, packing
from graphloom.llm.common import saved, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def packed_columns(docs: DataFrame) -> Column:
    """All columns as one, whatever their names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a language; a text without letters, or null, goes. Learns from the labelled rows of docs, and
    without a model, for want of labels, keeps every text that has a letter."""
    model = language.fit(docs, F.coalesce(~language.held_out(), F.lit(False)))
    if model is None:
        return docs.filter(language.has_letter())
    found = language.identify(docs.withColumn("_keep", packed_columns(docs)), model, ["_keep"])
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select("_keep.*")


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; a text that had lines and lost all of them goes."""
    rows = line_dedup.rewritten(docs).filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    length = F.length("text").cast(docs.schema["n_chars"].dataType)
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, length).otherwise(F.col("row.n_chars"))}
    return rows.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: that of the smallest doc_id, rows without doc_id last. Rows are told apart
    by numbers of their own, so that repeated rows and rows without doc_id are compared like all others."""
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), packed_columns(docs).alias("doc")), "rows")
    found = jaccard.classes(rows.select(F.col("row").alias("doc_id"), F.col("doc.text").alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    own = found.join(rows.select("row", F.col("doc.doc_id").alias("id")), "row")
    first = own.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select("doc.*")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin and place of every piece of every document."""
    return packing.pack(docs)


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_class),
    ("decontamination", decontaminated),
    ("packing", packed),
]

#: SQL can express neither the trained network nor best fit; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
