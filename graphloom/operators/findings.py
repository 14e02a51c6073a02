"""Post-processing of findings: deduplication, verdicts, pairing, scores, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import severity_rank

#: Categories that chain with one another, and evidence classes of categories.
CHAINS = {
    "Oracle/Randomness": ("Accounting", "Governance", "External Call"),
    "Access Control": ("Proxy", "Governance", "Reentrancy"),
    "Proxy": ("Access Control", "External Call"),
    "Accounting": ("Oracle/Randomness", "Flash Loan"),
    "Reentrancy": ("Accounting", "External Call"),
    "Governance": ("Access Control", "Accounting"),
    "External Call": ("Reentrancy", "Access Control"),
    "Cryptography": ("Access Control", "Governance"),
    "DeFi Math": ("Oracle/Randomness", "Accounting"),
}
STRONG = ("Reentrancy", "Oracle/Randomness", "Access Control", "External Call", "Accounting")
MEDIUM = ("Governance", "Gas/DoS", "DeFi Math", "Cryptography")
WEAK = ("Proxy", "Cross-Chain")
PREFIX = {"Critical": "C", "High": "H", "Medium": "M", "Low": "L", "Info": "I"}


def chained() -> list[tuple[str, str]]:
    """Both directions of CHAINS."""
    return sorted({p for a, bs in CHAINS.items() for b in bs for p in ((a, b), (b, a))})


def first_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key. A minimum by the order is combined before the shuffle and sorts no groups."""
    own = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*own), F.struct(*order)).alias("_first"))
    return first.select(*(c if c in keys else F.col(f"_first.{c}").alias(c) for c in rows.columns))


def novel(batch: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a batch whose key is new; doubles inside the batch stay."""
    return batch.join(seen.select(*keys).distinct(), keys, "left_anti")


def converge(batches: list[DataFrame], keys: list[str], order: list) -> DataFrame:
    """First-wins union of batches, until one after the first has nothing new."""
    seen = first_wins(batches[0], keys, order).checkpoint()
    for b in batches[1:]:
        new = novel(first_wins(b, keys, order), seen, keys).checkpoint()
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def confidence_score(severity: Column, confidence: Column, category: Column, n_nodes: Column, n_evidence: Column, n_pre: Column, long_attack: Column) -> dict[str, Column]:
    """The four axes, their total and its tier."""
    structural = F.least(F.least(3 * n_nodes, F.lit(12)) + F.least(2 * n_evidence, F.lit(8)) + F.when(long_attack, 5).otherwise(0), F.lit(25))
    critic = F.when(confidence == "Confirmed", 25).when(confidence == "Uncertain", 15).when(confidence == "Refuted", 0).otherwise(10)
    base = F.when(severity == "Critical", 25).when(severity == "High", 20).when(severity == "Medium", 13).when(severity == "Low", 6).when(severity == "Info", 2).otherwise(10)
    grave = F.greatest(base - F.least(2 * n_pre, F.lit(10)), F.lit(0))
    history = F.when(category.isin(*STRONG), 25).when(category.isin(*MEDIUM), 17).when(category.isin(*WEAK), 10).otherwise(12)
    total = structural + critic + grave + history
    tier = F.when(total >= 90, "STRONG_CONFIRMED").when(total >= 70, "CONFIRMED").when(total >= 50, "CONTESTED").otherwise("WEAK")
    return {"structural": structural, "critic": critic, "grave": grave, "history": history, "total": total, "tier": tier}


def judge_verdict(verdict: Column, score: Column) -> Column:
    """Refuted below 50, contested below 80, or as the verdict says; 70 where there is no score."""
    s = F.coalesce(score, F.lit(70))
    return F.when((verdict == "REFUTED") | (s < 50), "Refuted").when((verdict == "CONTESTED") | (s < 80), "Contested").otherwise("Confirmed")


def critic_verdict(verdict: Column) -> Column:
    return F.when(verdict == "REFUTED", "Refuted").when(verdict == "CONTESTED", "Contested").when(verdict == "UNCERTAIN", "Uncertain").otherwise("Confirmed")


def numbering(rows: DataFrame) -> DataFrame:
    """Adds `number` such as H-01, counted by severity in the order of hunter and id."""
    prefix = F.coalesce(*(F.when(F.col("severity") == k, F.lit(v)) for k, v in PREFIX.items()), F.lit("F"))
    n = F.row_number().over(Window.partitionBy("severity").orderBy("hunter", "id"))
    return rows.withColumn("number", F.concat(prefix, F.lit("-"), F.when(n < 10, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))))


def chain_pairs(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs (a, b) of findings of medium severity or more with chained categories, a before b, of the same audit.

    keys name the audit, so the number of pairs grows with the findings of an audit and not of all."""
    spark = rows.sparkSession
    pairs = spark.createDataFrame(chained(), "ca string, cb string")
    good = rows.filter(severity_rank("severity") <= 2)
    a = good.select(F.col("id").alias("a"), F.col("category").alias("ca"), *keys).join(F.broadcast(pairs), "ca")
    b = good.select(F.col("id").alias("b"), F.col("category").alias("cb"), *keys)
    return a.join(b, ["cb", *keys]).filter("a < b").select("a", "b", "ca", "cb", *keys)


def depth_merge(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Findings with the results of a deeper look: refuted ones go, others take its texts where they are not empty."""
    joined = findings.join(results, "id", "left")
    kept = joined.filter(F.coalesce("verdict", F.lit("")) != "REFUTED")
    confidence = F.when(F.col("verdict") == "CONFIRMED", "Confirmed").when(F.col("verdict") == "PARTIAL", "Contested").otherwise(F.col("confidence"))
    return kept.select("id", "severity", confidence.alias("confidence"), F.coalesce(F.nullif("new_text", F.lit("")), F.col("category")).alias("text"))
