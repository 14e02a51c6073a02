"""Audit reports: an audit is one customer's findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import audit_report as A
from .findings_queries import _SCORES, _scores
from .registry import query
from .views import Views


def inputs(v: Views) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    f, k, lit = v.findings, F.col("id"), F.lit
    findings = f.select(
        F.col("location").alias("audit"), "id", F.concat("category", lit(" #"), k.cast("string")).alias("title"), "severity", "category", "location", "hunter", "confidence",
        F.concat(lit("Seen at "), "location", lit(" with "), F.col("n_nodes").cast("string"), lit(" nodes.")).alias("description"),
        F.when(F.col("n_evidence") > 0, F.concat(lit("Repeat "), F.col("n_evidence").cast("string"), lit(" times."))).alias("attack_scenario"),
        F.when(k % 3 == 0, lit("Loss of funds.")).otherwise("").alias("impact"),
        F.when(F.col("n_evidence") > 0, F.transform(F.sequence(lit(1), F.greatest(F.col("n_evidence"), lit(1))), lambda i: F.concat(lit("line "), i.cast("string")))).alias("evidence"),
    )
    audits = f.groupBy(F.col("location").alias("audit")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    audits = audits.select("audit", F.concat(lit("Audit of "), "audit").alias("title"), lit("graphloom").alias("author"), lit("2026-01-05").cast("date").alias("day"), F.concat(lit("src/"), "audit").alias("target"), (F.col("first") % 100).cast("double").alias("seconds"), F.when(F.col("first") % 2 == 0, F.col("n") + 3).otherwise(0).alias("raw_count"))
    challenges = f.filter("id % 2 = 0").select("id", F.explode(F.array(lit(1), lit(2))).alias("ord")).select("id", "ord", F.concat(lit("objection "), F.col("ord").cast("string")).alias("challenge"), F.when(k % 4 == 0, "CONTESTED").otherwise("").alias("verdict"))
    proofs = f.filter("id % 5 = 0").select("id", F.concat(lit("\n  test "), k.cast("string"), lit(" \n")).alias("code"))
    return audits, findings, challenges, proofs, _scores(v).join(f.select("id", F.col("location").alias("audit")), "id")


_MARK = "CASE severity WHEN 'Critical' THEN '🔴 Critical' WHEN 'High' THEN '🟠 High' WHEN 'Medium' THEN '🟡 Medium' WHEN 'Low' THEN '🟢 Low' ELSE '⚪ Info' END"
_SQL = f"""WITH {_SCORES}, br AS (SELECT chr(10) AS n),
f AS (SELECT f.*, rk AS rank, row_number() OVER (PARTITION BY location, severity ORDER BY hunter, id) AS seq, {_MARK} AS mark FROM findings f JOIN rank USING (severity)),
g AS (SELECT *, substr(severity, 1, 1) || '-' || CASE WHEN seq < 10 THEN '0' ELSE '' END || seq AS number, category || ' #' || id AS title FROM f),
counts AS (SELECT location, severity, mark, rank, count(*) AS k FROM f GROUP BY ALL),
audits AS (SELECT location, count(*) AS k, min(id) AS first FROM f GROUP BY 1),
rows AS (
  SELECT location AS audit, 0 AS part, 0 AS rank, 0 AS seq, '# Audit of ' || location || n || n || '**Audited by:** graphloom  ' || n || '**Date:** January 05, 2026  ' || n || '**Target:** `src/' || location || '`  ' || n || '**Duration:** ' || (first % 100) || 's  ' || n || n || '---' || n AS text FROM audits, br
  UNION ALL SELECT location, 1, 0, 0, '## Summary' || n || n || 'The analysis yielded **' || k || ' verified finding(s)** from ' || (k + CASE WHEN first % 2 = 0 THEN 3 ELSE 0 END) || ' raw hypotheses (' || CASE WHEN first % 2 = 0 THEN 3 ELSE 0 END || ' refuted by the Critic agent).' || n || n || '| Severity | Count |' || n || '|---|:---:|' FROM audits, br
  UNION ALL SELECT location, 1, rank + 1, 0, '| ' || replace(mark, ' ', ' **') || '** | ' || k || ' |' FROM counts
  UNION ALL SELECT location, 2, 0, 0, n || '## Scope' || n || n || 'All contracts under `src/' || location || '` were analyzed.' || n || n || '## Severity Criteria' || n || n || '| Severity | Description |' || n || '|---|---|' || n
    || '| 🔴 **Critical** | Direct loss of funds, complete protocol compromise with no preconditions. |' || n || '| 🟠 **High** | Loss of funds requiring some preconditions, or a severe DoS. |' || n
    || '| 🟡 **Medium** | Indirect loss of funds, incorrect protocol behavior, or edge-case exploits. |' || n || '| 🟢 **Low** | Best-practice violations, missing checks, or minor inaccuracies. |' || n
    || '| ⚪ **Info** | Code quality, gas optimizations, or documentation improvements. |' || n || n || '---' || n || n || '## Findings' || n FROM audits, br
  UNION ALL SELECT location, 3, rank, 0, '### ' || mark || ' (' || k || CASE WHEN k > 1 THEN ' findings)' ELSE ' finding)' END || n || n || '| ID | Title | Location |' || n || '|:---:|---|---|' FROM counts, br
  UNION ALL SELECT location, 3, rank, seq, '| [' || number || '](#' || trim(regexp_replace(lower(number || ' ' || title), '[^a-z0-9]+', '-', 'g'), '-') || ') | ' || title || ' | `' || location || '` |' FROM g
  UNION ALL SELECT location, 4, rank, seq, CASE WHEN seq = 1 THEN '## ' || mark || ' Findings' || n || n ELSE '' END || '### ' || number || ' — ' || title || n || n || '| Field | Value |' || n || '|---|---|' || n || '| **Severity** | ' || mark || ' |' || n
    || '| **Category** | ' || category || ' |' || n || '| **Location** | `' || location || '` |' || n || '| **Hunter** | ' || hunter || ' |' || n || '| **Confidence** | ' || confidence || ' |' || n || n
    || '#### Vulnerability Details' || n || n || 'Seen at ' || location || ' with ' || n_nodes || ' nodes.' || n || n || CASE WHEN n_evidence > 0 THEN '#### Attack Scenario' || n || n || 'Repeat ' || n_evidence || ' times.' || n || n ELSE '' END
    || CASE WHEN id % 3 = 0 THEN '#### Impact' || n || n || 'Loss of funds.' || n || n ELSE '' END || CASE WHEN n_evidence > 0 THEN '#### Evidence' || n || n || array_to_string(list_transform(range(1, n_evidence + 1), lambda i: '- line ' || i), chr(10)) || n || n ELSE '' END
    || CASE WHEN id % 5 = 0 THEN '#### Proof of Concept' || n || n || '<details>' || n || '<summary>Foundry Test</summary>' || n || n || '```solidity' || n || 'test ' || id || n || '```' || n || n || '</details>' || n || n ELSE '' END
    || '#### Recommended Mitigation' || n || n || '_Review the attack scenario above and apply the principle of least privilege, validate all external inputs, and add the necessary invariant checks._' || n || n
    || CASE WHEN id % 2 = 0 THEN '<details>' || n || '<summary>Critic Debate Log (' || CASE WHEN id % 4 = 0 THEN 'CONTESTED' ELSE 'N/A' END || ')</summary>' || n || n || '> objection 2' || n || n || '</details>' || n || n ELSE '' END || '---' || n FROM g, br
  UNION ALL SELECT location, 5, -1000, 0, '## Appendix A: Confidence Score Matrix' || n || n || '| Finding ID | Structural | Critic | Severity | RAG | **Total** | Tier |' || n || '|:---|:---:|:---:|:---:|:---:|:---:|:---:|' FROM audits, br
  UNION ALL SELECT location, 5, -total, id, '| `' || id || '` | ' || structural || ' | ' || critic || ' | ' || grave || ' | ' || history || ' | **' || total || '** | ' || CASE WHEN total >= 90 THEN 'STRONG_CONFIRMED' WHEN total >= 70 THEN 'CONFIRMED' WHEN total >= 50 THEN 'CONTESTED' ELSE 'WEAK' END || ' |'
    FROM (SELECT id, structural, critic, grave, history, structural + critic + grave + history AS total FROM s) JOIN (SELECT id, location FROM findings) USING (id))
SELECT audit, part, rank, seq, text FROM rows"""


@query("audit_reports", "findings rank", _SQL)
def audit_reports(v: Views) -> DataFrame:
    """All sections of the report of every audit."""
    return A.report(*inputs(v))
