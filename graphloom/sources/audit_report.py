"""Audit reports as Markdown: ordered sections of text for many audits at once, and their sink.

Every section is a row (audit, part, rank, seq, text); its key orders the report. Findings have one row each, so that an
audit of any size is written by many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ranks import severity_rank
from ..operators.findings import PREFIX

#: Marks of the severities in their order, and what they mean.
MARKS = {"Critical": "🔴", "High": "🟠", "Medium": "🟡", "Low": "🟢", "Info": "⚪"}
CRITERIA = {
    "Critical": "Direct loss of funds, complete protocol compromise with no preconditions.",
    "High": "Loss of funds requiring some preconditions, or a severe DoS.",
    "Medium": "Indirect loss of funds, incorrect protocol behavior, or edge-case exploits.",
    "Low": "Best-practice violations, missing checks, or minor inaccuracies.",
    "Info": "Code quality, gas optimizations, or documentation improvements.",
}
MITIGATION = "_Review the attack scenario above and apply the principle of least privilege, validate all external inputs, and add the necessary invariant checks._"
KEY = ["audit", "part", "rank", "seq"]
COVER, COUNTS, SCOPE, CONTENTS, DETAILS, SCORES = range(6)


def _joined(*lines: Column | str | None) -> Column:
    """Lines that are not null, joined."""
    return F.array_join(F.array_compact(F.array(*(F.lit(x) if isinstance(x, str) else x for x in lines))), "\n")


def _map(values: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for p in values.items() for x in p)), key)


def _row(df: DataFrame, part: int, text: Column, rank: Column | int = 0, seq: Column | int = 0) -> DataFrame:
    number = lambda x: (F.lit(x) if isinstance(x, int) else x).cast("long")
    return df.select("audit", F.lit(part).alias("part"), number(rank).alias("rank"), number(seq).alias("seq"), text.alias("text"))


def numbered(findings: DataFrame) -> DataFrame:
    """Findings with `rank` of their severity, `seq` in it by hunter and id, and `number` such as H-01."""
    seq = F.row_number().over(Window.partitionBy("audit", "severity").orderBy("hunter", "id"))
    out = findings.withColumns({"rank": severity_rank("severity"), "seq": seq.cast("long")})
    return out.withColumn("number", F.concat(_map(PREFIX, F.col("severity")), F.lit("-"), F.when(F.col("seq") < 10, F.lit("0")).otherwise(""), F.col("seq").cast("string")))


def _optional(title: str, body: Column) -> Column:
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"#### {title}\n\n"), body, F.lit("\n")))


def details(rows: DataFrame) -> DataFrame:
    """One section of each numbered finding, with its proof and its last challenge where it has them."""
    c, lit = F.col, F.lit
    field = lambda name, value: F.concat(lit(f"| **{name}** | "), value, lit(" |"))
    mark = F.concat(_map(MARKS, c("severity")), lit(" "), c("severity"))
    evidence = F.when(F.size("evidence") > 0, F.concat(lit("#### Evidence\n\n- "), F.array_join("evidence", "\n- "), lit("\n")))
    proof = F.when(F.coalesce("code", lit("")) != "", F.concat(lit("#### Proof of Concept\n\n<details>\n<summary>Foundry Test</summary>\n\n```solidity\n"), F.trim("code", lit(" \t\r\n")), lit("\n```\n\n</details>\n")))
    debate = F.when(F.coalesce("challenge", lit("")) != "", F.concat(lit("<details>\n<summary>Critic Debate Log ("), F.coalesce(F.nullif("verdict", lit("")), lit("N/A")), lit(")</summary>\n\n> "), c("challenge"), lit("\n\n</details>\n")))
    text = _joined(
        F.concat(lit("### "), c("number"), lit(" — "), c("title"), lit("\n")),
        "| Field | Value |\n|---|---|",
        field("Severity", mark),
        field("Category", c("category")),
        field("Location", F.concat(lit("`"), c("location"), lit("`"))),
        field("Hunter", c("hunter")),
        F.concat(field("Confidence", c("confidence")), lit("\n")),
        F.concat(lit("#### Vulnerability Details\n\n"), F.coalesce("description", lit("")), lit("\n")),
        _optional("Attack Scenario", c("attack_scenario")),
        _optional("Impact", c("impact")),
        evidence,
        proof,
        lit(f"#### Recommended Mitigation\n\n{MITIGATION}\n"),
        debate,
        "---\n",
    )
    head = F.when(c("seq") == 1, F.concat(lit("## "), mark, lit(" Findings\n\n"))).otherwise("")
    return _row(rows, DETAILS, F.concat(head, text), c("rank"), c("seq"))


def contents(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """The tables of findings: a head for each severity, and a line for each finding that links to its section."""
    c, lit = F.col, F.lit
    n = c("n").cast("string")
    title = F.concat(lit("### "), _map(MARKS, c("severity")), lit(" "), c("severity"), lit(" ("), n, F.when(c("n") > 1, " findings)").otherwise(" finding)"), lit("\n\n| ID | Title | Location |\n|:---:|---|---|"))
    anchor = T.slugify(F.concat("number", lit(" "), "title"))
    line = F.concat(lit("| ["), c("number"), lit("](#"), anchor, lit(") | "), c("title"), lit(" | `"), c("location"), lit("` |"))
    return _row(counts, CONTENTS, title, c("rank"), 0).unionByName(_row(rows, CONTENTS, line, c("rank"), c("seq")))


def summary(audits: DataFrame, counts: DataFrame) -> DataFrame:
    """Cover, number of findings with the table of severities, scope and criteria. audits: (audit, title, author, day, target,
    seconds, raw_count)."""
    c, lit = F.col, F.lit
    cover = _joined(
        F.concat(lit("# "), c("title"), lit("\n")),
        F.concat(lit("**Audited by:** "), c("author"), lit("  ")),
        F.concat(lit("**Date:** "), F.date_format("day", "MMMM dd, yyyy"), lit("  ")),
        F.concat(lit("**Target:** `"), c("target"), lit("`  ")),
        F.concat(lit("**Duration:** "), F.round("seconds").cast("long").cast("string"), lit("s  \n\n---\n")),
    )
    total = counts.groupBy("audit").agg(F.sum("n").alias("n"))
    own = audits.join(total, "audit", "left").withColumn("n", F.coalesce("n", lit(0))).withColumn("raw", F.coalesce(F.nullif("raw_count", lit(0)), c("n")))
    said = F.format_string("## Summary\n\nThe analysis yielded **%d verified finding(s)** from %d raw hypotheses (%d refuted by the Critic agent).\n", c("n"), c("raw"), c("raw") - c("n"))
    said = F.concat(said, F.when(c("n") > 0, "\n| Severity | Count |\n|---|:---:|").otherwise(""))
    line = F.concat(lit("| "), _map(MARKS, c("severity")), lit(" **"), c("severity"), lit("** | "), c("n").cast("string"), lit(" |"))
    criteria = "\n## Severity Criteria\n\n| Severity | Description |\n|---|---|\n" + "\n".join(f"| {MARKS[s]} **{s}** | {CRITERIA[s]} |" for s in MARKS) + "\n\n---\n\n## Findings\n"
    scope = F.concat(lit("\n## Scope\n\nAll contracts under `"), c("target"), lit("` were analyzed.\n"), lit(criteria))
    return _row(audits, COVER, cover).unionByName(_row(own, COUNTS, said)).unionByName(_row(counts, COUNTS, line, c("rank") + 1)).unionByName(_row(audits, SCOPE, scope))


def score_table(scores: DataFrame) -> DataFrame:
    """The matrix of scores (audit, id, structural, critic, grave, history, total, tier), the highest first."""
    c, lit = F.col, F.lit
    head = lit("## Appendix A: Confidence Score Matrix\n\n| Finding ID | Structural | Critic | Severity | RAG | **Total** | Tier |\n|:---|:---:|:---:|:---:|:---:|:---:|:---:|")
    cells = (F.concat(lit("`"), c("id").cast("string"), lit("`")), c("structural"), c("critic"), c("grave"), c("history"), F.concat(lit("**"), c("total").cast("string"), lit("**")), c("tier"))
    line = F.concat(lit("| "), F.concat_ws(" | ", *(x.cast("string") for x in cells)), lit(" |"))
    return _row(scores.select("audit").distinct(), SCORES, head, -1000).unionByName(_row(scores, SCORES, line, -c("total"), c("id")))


def report(audits: DataFrame, findings: DataFrame, challenges: DataFrame, proofs: DataFrame, scores: DataFrame) -> DataFrame:
    """All sections of all audits. findings: (audit, id, title, severity, category, location, hunter, confidence, description,
    attack_scenario, impact, evidence); challenges: (id, ord, challenge, verdict), of which the last counts; proofs: (id, code)."""
    rows = numbered(findings)
    counts = rows.groupBy("audit", "severity", "rank").agg(F.count("*").alias("n"))
    last = challenges.groupBy("id").agg(F.max_by(F.struct("challenge", "verdict"), "ord").alias("c")).select("id", "c.*")
    full = rows.join(last, "id", "left").join(proofs.select("id", "code"), "id", "left")
    return summary(audits, counts).unionByName(contents(rows, counts)).unionByName(details(full)).unionByName(score_table(scores))


def write_report(sections: DataFrame, folder: str) -> None:
    """One folder of text files for each audit; files in order of their names, and lines in them, are the report."""
    n = max(1, int(sections.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = sections.repartitionByRange(n, *KEY).sortWithinPartitions(*KEY)
    rows.select("audit", "text").write.mode("overwrite").partitionBy("audit").text(folder)
