"""Queries over findings and usage logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import parse_severity, severity_rank
from ..operators import findings as N
from ..streaming import usage
from .registry import query
from .retrieval_queries import _checkpoints
from .views import Views

_RANK = "CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 WHEN 'Info' THEN 4 ELSE 5 END"


@query("severity_counts", "findings", f"SELECT severity, {_RANK} AS rank, count(*) AS n FROM findings GROUP BY 1")
def severity_counts(v: Views) -> DataFrame:
    return v.findings.groupBy("severity").agg(F.count("*").alias("n")).withColumn("rank", severity_rank("severity"))


@query("severity_gate", "findings", f"SELECT id, {_RANK} <= 1 AS deep, {_RANK} <= 2 AS chain FROM findings")
def severity_gate(v: Views) -> DataFrame:
    return v.findings.select("id", (severity_rank("severity") <= 1).alias("deep"), (severity_rank("severity") <= 2).alias("chain"))


@query("survivors", "findings", "SELECT id, severity FROM findings WHERE CASE WHEN id % 7 = 0 THEN 'Refuted' ELSE confidence END <> 'Refuted'")
def survivors(v: Views) -> DataFrame:
    """Findings that the verdicts, where there are any, have not refuted."""
    verdicts = v.findings.filter("id % 7 = 0").select("id", F.lit("Refuted").alias("verdict"))
    return v.findings.join(verdicts, "id", "left").filter(F.coalesce("verdict", "confidence") != "Refuted").select("id", "severity")


@query("dedup_first", "findings", "SELECT min(id) AS id, location, category FROM findings GROUP BY 2, 3")
def dedup_first(v: Views) -> DataFrame:
    return N.first_wins(v.findings, ["location", "category"], ["id"]).select("id", "location", "category")


@query("novel_findings", "findings", "SELECT id FROM findings f WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM findings s WHERE s.id % 2 = 0 AND s.location = f.location AND s.category = f.category)")
def novel_findings(v: Views) -> DataFrame:
    f = v.findings
    return N.novel(f.filter("id % 2 = 1"), f.filter("id % 2 = 0"), ["location", "category"]).select("id")


@query(
    "converge",
    "findings",
    """WITH r AS (SELECT id, location, hunter, id % 3 AS round, min(id % 3) OVER (PARTITION BY location, hunter) AS first FROM findings)
    SELECT min(id) AS id, location, hunter FROM r WHERE round = first GROUP BY 2, 3""",
)
def converge(v: Views) -> DataFrame:
    _checkpoints(v)
    f = v.findings.select("id", "location", "hunter")
    return N.converge([f.filter(F.col("id") % 3 == i) for i in range(3)], ["location", "hunter"], ["id"])


@query("finding_numbering", "findings", "SELECT id, substr(severity, 1, 1) || '-' || CASE WHEN n < 10 THEN '0' || n ELSE CAST(n AS VARCHAR) END AS number FROM (SELECT id, severity, row_number() OVER (PARTITION BY severity ORDER BY hunter, id) AS n FROM findings)")
def finding_numbering(v: Views) -> DataFrame:
    return N.numbering(v.findings).select("id", "number")


_CHAINED = """(VALUES ('Oracle/Randomness', 'Accounting'), ('Oracle/Randomness', 'Governance'), ('Oracle/Randomness', 'External Call'), ('Access Control', 'Proxy'), ('Access Control', 'Governance'), ('Access Control', 'Reentrancy'), ('Proxy', 'External Call'),
    ('Accounting', 'Flash Loan'), ('Reentrancy', 'Accounting'), ('Reentrancy', 'External Call'), ('Governance', 'Accounting'), ('External Call', 'Access Control'), ('Cryptography', 'Access Control'), ('Cryptography', 'Governance'), ('DeFi Math', 'Oracle/Randomness'), ('DeFi Math', 'Accounting'))"""


@query(
    "chain_pairs",
    "findings",
    f"SELECT DISTINCT a.id AS a, b.id AS b FROM findings a JOIN findings b ON a.location = b.location AND a.id < b.id JOIN {_CHAINED} p(ca, cb) ON (ca = a.category AND cb = b.category) OR (cb = a.category AND ca = b.category) WHERE a.severity IN ('Critical', 'High', 'Medium') AND b.severity IN ('Critical', 'High', 'Medium')",
)
def chain_pairs(v: Views) -> DataFrame:
    return N.chain_pairs(v.findings, ["location"]).select("a", "b")


_AXES = """least(least(3 * n_nodes, 12) + least(2 * n_evidence, 8) + CASE WHEN price > 200000 THEN 5 ELSE 0 END, 25)"""
_SCORES = f"""s AS (SELECT id, {_AXES} AS structural, CASE confidence WHEN 'Confirmed' THEN 25 WHEN 'Uncertain' THEN 15 WHEN 'Refuted' THEN 0 ELSE 10 END AS critic,
    greatest(CASE severity WHEN 'Critical' THEN 25 WHEN 'High' THEN 20 WHEN 'Medium' THEN 13 WHEN 'Low' THEN 6 ELSE 2 END - least(2 * n_pre, 10), 0) AS grave,
    CASE WHEN category IN {N.STRONG} THEN 25 WHEN category IN {N.MEDIUM} THEN 17 WHEN category IN {N.WEAK} THEN 10 ELSE 12 END AS history FROM findings)"""


def _scores(v: Views) -> DataFrame:
    c = F.col
    axes = N.confidence_score(c("severity"), c("confidence"), c("category"), c("n_nodes"), c("n_evidence"), c("n_pre"), c("price") > 200000)
    return v.findings.select("id", *(x.cast("long").alias(n) if n != "tier" else x.alias(n) for n, x in axes.items()))


@query("confidence_score", "findings", f"WITH {_SCORES} SELECT id, structural, critic, grave, history, structural + critic + grave + history AS total, CASE WHEN total >= 90 THEN 'STRONG_CONFIRMED' WHEN total >= 70 THEN 'CONFIRMED' WHEN total >= 50 THEN 'CONTESTED' ELSE 'WEAK' END AS tier FROM s")
def confidence_score(v: Views) -> DataFrame:
    return _scores(v)


@query("top_scores", "findings", f"WITH {_SCORES} SELECT id, structural + critic + grave + history AS total FROM s ORDER BY 2 DESC, 1 LIMIT 25")
def top_scores(v: Views) -> DataFrame:
    return _scores(v).select("id", "total").orderBy(F.desc("total"), "id").limit(25)


@query("judge_verdict", "findings", "SELECT id, CASE WHEN id % 10 = 0 OR id % 100 < 50 THEN 'Refuted' WHEN id % 10 = 1 OR id % 100 < 80 THEN 'Contested' ELSE 'Confirmed' END AS verdict FROM findings")
def judge_verdict(v: Views) -> DataFrame:
    said = F.when(F.col("id") % 10 == 0, "REFUTED").when(F.col("id") % 10 == 1, "CONTESTED").otherwise("CONFIRMED")
    return v.findings.select("id", N.judge_verdict(said, F.col("id") % 100).alias("verdict"))


@query("critic_verdict", "findings", "SELECT id, CASE upper(confidence) WHEN 'CONTESTED' THEN 'Contested' WHEN 'UNCERTAIN' THEN 'Uncertain' ELSE 'Confirmed' END AS verdict FROM findings")
def critic_verdict(v: Views) -> DataFrame:
    return v.findings.select("id", N.critic_verdict(F.upper("confidence")).alias("verdict"))


@query(
    "depth_merge",
    "findings",
    "SELECT id, severity, CASE id % 4 WHEN 1 THEN 'Confirmed' WHEN 2 THEN 'Contested' ELSE confidence END AS confidence, CASE WHEN id % 8 = 1 THEN 'deep ' || id ELSE category END AS text FROM findings WHERE id % 4 <> 0",
)
def depth_merge(v: Views) -> DataFrame:
    verdict = F.when(F.col("id") % 4 == 0, "REFUTED").when(F.col("id") % 4 == 1, "CONFIRMED").when(F.col("id") % 4 == 2, "PARTIAL")
    results = v.findings.select("id", verdict.alias("verdict"), F.when(F.col("id") % 8 == 1, F.concat(F.lit("deep "), F.col("id").cast("string"))).otherwise("").alias("new_text"))
    return N.depth_merge(v.findings, results)


@query("debate_log", "findings", "SELECT location, count(*) AS n, max_by(category, id) AS last_category FROM findings GROUP BY 1")
def debate_log(v: Views) -> DataFrame:
    return v.findings.groupBy("location").agg(F.count("*").alias("n"), F.max_by("category", "id").alias("last_category"))


@query("finding_overlay", "findings", f"SELECT node, count(*) AS n, min({_RANK}) AS worst FROM (SELECT 'fn:' || location AS node, severity FROM findings UNION ALL SELECT 'contract:' || string_split(location, '.')[1], severity FROM findings) GROUP BY 1")
def finding_overlay(v: Views) -> DataFrame:
    nodes = F.array(F.concat(F.lit("fn:"), "location"), F.concat(F.lit("contract:"), F.split("location", r"\.")[0]))
    return v.findings.select(F.explode(nodes).alias("node"), severity_rank("severity").alias("r")).groupBy("node").agg(F.count("*").alias("n"), F.min("r").alias("worst"))


@query("groups_by_min_rank", "findings", f"SELECT string_split(location, '.')[1] AS contract, min({_RANK}) AS worst, count(*) AS n, row_number() OVER (ORDER BY min({_RANK}), string_split(location, '.')[1]) AS place FROM findings GROUP BY 1")
def groups_by_min_rank(v: Views) -> DataFrame:
    g = v.findings.groupBy(F.split("location", r"\.")[0].alias("contract")).agg(F.min(severity_rank("severity")).alias("worst"), F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("worst", "contract")).cast("long"))


@query(
    "report_rows",
    "findings",
    f"SELECT severity, {_RANK} AS rank, count(*) AS n, count(DISTINCT location) AS n_places, min(id) AS first_id FROM findings WHERE confidence = 'Confirmed' GROUP BY 1",
)
def report_rows(v: Views) -> DataFrame:
    rows = v.findings.filter("confidence = 'Confirmed'").groupBy("severity").agg(F.count("*").alias("n"), F.count_distinct("location").alias("n_places"), F.min("id").alias("first_id"))
    return rows.withColumn("rank", severity_rank("severity"))


@query("submission_rows", "findings", "SELECT id, CASE severity WHEN 'Critical' THEN 'High' ELSE severity END AS severity, string_split(location, '.')[1] AS path, category || ': ' || hunter AS description FROM findings WHERE severity <> 'Info'")
def submission_rows(v: Views) -> DataFrame:
    return v.findings.filter("severity <> 'Info'").select("id", F.when(F.col("severity") == "Critical", "High").otherwise(F.col("severity")).alias("severity"), F.split("location", r"\.")[0].alias("path"), F.concat("category", F.lit(": "), "hunter").alias("description"))


@query(
    "digest_budget",
    "findings",
    f"SELECT hunter, id FROM (SELECT hunter, id, sum(length(severity) + length(location) + length(category) + 1) OVER (PARTITION BY hunter ORDER BY {_RANK}, id ROWS UNBOUNDED PRECEDING) AS running FROM findings) WHERE running <= 2500",
)
def digest_budget(v: Views) -> DataFrame:
    from ..operators import budget

    length = F.length("severity") + F.length("location") + F.length("category") + 1
    return budget.hard_prefix(v.findings, ["hunter"], [severity_rank("severity"), "id"], length, 2500).select("hunter", "id")


@query("rerank_or_rrf", "findings", "SELECT id FROM findings ORDER BY CASE WHEN (SELECT min_by(price, id) FROM findings) > 0 THEN price ELSE n_nodes END DESC, id LIMIT 20")
def rerank_or_rrf(v: Views) -> DataFrame:
    """Sort by the first score if the first row has one, else by the second."""
    f = v.findings
    flag = f.agg((F.min_by("price", "id") > 0).alias("has"))
    key = F.when(F.col("has"), F.col("price")).otherwise(F.col("n_nodes"))
    return f.join(F.broadcast(flag)).orderBy(F.desc(key), "id").limit(20).select("id")


@query("parse_findings", sql="SELECT conv_id, turn, CASE upper(role) WHEN 'USER' THEN 'High' ELSE 'Medium' END AS severity FROM conversations")
def parse_findings(v: Views) -> DataFrame:
    return v.table("conversations").select("conv_id", "turn", parse_severity(F.when(F.upper("role") == "USER", F.lit(" hIGH ")).otherwise(F.lit("?"))).alias("severity"))


@query(
    "run_summary",
    sql="SELECT event_type AS action, count(*) AS n, round(sum(value), 4) AS cost, CAST(sum(coalesce(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT), 0)) AS BIGINT) AS tokens FROM events GROUP BY 1",
)
def run_summary(v: Views) -> DataFrame:
    tokens = F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0))
    return v.table("events").groupBy(F.col("event_type").alias("action")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("cost"), F.sum(tokens).alias("tokens"))


@query("sliding_60s", sql="SELECT event_id, count(*) OVER w AS used, round(sum(value) OVER w, 4) AS total FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)")
def sliding_60s(v: Views) -> DataFrame:
    return usage.sliding_usage(v.table("events"), "user_id", "ts", "value").select("event_id", "used", F.round("total", 4).alias("total"))


@query(
    "rate_admission",
    sql="""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_id % 50 AS i, event_id % 7 AS o, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rk FROM events),
    step AS (SELECT user_id, CAST(0 AS BIGINT) AS rk, CAST(NULL AS BIGINT) AS event_id, false AS admitted, CAST([] AS STRUCT(t BIGINT, i BIGINT, o BIGINT)[]) AS held FROM e GROUP BY user_id
        UNION ALL SELECT user_id, rk, event_id, ok, CASE WHEN ok THEN list_append(live, {'t': t, 'i': i, 'o': o}) ELSE live END
        FROM (SELECT *, len(live) + 1 <= 4 AND coalesce(list_sum(list_transform(live, lambda x: x.i)), 0) + i <= 90 AND coalesce(list_sum(list_transform(live, lambda x: x.o)), 0) + o <= 13 AS ok
            FROM (SELECT e.*, list_filter(step.held, lambda x: x.t > e.t - 60000000) AS live FROM step JOIN e ON e.user_id = step.user_id AND e.rk = step.rk + 1)))
    SELECT event_id, user_id, admitted FROM step WHERE rk > 0""",
)
def rate_admission(v: Views) -> DataFrame:
    """Requests in order of time, each admitted if its budgets of the last minute are not used up: 4, 90 and 13 here."""
    k = F.col("event_id")
    return usage.admit(v.table("events").select("event_id", "user_id", "ts", (k % 50).alias("tokens_in"), (k % 7).alias("tokens_out")), 5, 100, 15)


@query("reservation_fold", sql="SELECT user_id, event_type AS reservation, max_by(value, event_id) AS last_value FROM events GROUP BY 1, 2")
def reservation_fold(v: Views) -> DataFrame:
    return v.table("events").groupBy("user_id", F.col("event_type").alias("reservation")).agg(F.max_by("value", "event_id").alias("last_value"))


@query("webhook_dedup", sql="SELECT user_id AS task_id, min(event_id) AS first_event FROM events WHERE event_type <> 'view' GROUP BY 1")
def webhook_dedup(v: Views) -> DataFrame:
    """One task for each id in flight; pings are left out."""
    rows = v.table("events").filter("event_type <> 'view'")
    return rows.groupBy(F.col("user_id").alias("task_id")).agg(F.min("event_id").alias("first_event"))


@query("insert_if_absent", sql="SELECT doc_id, source FROM documents WHERE doc_id % 2 = 1")
def insert_if_absent(v: Views) -> DataFrame:
    from ..sources.ingest import insert_if_absent as insert

    d = v.table("documents").select("doc_id", "source")
    return insert(d.filter("doc_id % 2 = 0"), d, ["doc_id"])


@query("get_or_create", sql="SELECT DISTINCT source AS name, sha256(source) AS id FROM documents")
def get_or_create(v: Views) -> DataFrame:
    from ..sources.ingest import get_or_create as create

    names = v.table("documents").select(F.col("source").alias("name"))
    return create(v.spark.createDataFrame([], "name string, id string"), names)


