"""Replies made of the texts of conversations: six forms around one JSON object, read back as nodes, edges and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import replies as P
from .registry import query
from .views import Views

KEY = ["conv_id", "turn"]


def in_forms(body: Column) -> Column:
    """A closed json fence, a plain fence, an object in prose, an open json fence, the bare object, and no JSON."""
    forms = (("Sure:\n```json\n", "\n```\nThat is {all}."), ("```\n", "\n```"), ("I see ", " and no more."), ("```json\n", ""), ("", ""))
    k = (F.col("conv_id") + F.col("turn")) % 6
    return F.coalesce(*(F.when(k == i, F.concat(F.lit(a), body, F.lit(b))) for i, (a, b) in enumerate(forms)), F.concat(F.lit("Nothing { here: "), "role"))


def enriched(v: Views) -> tuple[DataFrame, DataFrame, DataFrame]:
    even, third = F.col("turn") % 2 == 0, F.col("conv_id") % 3 == 0
    var = F.concat(F.lit("var:Brand#"), 10 * (1 + F.col("conv_id") % 5) + 1 + F.col("turn") % 7)
    boundary = F.struct(F.when(~third, F.concat(F.lit("n"), "conv_id")).alias("name"), F.when(even, "TRUSTED").alias("trust_level"), F.when(even, F.array(F.lit("onlyOwner"), "role")).alias("related_modifiers"), F.col("text").alias("description"))
    invariant = F.struct(F.when(even, F.concat(F.lit("I"), "turn")).alias("id"), F.col("text").alias("description"), F.when(third, "code").alias("source"), F.lit('a < "b"').alias("formal"), F.array(var, F.lit("var:none")).alias("related_vars"))
    body = F.to_json(F.struct(F.when(~third, F.col("role")).alias("protocol_type"), F.array(boundary).alias("trust_boundaries"), F.when(F.col("turn") > 0, F.array(invariant, invariant.withField("id", F.lit(None).cast("string")))).alias("invariants"), F.array(F.lit("x"), F.col("role")).alias("attack_surface_notes")))
    return P.enrichment(v.table("conversations").select(*KEY, in_forms(body).alias("reply")), KEY, "reply")


_OWN = "own AS (SELECT *, conv_id % 3 = 0 AS third, turn % 2 = 0 AS even FROM conversations WHERE (conv_id + turn) % 6 < 5)"


@query(
    "enrichment_nodes",
    sql=f"""WITH {_OWN} SELECT conv_id, turn, 'TrustBoundary' AS type, 'trust:' || CASE WHEN third THEN 'unknown' ELSE 'n' || conv_id END AS id, CASE WHEN even THEN 'TRUSTED' ELSE 'UNTRUSTED' END AS level, CASE WHEN even THEN 'onlyOwner,' || role ELSE '' END AS actors, text AS description, CAST(NULL AS VARCHAR) AS source, CAST(NULL AS VARCHAR) AS formal FROM own
    UNION ALL SELECT conv_id, turn, 'Invariant', 'invariant:' || CASE WHEN even AND n = 1 THEN 'I' || turn ELSE 'INV-' || n END, NULL, '', text, CASE WHEN third THEN 'code' ELSE 'inferred' END, 'a < "b"' FROM own, (SELECT unnest([1, 2]) AS n) WHERE turn > 0""",
)
def enrichment_nodes(v: Views) -> DataFrame:
    """Trust boundaries and invariants of all replies, with the defaults of what they leave out."""
    return enriched(v)[0].select(*KEY, "type", "id", "level", F.array_join("actors", ",").alias("actors"), "description", "source", "formal")


@query(
    "enrichment_edges",
    "variables",
    f"""WITH {_OWN}, e AS (SELECT conv_id, turn, 'invariant:' || CASE WHEN even AND n = 1 THEN 'I' || turn ELSE 'INV-' || n END AS src, 'var:Brand#' || (10 * (1 + conv_id % 5) + 1 + turn % 7) AS dst FROM own, (SELECT unnest([1, 2]) AS n) WHERE turn > 0)
    SELECT * FROM e WHERE dst IN (SELECT id FROM variables)""",
)
def enrichment_edges(v: Views) -> DataFrame:
    """DEPENDS_ON edges of invariants to the variables that exist."""
    return enriched(v)[1].join(v.variables.select(F.col("id").alias("dst")), "dst", "left_semi").select(*KEY, "src", "dst")


@query("enrichment_metadata", sql=f"WITH {_OWN} SELECT conv_id, turn, CASE WHEN third THEN 'unknown' ELSE role END AS protocol_type, '' AS protocol_purpose, 'x,' || role AS notes FROM own")
def enrichment_metadata(v: Views) -> DataFrame:
    return enriched(v)[2].select(*KEY, "protocol_type", "protocol_purpose", F.array_join("notes", ",").alias("notes"))


@query(
    "reply_verdicts",
    sql="""SELECT conv_id, turn, CASE WHEN k = 5 OR turn % 4 = 3 THEN 'CONFIRMED' ELSE upper(role) END AS verdict, CASE WHEN k = 5 OR turn % 2 = 1 THEN 70 ELSE CAST(10 + turn AS INT) END AS confidence_score,
        CASE WHEN k = 5 THEN left('Nothing { here: ' || role, 300) ELSE text END AS summary, CASE WHEN k = 5 THEN '' WHEN conv_id % 2 = 0 THEN '1,3' ELSE '3' END AS gates FROM (SELECT *, (conv_id + turn) % 6 AS k FROM conversations)""",
)
def reply_verdicts(v: Views) -> DataFrame:
    """Verdict, score, summary and passed gates of a judge's replies; the default row without JSON."""
    gate = lambda passed: F.struct(passed.alias("passed"), F.lit("why }").alias("reasoning"))
    body = F.struct(
        F.when(F.col("turn") % 4 != 3, F.col("role")).alias("verdict"),
        F.when(F.col("turn") % 2 == 0, 10 + F.col("turn")).alias("confidence_score"),
        F.col("text").alias("summary"),
        gate(F.col("conv_id") % 2 == 0).alias("gate_1"),
        gate(F.lit(False)).alias("gate_2"),
        gate(F.lit(True)).alias("gate_3"),
    )
    plain = F.replace(F.to_json(body), F.lit("why }"), F.lit("why"))  # braces in strings end an object that stands in prose
    reply = F.when(((F.col("conv_id") + F.col("turn")) % 6).isin(2, 3, 4), in_forms(plain)).otherwise(in_forms(F.to_json(body)))
    return P.verdicts(v.table("conversations").select(*KEY, reply.alias("reply")), KEY, "reply").withColumn("gates", F.array_join(F.col("gates").cast("array<string>"), ","))
