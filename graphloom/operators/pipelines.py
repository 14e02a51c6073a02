"""The stages after retrieval, and the pipelines that hunters call: boost, near-duplicate removal, rerank, budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ports import Reranker
from . import retrieval as R

#: What is fetched for a category of the context, and the characters from which the budget is halved.
FETCH_FACTOR, FETCH_LEAST, LONG_CONTEXT = 6, 40, 10_000


def fetch_k(top_k: int) -> int:
    return max(FETCH_FACTOR * top_k, FETCH_LEAST)


def adaptive_budget(budget: int, context_chars: int, source_chars: int) -> int:
    """Half of the budget where the context and the source are long already."""
    return budget // 2 if context_chars + source_chars > LONG_CONTEXT else budget


def boosted(chunks: DataFrame, top: DataFrame, query: str) -> DataFrame:
    """The chunks of a fused list (chunk_id, rrf_score, position), boosted and sorted anew: adds score and rk from 1.

    The list has the length that was asked for, so one window over it is fine."""
    rows = chunks.join(F.broadcast(top), "chunk_id").withColumn("score", F.col("rrf_score") * R.boost(query))
    return rows.withColumn("rk", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "position")))


def deduplicated(rows: DataFrame, threshold: float = R.NEAR) -> DataFrame:
    """Rows (chunk_id, chunk_text, rk, ...) without near copies of better ones."""
    rows = rows.checkpoint()
    kept = R.greedy_dedup(rows.select("chunk_id", "rk"), R.similar_pairs(rows, threshold)).filter("kept").select("chunk_id")
    return rows.join(kept, "chunk_id", "left_semi")


def reranked(rows: DataFrame, query: str, top_k: int, port: Reranker | None = None) -> DataFrame:
    """The first top_k rows by rk, with rerank_score: of the port, else the share of the query's words that they have.
    A port that fails leaves the score null. Only the top_k texts go to the driver."""
    top = rows.orderBy("rk").limit(top_k)
    if port is None:
        return top.withColumn("rerank_score", R.overlap_rerank(query))
    own = top.select("chunk_id", "chunk_text").collect()
    try:
        found = [(r.chunk_id, float(s)) for r, s in zip(own, port(query, [r.chunk_text for r in own]), strict=True)]
    except Exception:
        found = []
    scores = rows.sparkSession.createDataFrame(found, "chunk_id long, rerank_score double")
    return top.join(F.broadcast(scores), "chunk_id", "left")


def cut(rows: DataFrame, top_k: int) -> DataFrame:
    """The best top_k by rerank score if the first row has one, else by rk: adds `place` from 1."""
    flag = rows.agg((F.coalesce(F.min_by("rerank_score", "rk"), F.lit(0.0)) != 0).alias("by_rerank"))
    key = F.when(F.col("by_rerank"), -F.round(F.coalesce("rerank_score", F.lit(0.0)), 9)).otherwise(0.0)
    place = F.row_number().over(Window.orderBy(key, "rk"))
    return rows.join(F.broadcast(flag)).withColumn("place", place).filter(F.col("place") <= top_k).drop("by_rerank")


def retrieve(chunks: DataFrame, vector: list[float], words: str, query: str, top_k: int, category: str | None = None, fetch: int | None = None, port: Reranker | None = None, rerank: bool = True, boost: bool = True, threshold: float = R.NEAR) -> DataFrame:
    """Hybrid retrieval of one category by a vector and the words of a full-text query, boosted, deduplicated, reranked and cut. Needs a checkpoint folder."""
    own = chunks.filter(R.prefilter(category=category)) if category else chunks
    top = R.hybrid(own, vector, words, fetch or fetch_k(top_k))
    rows = boosted(own, top, query) if boost else own.join(F.broadcast(top), "chunk_id").withColumn("rk", F.col("position"))
    rows = deduplicated(rows, threshold)
    if rerank:
        return cut(reranked(rows, query, 2 * top_k, port), top_k)
    return cut(rows.withColumn("rerank_score", F.lit(None).cast("double")), top_k)


def context(sections: list[DataFrame], budget: int = R.BUDGET_CHARS) -> DataFrame:
    """(section, place, entry) of the sections' rows in turn. Each section ends before its first entry that would exceed
    what the sections before it have left of the budget. Sections have a few rows each."""
    out, used = None, 0
    for i, rows in enumerate(sections):
        entries = rows.select(F.lit(i).alias("section"), "place", R.format_entry(F.col("place"), F.coalesce("rerank_score", F.lit(0.0))).alias("entry"))
        running = F.sum(F.length("entry")).over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
        kept = entries.withColumn("running", running).filter(F.col("running") <= budget - used).checkpoint()
        used += kept.agg(F.coalesce(F.max("running"), F.lit(0))).first()[0]
        out = kept.drop("running") if out is None else out.unionByName(kept.drop("running"))
    return out
