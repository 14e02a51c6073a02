"""Full-text queries: stems, the positional index, cover rank and the row that stands for a chunk after fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import is_stop, stem
from ..operators import fulltext as X, retrieval as R
from .registry import query
from .retrieval_queries import FTS_TEXT, LISTS, ranked_lists
from .views import Views


@query("stems", "chunks fts_words stems", "SELECT word, lexeme FROM stems")
def stems(v: Views) -> DataFrame:
    """All distinct words but stop words, with their stems."""
    words = v.chunks.select(F.explode(T.tokens("chunk_text")).alias("word")).filter(~is_stop(F.col("word"))).distinct()
    return v.spread(words).select("word", stem(F.col("word")).alias("lexeme"))


@query("positional_index", "chunks fts_words stems", "SELECT lexeme, chunk_id, list(pos ORDER BY pos)::VARCHAR AS positions FROM fts_words JOIN stems USING (word) GROUP BY ALL")
def positional_index(v: Views) -> DataFrame:
    return X.positional_index(v.chunks).select("lexeme", "chunk_id", F.col("positions").cast("string").alias("positions"))


@query("fts_cover_rank", "chunks fts_words stems fts", "SELECT chunk_id AS doc_id, score AS rank FROM fts")
def fts_cover_rank(v: Views) -> DataFrame:
    """Cover density of all chunks that have all lexemes."""
    return X.search(v.chunks, FTS_TEXT).select(F.col("chunk_id").alias("doc_id"), F.col("score").alias("rank"))


@query(
    "fts_filtered",
    "chunks fts_words stems fts",
    "SELECT chunk_id, score FROM fts JOIN chunks USING (chunk_id) WHERE category = 'protocol' AND subcategory = 'en' ORDER BY 2 DESC, 1 LIMIT 20",
)
def fts_filtered(v: Views) -> DataFrame:
    return R.fts_topk(v.chunks, FTS_TEXT, 20, R.prefilter(category="protocol", subcategory="en"))


@query(
    "rrf_representative",
    "chunks q fts_words stems fts",
    f"""WITH {LISTS}, own AS (SELECT chunk_id, list_no, CASE WHEN list_no < 3 THEN score ELSE 0 END AS vector_score, CASE WHEN list_no = 3 THEN score ELSE 0 END AS fts_score FROM lists)
    SELECT chunk_id, list_no, round(vector_score, 6) AS vector_score, round(fts_score, 6) AS fts_score FROM own QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY vector_score DESC, list_no) = 1""",
)
def rrf_representative(v: Views) -> DataFrame:
    """The row of each fused chunk: of the list with the largest vector score, the first of equal ones."""
    rows = R.representatives(ranked_lists(v))
    return rows.select("chunk_id", "list_no", F.round("vector_score", 6).alias("vector_score"), F.round("fts_score", 6).alias("fts_score"))
