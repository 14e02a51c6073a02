"""Retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import budget, pipelines as P, retrieval as R
from .registry import query
from .views import Views, pick, sql_pick

FTS_TEXT = "the haing of the eaing"
TEXT = "reentrancy in the withdraw function of a vault with a price oracle"
TOP = 10
_FTS = "(SELECT chunk_id, score FROM fts ORDER BY 2 DESC, 1 LIMIT 40)"
_VEC = "(SELECT chunk_id, list_cosine_similarity({0}, v) AS score FROM chunks, q WHERE {0} IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 40)"
LISTS = f"""lists AS (
    SELECT chunk_id, 1 AS list_no, row_number() OVER (ORDER BY score DESC, chunk_id) AS rank, score FROM {_VEC.format("embedding_code")}
    UNION ALL SELECT chunk_id, 2, row_number() OVER (ORDER BY score DESC, chunk_id), score FROM {_VEC.format("embedding_text")}
    UNION ALL SELECT chunk_id, 3, row_number() OVER (ORDER BY score DESC, chunk_id), score FROM {_FTS})"""
_FUSED = f"""{LISTS}, fused AS (SELECT chunk_id, count(*) AS n_lists, sum(1.0 / (60 + rank)) AS rrf_score, min(list_no * 1000 + rank) AS first FROM lists GROUP BY 1),
    top AS (SELECT *, row_number() OVER (ORDER BY round(rrf_score, 12) DESC, first, chunk_id) AS position FROM fused QUALIFY position <= {TOP})"""
_BOOST = """(CASE WHEN has_code THEN 1.30 ELSE 1.0 END
    * CASE category WHEN 'bug_pattern' THEN 1.20 WHEN 'audit_methodology' THEN 1.10 WHEN 'web3_basics' THEN 0.80 ELSE 1.0 END
    * CASE WHEN len(list_intersect(tags, ['reentrancy', 'reentrant', 'nonreentrant', 'oracle', 'price', 'twap', 'chainlink', 'flash_loan'])) > 0 THEN 1.15 ELSE 1.0 END
    * CAST(CASE WHEN chunk_tokens < 50 THEN 0.85 ELSE 1.0 END AS DOUBLE))"""


@query("vector_topk", "chunks q", f"SELECT chunk_id, round(score, 6) AS score FROM {_VEC.format('embedding_code')}")
def vector_topk(v: Views) -> DataFrame:
    return R.vector_topk(v.chunks, "embedding_code", v.query_vector(), 40).select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "vector_topk_filtered",
    "chunks q",
    "SELECT chunk_id, round(list_cosine_similarity(embedding_code, v), 6) AS score FROM chunks, q WHERE embedding_code IS NOT NULL AND category = 'bug_pattern' AND has_code AND list_has_all(tags, ['oracle']) ORDER BY 2 DESC, 1 LIMIT 10",
)
def vector_topk_filtered(v: Views) -> DataFrame:
    where = R.prefilter(category="bug_pattern", has_code=True, tags=["oracle"])
    return R.vector_topk(v.chunks, "embedding_code", v.query_vector(), 10, where).select("chunk_id", F.round("score", 6).alias("score"))


@query("prefilter_all", "chunks", "SELECT chunk_id, category, subcategory FROM chunks WHERE category = 'protocol' AND subcategory = 'en' AND NOT has_code")
def prefilter_all(v: Views) -> DataFrame:
    return v.chunks.filter(R.prefilter(category="protocol", subcategory="en", has_code=False)).select("chunk_id", "category", "subcategory")


@query("tags_contain_all", "chunks", "SELECT chunk_id FROM chunks WHERE list_has_all(tags, ['oracle', 'price'])")
def tags_contain_all(v: Views) -> DataFrame:
    return v.chunks.filter(R.prefilter(tags=["oracle", "price"])).select("chunk_id")


@query("fts_match", "chunks fts_words stems fts", f"SELECT * FROM {_FTS}")
def fts_match(v: Views) -> DataFrame:
    return R.fts_topk(v.chunks, FTS_TEXT, 40)


def ranked_lists(v: Views) -> list[DataFrame]:
    """Two vector lists and a full-text list of 40 rows each."""
    q = v.query_vector()
    return [R.ranked(R.vector_topk(v.chunks, "embedding_code", q, 40), 1), R.ranked(R.vector_topk(v.chunks, "embedding_text", q, 40), 2), R.ranked(R.fts_topk(v.chunks, FTS_TEXT, 40), 3)]


@query("rrf_fuse", "chunks q fts_words stems fts", f"WITH {_FUSED} SELECT chunk_id, n_lists, round(rrf_score, 9) AS rrf_score FROM fused")
def rrf_fuse(v: Views) -> DataFrame:
    return R.rrf(ranked_lists(v)).select("chunk_id", "n_lists", F.round("rrf_score", 9).alias("rrf_score"))


@query("hybrid_retrieve", "chunks q fts_words stems fts", f"WITH {_FUSED} SELECT chunk_id, category, n_lists, round(rrf_score, 9) AS rrf_score, round(rrf_score * {_BOOST}, 9) AS boosted_score, position FROM top JOIN chunks USING (chunk_id)")
def hybrid_retrieve(v: Views) -> DataFrame:
    """Flagship: three ranked lists, fused and cut, then boosted."""
    top = R.hybrid(v.chunks, v.query_vector(), FTS_TEXT, TOP)
    rows = v.chunks.join(F.broadcast(top), "chunk_id")  # top has at most TOP rows
    return rows.select("chunk_id", "category", "n_lists", F.round("rrf_score", 9).alias("rrf_score"), F.round(F.col("rrf_score") * R.boost(TEXT), 9).alias("boosted_score"), "position")


@query("metadata_boost", "chunks", f"SELECT chunk_id, CAST(round({_BOOST}, 9) AS DOUBLE) AS boost FROM chunks")
def metadata_boost(v: Views) -> DataFrame:
    return v.chunks.select("chunk_id", F.round(R.boost(TEXT), 9).alias("boost"))


_QUERIES = ("a reentrant call", "price feed", "admin power", "gas in a loop", "nothing", "timelock Owner", "delegatecall use", "rounding of a share")


@query("inferred_tags", sql=f"""SELECT doc_id, {sql_pick('doc_id', ('reentrancy,reentrant,nonreentrant', 'oracle,price,twap,chainlink,flash_loan', 'access_control,onlyowner,admin,permission,governance,timelock,owner', 'gas,dos,loop,unbounded', '', 'governance,timelock,owner,admin', 'external_call,arbitrary_call,delegatecall', 'accounting,invariant,balance,share,rounding'))} AS tags FROM documents""")
def inferred_tags(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.array_join(T.inferred_tags(pick(F.col("doc_id"), _QUERIES)), ",").alias("tags"))


_SHINGLES = """s AS (SELECT doc_id, CASE WHEN len(w) < 3 THEN list_distinct(w) ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents))"""
_PAIRS = f"""{_SHINGLES}, e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    m AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    pairs AS (SELECT a, b, k / (na + nb - k) AS similarity FROM m WHERE k / (na + nb - k) >= 0.92)"""


@query("shingles", sql=f"WITH {_SHINGLES} SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles FROM s")
def shingles(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", F.size(T.shingles("text")).cast("long").alias("n_shingles"))


def _texts(v: Views) -> DataFrame:
    return v.spread(v.table("documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text")))


@query("jaccard_pairs", sql=f"WITH {_PAIRS} SELECT a, b, round(similarity, 9) AS similarity FROM pairs")
def jaccard_pairs(v: Views) -> DataFrame:
    _checkpoints(v)
    return R.similar_pairs(_texts(v), R.NEAR).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(
    "near_dedup_greedy",
    sql=f"""WITH RECURSIVE {_PAIRS}, o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rk FROM documents),
    step AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT o.rk, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.b = o.doc_id AND list_contains(step.kept, p.a)) THEN step.kept ELSE list_append(step.kept, o.doc_id) END
        FROM step JOIN o ON o.rk = step.rk + 1)
    SELECT doc_id AS chunk_id, list_contains((SELECT kept FROM step ORDER BY rk DESC LIMIT 1), doc_id) AS kept FROM documents""",
)
def near_dedup_greedy(v: Views) -> DataFrame:
    _checkpoints(v)
    return R.near_dedup(_texts(v), R.NEAR)


def _checkpoints(v: Views) -> None:
    """Where checkpoints go: what the session says. Only a single-JVM session may fall back to a temporary folder."""
    sc = v.spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        import tempfile

        folder = v.spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphloom-"))


@query(
    "rag_context_rows",
    "chunks q",
    f"""SELECT category, chunk_id, position FROM (SELECT category, chunk_id, row_number() OVER (PARTITION BY category ORDER BY round(list_cosine_similarity(embedding_code, v) * {_BOOST}, 9) DESC, chunk_id) AS position FROM chunks, q WHERE embedding_code IS NOT NULL AND category <> 'web3_basics')
    WHERE position <= CASE category WHEN 'bug_pattern' THEN 8 ELSE 4 END""",
)
def rag_context_rows(v: Views) -> DataFrame:
    """The context pipeline's three categories in one plan, boosted, each cut to its own size."""
    from ..functions.vector import cosine

    rows = v.chunks.filter(F.col("embedding_code").isNotNull() & (F.col("category") != "web3_basics"))
    score = F.round(cosine("embedding_code", v.query_vector()) * R.boost(TEXT), 9)
    place = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("score"), "chunk_id"))
    return rows.select("category", "chunk_id", score.alias("score")).withColumn("position", place.cast("long")).filter(F.col("position") <= F.when(F.col("category") == "bug_pattern", 8).otherwise(4)).drop("score")


@query(
    "context_format",
    "chunks",
    """SELECT chunk_id, '[' || chunk_id || '] ' || array_to_string(tags[1:4], ', ') || ' [' || coalesce(subcategory, category) || '] rerank=0.500' || chr(10) || trim(replace(substr(chunk_text, 1, 900), chr(10), ' '), ' ') AS entry FROM chunks""",
)
def context_format(v: Views) -> DataFrame:
    return v.chunks.select("chunk_id", R.format_entry(F.col("chunk_id"), F.lit(0.5)).alias("entry"))


@query(
    "budget_prefix",
    "chunks",
    "SELECT category, chunk_id, running FROM (SELECT category, chunk_id, CAST(sum(length(chunk_text)) OVER (PARTITION BY category ORDER BY chunk_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM chunks) WHERE running <= 12000",
)
def budget_prefix(v: Views) -> DataFrame:
    return budget.hard_prefix(v.chunks, ["category"], ["chunk_id"], F.length("chunk_text"), R.BUDGET_CHARS).select("category", "chunk_id", "running")


@query(
    "budget_soft",
    "chunks",
    "SELECT category, chunk_id, before FROM (SELECT category, chunk_id, CAST(coalesce(sum(length(chunk_text)) OVER (PARTITION BY category ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM chunks) WHERE before < 12000",
)
def budget_soft(v: Views) -> DataFrame:
    return budget.soft_prefix(v.chunks, ["category"], ["chunk_id"], F.length("chunk_text"), R.BUDGET_CHARS).select("category", "chunk_id", F.col("before").cast("long").alias("before"))


@query(
    "budget_skip",
    "contracts functions",
    """WITH i AS (SELECT contract, ord, length(id) * 100 AS n, row_number() OVER (PARTITION BY contract ORDER BY ord) AS rk FROM functions),
    step AS (SELECT name AS contract, CAST(0 AS BIGINT) AS rk, CAST(0 AS BIGINT) AS used, CAST(NULL AS BIGINT) AS ord, false AS took FROM contracts
        UNION ALL SELECT i.contract, i.rk, CASE WHEN used + i.n <= 12000 THEN used + i.n ELSE used END, i.ord, used + i.n <= 12000 FROM step JOIN i ON i.contract = step.contract AND i.rk = step.rk + 1)
    SELECT contract, ord FROM step WHERE took""",
)
def budget_skip(v: Views) -> DataFrame:
    items = v.functions.groupBy("contract").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").alias("id"), (F.length("id") * 100).cast("long").alias("n")))).alias("items"))
    return items.select("contract", F.explode(budget.skip_fold(F.col("items"), R.BUDGET_CHARS)).alias("ord"))


@query(
    "code_similar",
    "chunks q",
    "SELECT chunk_id, round(list_cosine_similarity(embedding_code, v), 6) AS score FROM chunks, q WHERE embedding_code IS NOT NULL AND has_code ORDER BY 2 DESC, 1 LIMIT 6",
)
def code_similar(v: Views) -> DataFrame:
    return R.vector_topk(v.chunks, "embedding_code", v.query_vector(), 6, R.prefilter(has_code=True)).select("chunk_id", F.round("score", 6).alias("score"))


@query(
    "rerank_port",
    "chunks",
    """WITH w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(chunk_text), '[\\p{L}\\p{N}_]+')) AS w, list_distinct(regexp_extract_all(lower('reentrancy in the withdraw function of a vault with a price oracle'), '[\\p{L}\\p{N}_]+')) AS q FROM chunks)
    SELECT chunk_id, round(len(list_intersect(q, w)) / len(q), 9) AS rerank_score FROM w ORDER BY 2 DESC, 1 LIMIT 40""",
)
def rerank_port(v: Views) -> DataFrame:
    return v.chunks.select("chunk_id", F.round(R.overlap_rerank(TEXT), 9).alias("rerank_score")).orderBy(F.desc("rerank_score"), "chunk_id").limit(40)


_RESORTED = f"""{_FUSED}, b AS (SELECT top.chunk_id, chunk_text, position, row_number() OVER (ORDER BY round(rrf_score * {_BOOST}, 9) DESC, position) AS rk FROM top JOIN chunks USING (chunk_id))"""


@query("boosted_order", "chunks q fts_words stems fts", f"WITH {_RESORTED} SELECT chunk_id, position, rk FROM b")
def boosted_order(v: Views) -> DataFrame:
    """The fused list after the boosts, sorted anew."""
    return P.boosted(v.chunks, R.hybrid(v.chunks, v.query_vector(), FTS_TEXT, TOP), TEXT).select("chunk_id", "position", "rk")


@query(
    "pattern_retrieval",
    "chunks q fts_words stems fts",
    f"""WITH {_RESORTED}, w AS (SELECT chunk_id, rk, regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+') AS w, list_distinct(regexp_extract_all(lower('{TEXT}'), '[\\p{{L}}\\p{{N}}_]+')) AS q FROM b),
    sh AS (SELECT chunk_id, rk, list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s, len(list_intersect(q, w)) / len(q) AS score FROM w),
    pr AS (SELECT x.rk AS a, y.rk AS b FROM sh x JOIN sh y ON x.rk < y.rk AND len(list_intersect(x.s, y.s)) >= 0.92 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))),
    step AS (SELECT CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT step.rk + 1, CASE WHEN EXISTS (SELECT 1 FROM pr WHERE pr.b = step.rk + 1 AND list_contains(step.kept, pr.a)) THEN step.kept ELSE list_append(step.kept, step.rk + 1) END FROM step WHERE step.rk < {TOP})
    SELECT chunk_id, round(score, 9) AS rerank_score, row_number() OVER (ORDER BY CASE WHEN (SELECT score FROM sh WHERE rk = 1) <> 0 THEN round(score, 9) ELSE 0 END DESC, rk) AS place FROM sh WHERE list_contains((SELECT kept FROM step WHERE rk = {TOP}), rk) QUALIFY place <= 6""",
)
def pattern_retrieval(v: Views) -> DataFrame:
    """Hybrid list, boosts, near-duplicate removal, rerank, cut. Each of the ten has three words at least. Without a rerank
    score of the first, the order before holds."""
    _checkpoints(v)
    return P.retrieve(v.chunks, v.query_vector(), FTS_TEXT, TEXT, 6, fetch=TOP).select("chunk_id", F.round("rerank_score", 9).alias("rerank_score"), "place")


@query("rag_context")
def rag_context(v: Views) -> DataFrame:
    """The whole context: patterns, methodology and protocol chunks in one budget."""
    _checkpoints(v)
    wanted = (("bug_pattern", 8, True), ("audit_methodology", 4, False), ("protocol", 4, False))
    q = v.query_vector()
    return P.context([P.retrieve(v.chunks, q, FTS_TEXT, TEXT, k, category=c, rerank=rerank) for c, k, rerank in wanted])


@query("adaptive_budget", "chunks", "SELECT chunk_id, CASE WHEN length(chunk_text) + 5000 > 10000 THEN 6000 ELSE 12000 END AS budget FROM chunks WHERE chunk_text IS NOT NULL")
def adaptive_budget(v: Views) -> DataFrame:
    half, whole = (P.adaptive_budget(R.BUDGET_CHARS, n, 0) for n in (P.LONG_CONTEXT + 1, 0))
    return v.chunks.filter("chunk_text is not null").select("chunk_id", F.when(F.length("chunk_text") + 5000 > P.LONG_CONTEXT, half).otherwise(whole).alias("budget"))
