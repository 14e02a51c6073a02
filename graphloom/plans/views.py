"""Views of the driver tables as the engine's data model, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

CATEGORIES = ("bug_pattern", "audit_methodology", "protocol", "web3_basics")
TAGS = (("reentrancy", "callback"), ("oracle", "price"), ("accounting", "balance"), ("governance", "owner"), ("gas", "loop"))
VISIBILITY = ("external", "public", "internal", "private")
MUTABILITY = ("nonpayable", "payable", "view", "pure", "nonpayable")
CHAIN_CATEGORIES = ("Reentrancy", "Oracle/Randomness", "Access Control", "External Call", "Accounting", "Governance", "Gas/DoS", "Proxy", "Cross-Chain")

FLAGS = ("ORACLE", "CROSS_CHAIN", "SEMI_TRUSTED_ROLE", "CALLBACK", "STAKING", "TEMPORAL", "GOVERNANCE", "MIGRATION", "LENDING", "HAS_SIGNATURES", "LOTTERY")
FUNCTION_NAMES = ("deposit", "withdrawAll", "setOraclePrice", "pauseMarket", "upgradeTo", "initialize", "permitSpend", "verifySig", "swapExact", "claimReward", "onERC721Received", "lzReceive", "multicall", "setTrustedForwarder", "overrideDuration", "computeFee", "getRate", "batchTransfer", "ecrecoverCheck", "settleRound", "setFeed", "owner", "name", "loopAll")
VARIABLE_NAMES = ("totalSupply", "oracleFeed", "maxCap", "rewardRate", "status", "lockupPeriod", "trustedForwarder", "overrideFees", "baseFees", "owner", "treasuryVault", "nonceSeed", "poolBalance")
VARIABLE_TYPES = ("mapping(address => uint256)", "uint256", "IPool", "enum Phase", "IERC20", "mapping(uint256 => address)", "ILocal[]")


def pick(n: Column, values: tuple) -> Column:
    """The value with the number n modulo their count."""
    lit = lambda v: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)
    return F.coalesce(*(F.when(n % len(values) == i, lit(v)) for i, v in enumerate(values)))


def sql_pick(n: str, values: tuple) -> str:
    lit = lambda v: "[" + ", ".join(f"'{x}'" for x in v) + "]" if isinstance(v, tuple) else f"'{v}'"
    return f"CASE {n} % {len(values)} " + " ".join(f"WHEN {i} THEN {lit(v)}" for i, v in enumerate(values)) + " END"


class Views:
    """The model over one folder of tables; every view is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """The rows on all cores, where a small input has fewer splits than there are cores."""
        n = self.spark.sparkContext.defaultParallelism
        return df.repartition(n) if df.rdd.getNumPartitions() < n else df

    @cached_property
    def chunks(self) -> DataFrame:
        d, e = self.table("documents"), self.table("embeddings")
        joined = d.join(e, d.doc_id == e.vec_id, "left")
        return joined.select(
            F.col("doc_id").alias("chunk_id"),
            F.col("text").alias("chunk_text"),
            T.n_words("text").alias("chunk_tokens"),
            pick(F.col("doc_id"), CATEGORIES).alias("category"),
            F.col("lang").alias("subcategory"),
            pick(F.col("doc_id"), TAGS).alias("tags"),
            (F.col("doc_id") % 3 == 0).alias("has_code"),
            F.col("embedding").alias("embedding_code"),
            F.reverse("embedding").alias("embedding_text"),
        )

    def query_vector(self, vec_id: int = 0) -> list[float]:
        return [float(x) for x in self.table("embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]]

    @cached_property
    def functions(self) -> DataFrame:
        c, n = self.table("customer"), F.broadcast(self.table("nation"))
        key = F.col("c_custkey")
        return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
            F.concat(F.lit("fn:"), "n_name", F.lit("."), key.cast("string")).alias("id"),
            F.concat(F.lit("f"), key.cast("string")).alias("name"),
            F.col("n_name").alias("contract"),
            pick(key, VISIBILITY).alias("visibility"),
            pick(key, MUTABILITY).alias("mutability"),
            pick(key, ((), ("onlyOwner",), ("nonReentrant",))).cast("array<string>").alias("modifiers"),
            key.alias("ord"),
            pick(key, FLAGS).alias("flag"),
        )

    @cached_property
    def contracts(self) -> DataFrame:
        n = self.table("nation")
        k = F.col("n_nationkey")
        return n.select(F.concat(F.lit("contract:"), "n_name").alias("id"), F.col("n_name").alias("name"), (k % 6 == 5).alias("is_interface"), (k % 6 == 4).alias("is_library"), F.col("n_regionkey").alias("region"), k.cast("long").alias("ord"))

    @cached_property
    def variables(self) -> DataFrame:
        brands = self.table("part").select("p_brand").distinct()
        number = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        named = brands.select("p_brand", number.alias("k")).join(F.broadcast(self.table("nation")), F.col("k") % 25 == F.col("n_nationkey"))
        return named.select(F.concat(F.lit("var:"), "p_brand").alias("id"), F.col("p_brand").alias("name"), F.col("n_name").alias("contract"), (F.col("k") % 5 == 0).alias("is_constant"), F.when(F.col("k") % 2 == 0, "mapping(address => uint256)").otherwise("uint256").alias("var_type"))

    @cached_property
    def named_functions(self) -> DataFrame:
        """Functions whose names say what they do."""
        return self.functions.withColumn("name", F.concat(pick(F.col("ord"), FUNCTION_NAMES), F.col("ord").cast("string")))

    @cached_property
    def named_variables(self) -> DataFrame:
        """Variables with names and types that say what they hold; one in five contracts."""
        k = F.regexp_extract("name", r"(\d+)", 1).cast("int")
        own = self.variables.withColumn("k", k)
        return own.select("id", F.concat(pick(F.col("k"), VARIABLE_NAMES), F.lit("_"), F.col("k").cast("string")).alias("name"), F.concat(F.lit("C"), (F.col("k") % 5).cast("string")).alias("contract"), (F.col("k") % 11 == 0).alias("is_constant"), pick(F.col("k"), VARIABLE_TYPES).alias("var_type"))

    @cached_property
    def data_flow(self) -> DataFrame:
        """(fn, var, type): WRITES beats READS."""
        li, o, p = self.table("lineitem"), self.table("orders"), self.table("part")
        write = (F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)
        lines = li.select("l_orderkey", "l_partkey", write.alias("w")).join(p.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        own = lines.join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        # by customer alone, so that the lines are sent once for the groups and for the join with their function
        flow = own.select("o_custkey", "p_brand", "w").repartition("o_custkey").groupBy("o_custkey", "p_brand").agg(F.bool_or("w").alias("w"))
        fn = self.functions.select("ord", F.col("id").alias("src"))
        return flow.join(fn, F.col("o_custkey") == F.col("ord")).select("src", F.concat(F.lit("var:"), "p_brand").alias("dst"), F.when(F.col("w"), "WRITES").otherwise("READS").alias("type"))

    @cached_property
    def edges(self) -> DataFrame:
        """All edges (src, dst, type, data_source), at most one for each pair of nodes."""
        fn = self.functions
        n = self.table("customer").count()
        by_key = fn.select(F.col("ord").alias("k"), F.col("id").alias("to"))
        none = F.lit(None).cast("string")
        calls = fn.select("id", ((F.col("ord") * 7 + 1) % n).alias("k")).join(by_key, "k").select(F.col("id").alias("src"), F.col("to").alias("dst"), F.lit("CALLS").alias("type"), none.alias("data_source"))
        member = fn.select(F.col("id").alias("src"), F.concat(F.lit("contract:"), "contract").alias("dst"), F.lit("BELONGS_TO").alias("type"), none.alias("data_source"))
        o = self.table("orders").join(fn.select("ord", "id"), F.col("o_custkey") == F.col("ord"))
        ext = o.filter("o_orderstatus = 'F'").groupBy(F.col("id").alias("src"), F.concat(F.lit("ext:"), (F.col("o_orderkey") % 100).cast("string")).alias("dst"))
        ext = ext.agg(F.lit("EXTERNAL_CALL").alias("type"), F.max(F.when(F.col("o_orderkey") % 2 == 0, "user_input").otherwise("state")).alias("data_source"))
        token = o.filter("o_orderstatus = 'P'").select(F.col("id").alias("src"), F.concat(F.lit("token:"), (F.col("o_orderkey") % 7).cast("string")).alias("dst"), F.lit("TOKEN_FLOW").alias("type"), none.alias("data_source")).distinct()
        return self.data_flow.withColumn("data_source", none).unionByName(calls).unionByName(member).unionByName(ext).unionByName(token)

    @cached_property
    def flags(self) -> DataFrame:
        """(node_id, flag): none, one or two flags of each function."""
        k = F.col("ord")
        own = F.array_compact(F.array(F.when(k % 4 != 3, F.col("flag")), F.when(k % 5 == 0, pick(k * 3 + 1, FLAGS))))
        return self.functions.select(F.col("id").alias("node_id"), F.explode(F.array_distinct(own)).alias("flag"))

    @cached_property
    def findings(self) -> DataFrame:
        o, c, n = self.table("orders"), self.table("customer"), F.broadcast(self.table("nation"))
        counts = self.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_nodes"), F.count_if(F.col("l_returnflag") == "R").alias("n_evidence"), F.count_if(F.col("l_linestatus") == "O").alias("n_pre"))
        joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
        severity = F.coalesce(*(F.when(F.col("o_orderpriority").startswith(k), F.lit(v)) for k, v in (("1", "Critical"), ("2", "High"), ("3", "Medium"), ("4", "Low"))), F.lit("Info"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        return joined.select(
            F.col("o_orderkey").alias("id"),
            severity.alias("severity"),
            pick(F.col("o_orderkey"), CHAIN_CATEGORIES).alias("category"),
            F.concat("n_name", F.lit("."), F.col("c_custkey").cast("string")).alias("location"),
            F.col("c_mktsegment").alias("hunter"),
            F.when(F.col("o_orderstatus") == "F", "Confirmed").when(F.col("o_orderstatus") == "O", "Contested").otherwise("Uncertain").alias("confidence"),
            zero("n_nodes"),
            zero("n_evidence"),
            zero("n_pre"),
            F.col("o_totalprice").alias("price"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """(doc_id, line_no from 1, line)."""
        return self.table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("long").alias("line_no"), "line")


CTE = {
    "chunks": f"""chunks AS (SELECT d.doc_id AS chunk_id, d.text AS chunk_text,
        CAST(len(list_filter(string_split_regex(d.text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS chunk_tokens,
        {sql_pick("d.doc_id", CATEGORIES)} AS category, d.lang AS subcategory, {sql_pick("d.doc_id", TAGS)} AS tags, d.doc_id % 3 = 0 AS has_code,
        CAST(e.embedding AS DOUBLE[]) AS embedding_code, list_reverse(CAST(e.embedding AS DOUBLE[])) AS embedding_text
        FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id)""",
    "q": "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)",
    "functions": f"""functions AS (SELECT 'fn:' || n_name || '.' || c_custkey AS id, 'f' || c_custkey AS name, n_name AS contract,
        {sql_pick("c_custkey", VISIBILITY)} AS visibility, {sql_pick("c_custkey", MUTABILITY)} AS mutability,
        CASE c_custkey % 3 WHEN 0 THEN CAST([] AS VARCHAR[]) WHEN 1 THEN ['onlyOwner'] ELSE ['nonReentrant'] END AS modifiers,
        c_custkey AS ord, {sql_pick("c_custkey", FLAGS)} AS flag FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "contracts": "contracts AS (SELECT 'contract:' || n_name AS id, n_name AS name, n_nationkey % 6 = 5 AS is_interface, n_nationkey % 6 = 4 AS is_library, n_regionkey AS region, CAST(n_nationkey AS BIGINT) AS ord FROM nation)",
    "variables": """variables AS (SELECT 'var:' || p_brand AS id, p_brand AS name, n_name AS contract, k % 5 = 0 AS is_constant,
        CASE WHEN k % 2 = 0 THEN 'mapping(address => uint256)' ELSE 'uint256' END AS var_type
        FROM (SELECT DISTINCT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) AS k FROM part) JOIN nation ON k % 25 = n_nationkey)""",
    "named_functions": f"named_functions AS (SELECT id, {sql_pick('ord', FUNCTION_NAMES)} || ord AS name, contract, visibility, mutability, modifiers, ord, flag FROM functions)",
    "named_variables": f"""named_variables AS (SELECT id, {sql_pick('k', VARIABLE_NAMES)} || '_' || k AS name, 'C' || (k % 5) AS contract, k % 11 = 0 AS is_constant, {sql_pick('k', VARIABLE_TYPES)} AS var_type
        FROM (SELECT id, CAST(regexp_extract(name, '(\\d+)', 1) AS INT) AS k FROM variables))""",
    "data_flow": """data_flow AS (SELECT f.id AS src, 'var:' || p_brand AS dst, CASE WHEN bool_or(l_returnflag = 'R' AND l_quantity >= 45) THEN 'WRITES' ELSE 'READS' END AS type
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN functions f ON f.ord = o_custkey GROUP BY 1, 2)""",
    "edges": """edges AS (SELECT src, dst, type, CAST(NULL AS VARCHAR) AS data_source FROM data_flow
        UNION ALL SELECT a.id, b.id, 'CALLS', NULL FROM functions a JOIN functions b ON b.ord = (a.ord * 7 + 1) % (SELECT count(*) FROM customer)
        UNION ALL SELECT id, 'contract:' || contract, 'BELONGS_TO', NULL FROM functions
        UNION ALL SELECT f.id, 'ext:' || (o_orderkey % 100), 'EXTERNAL_CALL', max(CASE WHEN o_orderkey % 2 = 0 THEN 'user_input' ELSE 'state' END) FROM orders JOIN functions f ON f.ord = o_custkey WHERE o_orderstatus = 'F' GROUP BY 1, 2
        UNION ALL SELECT DISTINCT f.id, 'token:' || (o_orderkey % 7), 'TOKEN_FLOW', CAST(NULL AS VARCHAR) FROM orders JOIN functions f ON f.ord = o_custkey WHERE o_orderstatus = 'P')""",
    "flags": f"flags AS (SELECT id AS node_id, flag FROM functions WHERE ord % 4 <> 3 UNION SELECT id, {sql_pick('(ord * 3 + 1)', FLAGS)} FROM functions WHERE ord % 5 = 0)",
    "findings": f"""findings AS (SELECT o_orderkey AS id,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' WHEN '3' THEN 'Medium' WHEN '4' THEN 'Low' ELSE 'Info' END AS severity,
        {sql_pick("o_orderkey", CHAIN_CATEGORIES)} AS category, n_name || '.' || c_custkey AS location, c_mktsegment AS hunter,
        CASE o_orderstatus WHEN 'F' THEN 'Confirmed' WHEN 'O' THEN 'Contested' ELSE 'Uncertain' END AS confidence,
        coalesce(n_nodes, 0) AS n_nodes, coalesce(n_evidence, 0) AS n_evidence, coalesce(n_pre, 0) AS n_pre, o_totalprice AS price
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN
        (SELECT l_orderkey, count(*) AS n_nodes, count(*) FILTER (l_returnflag = 'R') AS n_evidence, count(*) FILTER (l_linestatus = 'O') AS n_pre FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)""",
    "rank": "rank AS (SELECT * FROM (VALUES ('Critical', 0), ('High', 1), ('Medium', 2), ('Low', 3), ('Info', 4)) t(severity, rk))",
    "lines": "lines AS (SELECT doc_id, CAST(i AS BIGINT) AS line_no, l[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL))",
}
# the English stemmer step by step over distinct words, and cover density of the two lexemes `ha` and `ea` by windows
_STOP = "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each few more most other some such no nor not only own same so than too very s t can will just don should now"
_ONE = "[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _sql_ends(region: str, *pairs: tuple[str, str]) -> str:
    """WHEN branches that replace an ending of w where it stands in a region; the first ending that w has decides."""
    return " ".join(f"WHEN suffix(w, '{e}') THEN CASE WHEN length(w) - {len(e)} >= {region} THEN left(w, length(w) - {len(e)}) || '{to}' ELSE w END" for e, to in pairs)


_SQL_2 = _sql_ends("r1", ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"))
_SQL_3 = _sql_ends("r1", ("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic")) + " " + _sql_ends("r2", ("ative", "")) + " " + _sql_ends("r1", ("ical", "ic"), ("ness", ""), ("ful", ""))
_SQL_4 = _sql_ends("r2", *((e, "") for e in ("ement", "ance", "ence", "able", "ible", "ment"))) + " WHEN suffix(w, 'ion') THEN CASE WHEN length(w) - 3 >= r2 AND regexp_matches(w, '[st]ion$') THEN left(w, length(w) - 3) ELSE w END " + _sql_ends("r2", *((e, "") for e in ("ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")))
CTE["fts_words"] = f"""fts_words AS (SELECT chunk_id, pos, w[pos] AS word FROM (SELECT chunk_id, w, unnest(range(1, len(w) + 1)) AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(chunk_text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM chunks))
    WHERE w[pos] NOT IN ({", ".join(f"'{x}'" for x in _STOP.split())}))"""
CTE["stems"] = f"""
    stem_0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM (SELECT DISTINCT word FROM fts_words)),
    stem_r AS (SELECT *, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen|{_ONE})')), 0), length(w)) AS r1, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen|{_ONE}){_ONE}')), 0), length(w)) AS r2 FROM stem_0),
    stem_1a AS (SELECT word, r1, r2, CASE WHEN suffix(w, 'sses') THEN left(w, length(w) - 2)
        WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
        WHEN suffix(w, 'us') OR suffix(w, 'ss') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM stem_r),
    stem_cut AS (SELECT *, w IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') AS ended,
        CASE WHEN suffix(w, 'eedly') THEN 0 WHEN suffix(w, 'eed') THEN 0 WHEN suffix(w, 'ingly') THEN 5 WHEN suffix(w, 'edly') THEN 4 WHEN suffix(w, 'ing') THEN 3 WHEN suffix(w, 'ed') THEN 2 ELSE 0 END AS gone FROM stem_1a),
    stem_1b AS (SELECT word, r1, r2, ended, CASE WHEN ended THEN w
        WHEN gone = 0 THEN regexp_replace(w, CASE WHEN length(w) - CASE WHEN suffix(w, 'eedly') THEN 5 ELSE 3 END >= r1 THEN 'eed(ly)?$' ELSE '^$' END, 'ee')
        WHEN NOT regexp_matches(x, '[aeiouy]') THEN w WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(x, length(x) - 1)
        WHEN regexp_matches(x, '{_SHORT}') AND length(x) <= r1 THEN x || 'e' ELSE x END AS w FROM (SELECT *, left(w, length(w) - gone) AS x FROM stem_cut)),
    stem_1c AS (SELECT * REPLACE (CASE WHEN ended THEN w ELSE regexp_replace(w, '^(.+[^aeiouy])[yY]$', '\\1i') END AS w) FROM stem_1b),
    stem_2 AS (SELECT * REPLACE (CASE WHEN ended THEN w {_SQL_2} WHEN suffix(w, 'ogi') THEN CASE WHEN suffix(w, 'logi') AND length(w) - 3 >= r1 THEN left(w, length(w) - 1) ELSE w END
        WHEN suffix(w, 'li') AND length(w) - 2 >= r1 THEN regexp_replace(w, '([cdeghkmnrt])li$', '\\1') ELSE w END AS w) FROM stem_1c),
    stem_3 AS (SELECT * REPLACE (CASE WHEN ended THEN w {_SQL_3} ELSE w END AS w) FROM stem_2),
    stem_4 AS (SELECT * REPLACE (CASE WHEN ended THEN w {_SQL_4} ELSE w END AS w) FROM stem_3),
    stem_5 AS (SELECT * REPLACE (CASE WHEN ended THEN w WHEN suffix(w, 'e') AND (length(w) > r2 OR length(w) > r1 AND NOT regexp_matches(left(w, length(w) - 1), '{_SHORT}')) THEN left(w, length(w) - 1)
        WHEN suffix(w, 'll') AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END AS w) FROM stem_4),
    stems AS (SELECT word, CASE WHEN length(word) <= 2 OR word IN ('sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes') THEN word
        ELSE CASE word WHEN 'skis' THEN 'ski' WHEN 'skies' THEN 'sky' WHEN 'dying' THEN 'die' WHEN 'lying' THEN 'lie' WHEN 'tying' THEN 'tie' WHEN 'idly' THEN 'idl' WHEN 'gently' THEN 'gentl' WHEN 'ugly' THEN 'ugli' WHEN 'early' THEN 'earli' WHEN 'only' THEN 'onli' WHEN 'singly' THEN 'singl'
        ELSE replace(w, 'Y', 'y') END END AS lexeme FROM stem_5)"""
CTE["fts"] = """
    fts_hits AS (SELECT chunk_id, pos, lexeme FROM fts_words JOIN stems USING (word) WHERE lexeme IN ('ha', 'ea')),
    fts_last AS (SELECT chunk_id, pos, row_number() OVER w AS k, max(CASE WHEN lexeme = 'ha' THEN pos END) OVER w AS a, max(CASE WHEN lexeme = 'ea' THEN pos END) OVER w AS b FROM fts_hits WINDOW w AS (PARTITION BY chunk_id ORDER BY pos)),
    fts_covers AS (SELECT chunk_id, least(a, b) AS p, min(pos) AS q, min(k) AS kq FROM fts_last WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY chunk_id, least(a, b)),
    fts AS (SELECT c.chunk_id, round(sum(0.1::DOUBLE / (1 + (q - p) - (kq - k))), 9) AS score FROM fts_covers c JOIN fts_last l ON l.chunk_id = c.chunk_id AND l.pos = c.p GROUP BY c.chunk_id)"""
NEEDS = {"named_functions": ["functions"], "named_variables": ["variables"], "data_flow": ["functions"], "edges": ["functions", "data_flow"], "flags": ["functions"]}


def with_views(names: str, body: str) -> str:
    """SQL with the named views, and those that they need, in front. More common table expressions may follow in body after `WITH`."""
    order: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    head = "WITH RECURSIVE " + ",\n".join(CTE[n] for n in order)
    return f"{head},\n{body.strip()[5:]}" if body.strip().upper().startswith("WITH ") else f"{head}\n{body}"
