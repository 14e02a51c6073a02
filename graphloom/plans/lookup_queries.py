"""Source lookups over the documents as files; nodes and places are derived from customers and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lookup as L
from .registry import query
from .views import CTE, NEEDS, Views

#: Function nodes: the contract is a word of a document, the file one of three kinds (there, not there, none).
CTE["files"] = "files AS (SELECT 'src/' || doc_id || '.sol' AS path, coalesce(text, '') AS content FROM documents)"
CTE["defs"] = """defs AS (SELECT 'fn:' || contract || '.' || name AS id, * FROM (
        SELECT 'f' || (k % 40) AS name, left(regexp_extract(text, '[A-Za-z]{4,}'), 9) AS contract, CASE k % 3 WHEN 0 THEN 'src/' || (k % 150) || '.sol' WHEN 1 THEN 'lib/' || k || '.sol' END AS file,
            CASE WHEN k % 5 <> 4 THEN 1 + k % 9 END AS line_start, CASE WHEN k % 4 <> 0 THEN 1 + k % 9 + k % 6 END AS line_end, k AS ord
        FROM (SELECT c_custkey AS k FROM customer) JOIN documents ON doc_id = k * 7 % 200) WHERE contract <> '' QUALIFY row_number() OVER (PARTITION BY contract, name ORDER BY ord) = 1)"""
CTE["calls"] = "calls AS (SELECT DISTINCT ON (a.id, b.id) a.id AS src, b.id AS dst, a.ord * 10 + s AS ord FROM defs a, (SELECT unnest([1, 2, 3, 5]) AS s) JOIN defs b ON b.ord = a.ord + s * (a.ord % 3) AND a.ord % 3 > 0 ORDER BY a.id, b.id, s)"
CTE["degrees"] = "degrees AS (SELECT src AS id, count(*) AS degree FROM calls GROUP BY 1)"
CTE["places"] = """places AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN contract || '.' || name WHEN 1 THEN contract || '.' || name || ':L' || (o_orderkey % 30) WHEN 2 THEN contract || '.' || name || ':L3-9, src.x:L' || (o_orderkey % 12) || '-20'
        WHEN 3 THEN contract WHEN 4 THEN 'Unknown0x.' || name || ':Lx' WHEN 5 THEN contract || ' . ' || name || ' :L4' ELSE left(contract, 3) || '.' || name || ':L' || (o_orderkey % 70) || ', ' || contract || '.' || name || ':L1, ' || left(contract, 4) || '.f:L2' END AS location
    FROM orders JOIN defs ON defs.ord = o_custkey)"""
CTE["first_file"] = "first_file AS (SELECT name, path FROM (SELECT DISTINCT name FROM (SELECT contract AS name FROM defs UNION ALL SELECT trim(split_part(location, '.', 1)) FROM places UNION ALL SELECT trim(split_part(split_part(trim(p), ':', 1), '.', 1)) FROM (SELECT unnest(string_split(location, ',')) AS p FROM places))) JOIN files ON contains(content, name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY path) = 1)"
CTE["own_file"] = "own_file AS (SELECT d.*, coalesce(e.path, f.path) AS path, coalesce(e.content, g.content) AS content FROM defs d LEFT JOIN files e ON e.path = d.file LEFT JOIN first_file f ON f.name = d.contract LEFT JOIN files g ON g.path = f.path)"
NEEDS |= {"own_file": ["files", "defs", "calls", "places", "first_file"]}


def files(v: Views) -> DataFrame:
    return v.table("documents").select(F.concat(F.lit("src/"), "doc_id", F.lit(".sol")).alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def defs(v: Views) -> DataFrame:
    k = F.col("c_custkey")
    docs = v.table("documents").select("doc_id", F.substring(F.regexp_extract("text", "[A-Za-z]{4,}", 0), 1, 9).alias("contract"))
    rows = v.table("customer").join(docs, F.col("doc_id") == k * 7 % 200).filter("contract <> ''").select(
        F.concat(F.lit("f"), k % 40).alias("name"),
        "contract",
        F.when(k % 3 == 0, F.concat(F.lit("src/"), k % 150, F.lit(".sol"))).when(k % 3 == 1, F.concat(F.lit("lib/"), k, F.lit(".sol"))).alias("file"),
        F.when(k % 5 != 4, (1 + k % 9).cast("int")).alias("line_start"),
        F.when(k % 4 != 0, (1 + k % 9 + k % 6).cast("int")).alias("line_end"),
        k.alias("ord"),
    )
    one = rows.groupBy("contract", "name").agg(F.min_by(F.struct("file", "line_start", "line_end", "ord"), "ord").alias("r"))
    return one.select(F.concat(F.lit("fn:"), "contract", F.lit("."), "name").alias("id"), "name", "contract", "r.*")


def calls(v: Views) -> DataFrame:
    a = defs(v).select(F.col("id").alias("src"), F.col("ord").alias("at"), F.explode(F.array(*map(F.lit, (1, 2, 3, 5)))).alias("s")).filter("at % 3 > 0")
    b = defs(v).select(F.col("id").alias("dst"), F.col("ord").alias("to"))
    return a.join(b, F.col("to") == F.col("at") + F.col("s") * (F.col("at") % 3)).groupBy("src", "dst").agg(F.min(F.col("at") * 10 + F.col("s")).alias("ord"))


def places(v: Views) -> DataFrame:
    k, c, n = F.col("o_orderkey"), F.col("contract"), F.col("name")
    dot = F.concat(c, F.lit("."), n)
    made = (
        F.when(k % 7 == 0, dot)
        .when(k % 7 == 1, F.concat(dot, F.lit(":L"), k % 30))
        .when(k % 7 == 2, F.concat(dot, F.lit(":L3-9, src.x:L"), k % 12, F.lit("-20")))
        .when(k % 7 == 3, c)
        .when(k % 7 == 4, F.concat(F.lit("Unknown0x."), n, F.lit(":Lx")))
        .when(k % 7 == 5, F.concat(c, F.lit(" . "), n, F.lit(" :L4")))
        .otherwise(F.concat(F.substring(c, 1, 3), F.lit("."), n, F.lit(":L"), k % 70, F.lit(", "), dot, F.lit(":L1, "), F.substring(c, 1, 4), F.lit(".f:L2")))
    )
    return v.table("orders").join(defs(v), F.col("o_custkey") == F.col("ord")).select(k.alias("id"), made.alias("location"))


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.length("source").alias("n_chars"), F.md5("source").alias("source_md5"))


@query("first_files", "files defs places first_file", "SELECT name, path FROM first_file WHERE name IN (SELECT contract FROM defs)")
def first_files(v: Views) -> DataFrame:
    """The first file that contains each contract's name, also inside longer words."""
    return L.first_files(files(v), defs(v).select(F.col("contract").alias("name")))


@query(
    "function_snippets",
    "own_file",
    """SELECT id, path AS file, line_start AS start, CASE WHEN line_end > 0 THEN line_end ELSE line_start + len(string_split(code, chr(10))) END AS "end", md5(code) AS code_md5
    FROM (SELECT *, array_to_string(string_split(content, chr(10))[line_start:least(len(string_split(content, chr(10))), coalesce(line_end, line_start + 60))], chr(10)) AS code FROM own_file WHERE line_start > 0 AND path IS NOT NULL)""",
)
def function_snippets(v: Views) -> DataFrame:
    """The lines of each function, of its own file or the first that contains its contract's name."""
    return L.snippets(defs(v), files(v)).select("id", "file", "start", "end", F.md5("code").alias("code_md5"))


_BLOCKS = """blocks AS (SELECT id, '// ' || path || ' — ' || contract || '.' || name || '() (L' || line_start || '-' || coalesce(line_end, 0) || ')' || chr(10) || code AS block, length(code) AS n
    FROM (SELECT *, array_to_string(string_split(content, chr(10))[greatest(0, line_start - 5) + 1:least(len(string_split(content, chr(10))), coalesce(line_end + 3, line_start + 60))], chr(10)) AS code FROM own_file WHERE line_start > 0 AND path IS NOT NULL))"""


@query(
    "finding_sources",
    "own_file degrees",
    f"""WITH {_BLOCKS},
    loc AS (SELECT id, 'fn:' || trim(split_part(split_part(location, ':', 1), '.', 1)) || '.' || trim(split_part(split_part(location, ':', 1), '.', 2)) AS fn, trim(split_part(location, '.', 1)) AS name FROM places),
    parts AS (SELECT id AS root, id, 0 AS place FROM defs UNION ALL SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY ord, dst) AS place FROM calls QUALIFY place <= 3),
    b AS (SELECT root, block, n, row_number() OVER (PARTITION BY root ORDER BY coalesce(degree, 0) DESC, place) AS r FROM parts LEFT JOIN degrees USING (id) JOIN blocks USING (id)),
    src AS (SELECT root, string_agg(block, chr(10) || chr(10) ORDER BY r) AS source FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY root ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b) WHERE used < 6000 GROUP BY root)
    SELECT x.id, length(s) AS n_chars, md5(s) AS source_md5 FROM (SELECT loc.id, CASE WHEN d.id IS NOT NULL THEN coalesce(source, '(source not found for specified functions)') ELSE coalesce(left(content, 3000), '(source not available)') END AS s
        FROM loc LEFT JOIN defs d ON d.id = fn LEFT JOIN src ON root = fn LEFT JOIN first_file f ON f.name = loc.name LEFT JOIN files ON files.path = f.path) x""",
)
def finding_sources(v: Views) -> DataFrame:
    """The source that a finding's location leads to: its function and callees, else the head of a file."""
    own = calls(v)
    degrees = own.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return digest(L.finding_sources(places(v), defs(v), own, degrees, files(v)))


@query(
    "proof_sources",
    "own_file",
    """WITH p AS (SELECT id, i, trim(string_split(location, ',')[i]) AS part FROM (SELECT id, location, unnest(range(1, len(string_split(location, ',')) + 1)) AS i FROM places)),
    w AS (SELECT p.id, i, TRY_CAST(split_part(string_split(part, ':L')[-1], '-', 1) AS INT) AS n, path, string_split(content, chr(10)) AS ls
        FROM p JOIN first_file ON name = trim(split_part(split_part(part, ':', 1), '.', 1)) AND name NOT LIKE '% %' JOIN files USING (path) WHERE contains(part, '.') AND contains(part, ':L') AND split_part(split_part(part, ':', 1), '.', 1) NOT LIKE '% %'),
    t AS (SELECT id, i, '// ' || path || ' (L' || (greatest(0, n - 5) + 1) || '-' || least(len(ls), n + 60) || ')' || chr(10) || array_to_string(ls[greatest(0, n - 5) + 1:least(len(ls), n + 60)], chr(10)) AS x FROM w WHERE n IS NOT NULL),
    u AS (SELECT *, coalesce(sum(length(x) + 2) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 2 AS used FROM t),
    s AS (SELECT places.id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY i), '(source not found for this location)') AS source FROM places LEFT JOIN u ON u.id = places.id AND used <= 8000 GROUP BY places.id)
    SELECT id, length(source) AS n_chars, md5(source) AS source_md5 FROM s""",
)
def proof_sources(v: Views) -> DataFrame:
    """The lines around every reported line of a location's comma list."""
    return digest(L.proof_sources(places(v), files(v)))


@query("named_nodes", "files defs", "SELECT file, h.name, d.id FROM (SELECT path AS file, 'f' || (length(content) % 60) AS name FROM files) h LEFT JOIN (SELECT name, arg_min(id, ord) AS id FROM defs GROUP BY name) d ON d.name = h.name")
def named_nodes(v: Views) -> DataFrame:
    hits = files(v).select(F.col("path").alias("file"), F.concat(F.lit("f"), F.length("content") % 60).alias("name"))
    return L.named_nodes(hits, defs(v)).select("file", "name", "id")


@query(
    "related_functions",
    "defs places",
    """WITH loc AS (SELECT id, split_part(location, '.', 1) AS c, split_part(split_part(location, '.', 2), ':', 1) AS f FROM places),
    r AS (SELECT loc.id, d.id AS fn, row_number() OVER (PARTITION BY loc.id ORDER BY (d.name = f) DESC, CASE WHEN d.name = f THEN -ord ELSE ord END) AS k FROM loc JOIN defs d ON d.contract = c)
    SELECT places.id, coalesce(string_agg(fn, ',' ORDER BY k) FILTER (k <= 12), '') AS fn_ids FROM places LEFT JOIN r ON r.id = places.id GROUP BY places.id""",
)
def related_functions(v: Views) -> DataFrame:
    """Up to twelve functions for each location: the named one, then others of its contract."""
    return L.related_functions(places(v), defs(v)).select("id", F.array_join("fn_ids", ",").alias("fn_ids"))
