"""Typed wiring over functions that call their half and some others, with one cycle, and over chains of orders as references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import traversal as T, wiring as W
from .registry import query
from .retrieval_queries import _checkpoints
from .views import CTE, NEEDS, Views

CTE["fn_calls"] = """fn_calls AS (SELECT DISTINCT a.id AS src, b.id AS dst FROM (SELECT id, ord // 2 AS k FROM functions WHERE ord >= 2 UNION ALL SELECT id, ord + 1 FROM functions WHERE ord % 10 = 0 UNION ALL SELECT id, 10 FROM functions WHERE ord = 1) a JOIN functions b ON b.ord = a.k)"""
CTE["refs"] = """refs AS (SELECT o_custkey AS fn, o_orderkey AS ref, 'p' || (o_orderkey % 11) AS name, CASE WHEN o_orderkey % 9 > 0 THEN lag(o_orderkey, 1, max_key) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) END AS points_to
    FROM orders JOIN (SELECT o_custkey, max(o_orderkey) AS max_key FROM orders GROUP BY 1) USING (o_custkey)),
    params AS (SELECT c_custkey AS fn, 'p' || (c_custkey % 23) AS name FROM customer)"""
_CLOSURE = """through(src, dst) AS (SELECT src, dst FROM data_flow WHERE type = 'WRITES' UNION SELECT c.src, t.dst FROM fn_calls c JOIN through t ON t.src = c.dst)"""
NEEDS |= {"fn_calls": ["functions"]}


def calls(v: Views) -> DataFrame:
    k = F.col("ord")
    to = F.array_compact(F.array(F.when(k >= 2, F.floor(k / 2)), F.when(k % 10 == 0, k + 1), F.when(k == 1, F.lit(10))))
    a = v.functions.select(F.col("id").alias("src"), F.explode(to).alias("k"))
    return a.join(v.functions.select(F.col("id").alias("dst"), F.col("ord").alias("k")), "k").select("src", "dst").distinct()


def writes(v: Views) -> DataFrame:
    return v.data_flow.filter("type = 'WRITES'").select("src", "dst")


@query("transitive_writes", "functions data_flow fn_calls", f"WITH {_CLOSURE} SELECT src, dst, (src, dst) IN (SELECT (src, dst) FROM data_flow WHERE type = 'WRITES') AS direct FROM through")
def transitive_writes(v: Views) -> DataFrame:
    """All variables that a function writes itself or through calls."""
    _checkpoints(v)
    return W.transitive_writes(writes(v), calls(v)).select("src", "dst", (F.col("depth") == 0).alias("direct"))


@query(
    "typed_edges",
    "functions data_flow fn_calls variables",
    f"""WITH {_CLOSURE}, nodes AS (SELECT id FROM functions WHERE ord % 13 <> 5 UNION ALL SELECT id FROM variables WHERE NOT is_constant),
    e AS (SELECT src, dst, 'WRITES' AS type, 0 AS ord FROM data_flow WHERE type = 'WRITES' UNION ALL SELECT src, dst, 'WRITES', 1 FROM through UNION ALL SELECT src, dst, 'READS', 2 FROM data_flow WHERE type = 'READS' UNION ALL SELECT src, dst, 'CALLS', 3 FROM fn_calls)
    SELECT src, dst, arg_min(type, ord) AS type FROM e WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes) GROUP BY 1, 2""",
)
def typed_edges(v: Views) -> DataFrame:
    """One edge for each pair of existing nodes; the first writer wins."""
    _checkpoints(v)
    nodes = v.functions.filter("ord % 13 <> 5").select("id").unionByName(v.variables.filter("not is_constant").select("id"))
    return W.typed_edges(writes(v), v.data_flow.filter("type = 'READS'").select("src", "dst"), calls(v), nodes)


@query(
    "points_to",
    "refs",
    """WITH walk(fn, ref, place, seen) AS (SELECT fn, ref, ref, [ref] FROM refs UNION ALL SELECT w.fn, w.ref, r.points_to, list_append(seen, r.points_to) FROM walk w JOIN refs r ON r.fn = w.fn AND r.ref = w.place WHERE r.points_to IS NOT NULL AND NOT list_contains(seen, r.points_to)),
    hit AS (SELECT w.fn, w.ref, bool_or(p.name IS NOT NULL) AS hit FROM walk w JOIN refs r ON r.fn = w.fn AND r.ref = w.place LEFT JOIN params p ON p.fn = r.fn AND p.name = r.name GROUP BY 1, 2)
    SELECT r.fn, r.ref, coalesce(t.name, r.name) AS label, CASE WHEN hit THEN 'user_input' ELSE 'state' END AS data_source FROM refs r JOIN hit USING (fn, ref) LEFT JOIN refs t ON t.fn = r.fn AND t.ref = r.points_to""",
)
def points_to(v: Views) -> DataFrame:
    """References that lead to a parameter of their function, over chains, some of which are cycles."""
    _checkpoints(v)
    o = v.table("orders").select(F.col("o_custkey").alias("fn"), F.col("o_orderkey").alias("ref"))
    own = Window.partitionBy("fn")
    before = F.coalesce(F.lag("ref").over(own.orderBy("ref")), F.max("ref").over(own))
    refs = o.select("fn", "ref", F.concat(F.lit("p"), F.col("ref") % 11).alias("name"), F.when(F.col("ref") % 9 > 0, before).alias("points_to"))
    params = v.table("customer").select(F.col("c_custkey").alias("fn"), F.concat(F.lit("p"), F.col("c_custkey") % 23).alias("name"))
    return W.points_to(refs, params)


def entries(v: Views) -> DataFrame:
    return v.functions.filter("visibility in ('external', 'public')").select(F.col("id").alias("root"))


@query(
    "call_chains",
    "functions fn_calls",
    """WITH walk(root, id, depth) AS (SELECT id, id, 0 FROM functions WHERE visibility IN ('external', 'public') UNION SELECT w.root, c.dst, w.depth + 1 FROM walk w JOIN fn_calls c ON c.src = w.id WHERE w.depth < 5),
    a AS (SELECT src AS id, string_agg(dst, ',' ORDER BY dst) AS callees FROM fn_calls GROUP BY 1)
    SELECT root, id, min(depth) AS depth, any_value(callees) AS callees FROM walk JOIN a USING (id) GROUP BY root, id""",
)
def call_chains(v: Views) -> DataFrame:
    """The call chain of every entry point: each function in five calls' reach with its callees."""
    _checkpoints(v)
    return T.call_chains(calls(v), entries(v)).withColumn("callees", F.array_join("callees", ","))


@query(
    "shortest_paths",
    "functions data_flow fn_calls",
    """WITH e AS (SELECT src, dst FROM fn_calls UNION SELECT src, dst FROM data_flow WHERE type = 'WRITES'),
    walk(root, id, depth, path) AS (SELECT id, id, 0, [id] FROM functions WHERE visibility IN ('external', 'public') UNION ALL SELECT root, e.dst, depth + 1, list_append(path, e.dst) FROM walk JOIN e ON e.src = id WHERE NOT list_contains(path, e.dst))
    SELECT root, id, min(depth) AS depth, array_to_string(min(path) FILTER (depth = least_depth), ' > ') AS path FROM (SELECT *, min(depth) OVER (PARTITION BY root, id) AS least_depth FROM walk) GROUP BY root, id HAVING NOT starts_with(id, 'fn:')""",
)
def shortest_paths(v: Views) -> DataFrame:
    """The shortest path of every entry point to every variable that it or its callees write, however long."""
    _checkpoints(v)
    edges = calls(v).unionByName(writes(v))
    return T.reach_all(edges, entries(v)).filter(~F.col("id").startswith("fn:")).withColumn("path", F.array_join("path", " > "))
