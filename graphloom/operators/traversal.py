"""Traversal from many sources at once: one frontier, keyed by source and node, serves all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, saved


def reach_all(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, id, depth, path) of all nodes that each root of (root) reaches, by unweighted distance; path is the smallest of
    the shortest ones, root and node included.

    A round extends only the pairs that the last one found, and is stored as a Parquet table; without a depth it goes on
    until nothing is new. The caller sets a checkpoint folder."""
    step = saved(edges.select("src", "dst").distinct(), "edges")
    seen = saved(roots.select("root").distinct().select("root", F.col("root").alias("id"), F.lit(0).alias("depth"), F.array("root").alias("path")), "paths")
    front, depth = seen, 0
    while (max_depth is None or depth < max_depth) and not front.isEmpty():
        depth += 1
        met = front.join(step, F.col("id") == F.col("src")).groupBy("root", F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = saved(met.join(seen.select("root", "id"), ["root", "id"], "left_anti").select("root", "id", F.lit(depth).alias("depth"), "path"), "paths")
        seen = seen.unionByName(front)
    dropped(step)
    return seen


def call_chains(calls: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """(root, id, depth, callees) of the functions with callees that each root reaches in max_depth calls, itself at 0."""
    callees = calls.select("src", "dst").distinct().groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("callees"))
    return reach_all(calls, roots, max_depth).join(callees, "id").select("root", "id", "depth", "callees")
