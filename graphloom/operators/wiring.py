"""Typed graph wiring: what functions write through others, which edge of a pair counts, and where references lead.

Both closures run in rounds on tables, each cut by a stored table or a checkpoint. The caller sets a checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import dropped, saved

#: Order of precedence of the edges of a pair of nodes.
ORDER = {"direct": 0, "transitive": 1, "reads": 2, "calls": 3}
USER_INPUT, STATE = "user_input", "state"


def transitive_writes(writes: DataFrame, calls: DataFrame) -> DataFrame:
    """(src, dst, depth): all variables that a function writes itself (depth 0) or through calls, with the fewest calls.

    writes: (src, dst); calls: (src, dst). Semi-naive: a round extends only the pairs that the last one found, so that
    cycles end and every pair is joined with the callers once. Rounds are as many as the longest shortest way. A round
    stores its own pairs alone, as a Parquet table, so that every pair is on disk once."""
    known = saved(writes.select("src", "dst").distinct().withColumn("depth", F.lit(0)), "writes")
    back = saved(calls.select(F.col("src").alias("caller"), F.col("dst").alias("src")).distinct(), "calls")
    found, depth = known, 0
    while not found.isEmpty():
        depth += 1
        more = back.join(found.select("src", "dst"), "src").select(F.col("caller").alias("src"), "dst").distinct()
        found = saved(more.join(known.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(depth)), "writes")
        known = known.unionByName(found)
    dropped(back)
    return known


def typed_edges(writes: DataFrame, reads: DataFrame, calls: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, type): at most one edge for a pair of nodes (id) that exist; the first of direct writes, transitive
    writes, reads and calls wins."""
    through = transitive_writes(writes, calls).filter("depth > 0")
    kinds = (("direct", "WRITES", writes), ("transitive", "WRITES", through), ("reads", "READS", reads), ("calls", "CALLS", calls))
    every = None
    for name, kind, rows in kinds:
        own = rows.select("src", "dst", F.lit(kind).alias("type"), F.lit(ORDER[name]).alias("ord"))
        every = own if every is None else every.unionByName(own)
    one = every.groupBy("src", "dst").agg(F.min_by("type", "ord").alias("type"))
    for end in ("src", "dst"):
        one = one.join(nodes.select(F.col("id").alias(end)), end, "left_semi")
    return one.select("src", "dst", "type")


def points_to(refs: DataFrame, params: DataFrame) -> DataFrame:
    """(fn, ref, label, data_source): the name that a reference shows (of what it points to, else its own), and whether it
    or anything it leads to is a parameter of its function.

    refs: (fn, ref, name, points_to); params: (fn, name). Pointers double each round: after round k a reference knows of
    the 2^k references ahead. A chain that is longer still changes something in every round, so a round without a change
    is the last, with cycles too."""
    own = refs.join(params.select("fn", "name", F.lit(True).alias("param")), ["fn", "name"], "left").select("fn", "ref", "name", "points_to", F.coalesce("param", F.lit(False)).alias("hit"))
    names = refs.select("fn", F.col("ref").alias("points_to"), F.col("name").alias("shown"))
    labels = refs.join(names, ["fn", "points_to"], "left").select("fn", "ref", F.coalesce("shown", "name").alias("label"))
    state = own.select("fn", "ref", F.col("points_to").alias("next"), "hit").checkpoint()
    while True:
        ahead = state.select("fn", F.col("ref").alias("next"), F.col("next").alias("far"), F.col("hit").alias("hit_ahead"))
        now = state.join(ahead, ["fn", "next"], "left").select("fn", "ref", F.col("far").alias("next"), (F.col("hit") | F.coalesce("hit_ahead", F.lit(False))).alias("hit"), (~F.col("hit") & F.coalesce("hit_ahead", F.lit(False))).alias("moved")).checkpoint()
        state = now.drop("moved")
        if now.filter("moved").isEmpty():
            break
    return labels.join(state.select("fn", "ref", "hit"), ["fn", "ref"]).select("fn", "ref", "label", F.when(F.col("hit"), USER_INPUT).otherwise(STATE).alias("data_source"))
