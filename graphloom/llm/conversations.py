"""Operator 12: a prefix trie of conversations, rolled up by pointer jumping.

Turns become digests; the digest of a prefix is the exclusive or of the digests of its turns, each hashed with its
place, so that prefixes of a very long conversation are computed block by block. Equal prefixes meet in one
aggregation and become the nodes; a node's parent edge is the digest without its last turn. Leaf counts and savings
then climb by doubling: in round k every node adds what the nodes 2^k levels below it have gathered, and its pointer
jumps to its ancestor 2^(k+1) levels up. A trie of depth D takes about log2(D) rounds of joins and aggregations.

Defined results: rows without conv_id are left out; a null role or text counts as empty; turns of equal number, null
ones among them, are ordered by role, then by a hash of the text, and repeated rows are turns of their own; the
remainder of a negative conv_id has its sign, as in SQL; a conversation that loses all its turns stays a member of
the root; an empty table gives an empty result; extra columns are ignored. Texts of any length are hashed whole.
Nodes are told apart by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, parts, saved

BLANK = r"[\x20\x09-\x0D]+"
#: Conversations of a family, and the remainder that gives the shared turns.
FAMILY, HEADS = 20, 4
#: Turns of a block of a long conversation; ids in a chunk of a node's list of ends.
BLOCK, CHUNK = 4096, 512


def word_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, BLANK), "")).cast("long")


def shared_turns(conv_id: Column) -> Column:
    """First turns that a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string")) % HEADS


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, rank (from 1), a, b (digest of role and text), words of every turn.

    Ranges of (conv_id, turn, ...) are numbered apart and shifted by what stands before them, so that a conversation
    of any length is spread over tasks.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    order = ["turn", "role", "a", "b"]
    turns = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("a"),
        F.xxhash64(F.lit(1), text, role).alias("b"),
        word_count(text).alias("words"),
        F.monotonically_increasing_id().alias("copy"),  # parts repeated rows
    ).filter("conv_id is not null")
    spread = turns.repartitionByRange(parts(conversations.sparkSession), "conv_id", *order, "copy")
    spread = saved(spread.select("*", F.spark_partition_id().alias("part")), "turns")
    counts = spread.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    ranked = spread.withColumn("local", local).join(counts.select("conv_id", "part", before.alias("before")), ["conv_id", "part"])
    out = saved(ranked.select("conv_id", (F.col("before") + F.col("local")).alias("rank"), "a", "b", "words"), "ranks")
    dropped(spread)
    return out


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n_turns), and their rebuilt turns (conv_id, pos, a, b, words)."""
    heads = turns.filter((F.col("conv_id") % FAMILY == 0) & (F.col("rank") < HEADS))
    heads = heads.groupBy(F.col("conv_id").alias("first")).agg(F.array_sort(F.collect_list(F.struct("rank", "a", "b", "words"))).alias("heads"))
    convs = turns.groupBy("conv_id").agg(F.max("rank").alias("n")).select("*", shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    taken = F.when(F.col("h") > 0, F.slice(F.coalesce("heads", F.lit([]).cast(heads.schema["heads"].dataType)), 1, F.greatest("h", F.lit(1)).cast("int")))
    convs = convs.join(heads, "first", "left").select("conv_id", "n", "h", taken.alias("taken"))
    convs = convs.withColumn("got", F.coalesce(F.size("taken"), F.lit(0)))
    convs = saved(convs.select("*", (F.greatest(F.col("n") - F.col("h"), F.lit(0)) + F.col("got")).alias("n_turns")), "convs")
    shared = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.rank").alias("pos"), "t.a", "t.b", "t.words")
    # own turns keep their numbers but where the first of the family has too few or is not there
    lost = convs.filter("got < h").select("conv_id", (F.col("h") - F.col("got")).alias("lost"))
    own = turns.filter(F.col("rank") > shared_turns(F.col("conv_id"))).join(lost, "conv_id", "left")
    own = own.select("conv_id", (F.col("rank") - F.coalesce("lost", F.lit(0))).alias("pos"), "a", "b", "words")
    return convs, shared.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, pos, k1, k2 (digest of the first pos turns), p1, p2 (of one less), words of the last."""
    placed = turns.select("conv_id", "pos", ((F.col("pos") - 1) / BLOCK).cast("long").alias("block"), F.xxhash64("pos", "a", "b").alias("x"), F.xxhash64("pos", "b", "a").alias("y"), "words")
    sums = placed.groupBy("conv_id", "block").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "block", F.bit_xor("x").over(ahead).alias("x0"), F.bit_xor("y").over(ahead).alias("y0")).filter("block > 0")
    within = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = placed.select("*", F.bit_xor("x").over(within).alias("lx"), F.bit_xor("y").over(within).alias("ly"))
    out = local.join(before, ["conv_id", "block"], "left")
    key = lambda part, base: F.col(part).bitwiseXOR(F.coalesce(base, F.lit(0)))
    out = out.select("conv_id", "pos", key("lx", "x0").alias("k1"), key("ly", "y0").alias("k2"), "x", "y", "words")
    return out.select("conv_id", "pos", "k1", "k2", F.col("k1").bitwiseXOR(F.col("x")).alias("p1"), F.col("k2").bitwiseXOR(F.col("y")).alias("p2"), "words")


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows of one node, joined to texts of CHUNK ids at most."""
    for b in batches:
        k1, k2, ids = (c.to_numpy() for c in b.columns)
        new = np.r_[True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])] if len(ids) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        cuts = np.concatenate([np.arange(i, j, CHUNK) for i, j in zip(start, np.r_[start[1:], len(ids)], strict=True)]) if len(start) else start
        ends = np.r_[cuts[1:], len(ids)] if len(cuts) else cuts
        texts = [",".join(map(str, ids[i:j].tolist())) for i, j in zip(cuts, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(k1[cuts]), pa.array(k2[cuts]), pa.array(ids[cuts]), pa.array(texts, pa.string())], names=["k1", "k2", "first", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the chunks of each node in their order; holds one state, however many ids a node has."""
    node, state = None, hashlib.sha256()
    for b in batches:
        out: list[tuple] = []
        for k1, k2, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
            if (k1, k2) != node:
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (k1, k2), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield _ends(out)
    if node:
        yield _ends([(*node, state.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"k1": pa.int64(), "k2": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def ends(last: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of (k1, k2, conv_id): the ids of a node's last turns, ascending and joined by commas.

    The ids are joined to chunks in ranges over all tasks; a hash of one text is sequential by its nature, so the
    chunks of one node are read in order by one task, which holds one batch of them.
    """
    n = parts(last.sparkSession)
    spread = last.repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")
    chunks = spread.mapInArrow(_chunked, "k1 long, k2 long, first long, ids string")
    chunks = chunks.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first")
    return chunks.mapInArrow(_hashed, "k1 long, k2 long, ends_sha256 string")


def rolled_up(nodes: DataFrame, deepest: int) -> DataFrame:
    """k1, k2, n_leaves, saved of nodes (k1, k2, p1, p2, depth, leaf, saving), summed over each node's subtree.

    j is the ancestor 2^k levels up, unless that is the root, whose sums are those of the whole table.
    """
    up = F.col("depth") > 1
    state = saved(nodes.select("k1", "k2", "depth", F.when(up, F.col("p1")).alias("j1"), F.when(up, F.col("p2")).alias("j2"), F.col("leaf").alias("n_leaves"), F.col("saving").alias("saved")), "jump0")
    step = 1
    while step < deepest:
        gathered = state.filter(F.col("depth") > step).groupBy(F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        grown = state.join(gathered, ["k1", "k2"], "left")
        grown = grown.withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
        # only rows deeper than twice the step have an ancestor there
        jumps = state.filter(F.col("depth") > step).select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j1").alias("n1"), F.col("j2").alias("n2"))
        far = grown.filter(F.col("depth") > 2 * step).join(jumps, ["j1", "j2"]).select("k1", "k2", "depth", F.col("n1").alias("j1"), F.col("n2").alias("j2"), "n_leaves", "saved")
        near = grown.filter(F.col("depth") <= 2 * step).select("k1", "k2", "depth", F.lit(None).cast("long").alias("j1"), F.lit(None).cast("long").alias("j2"), "n_leaves", "saved")
        last, state = state, saved(far.unionByName(near), f"jump{2 * step}")
        dropped(last)
        step *= 2
    return state.select("k1", "k2", "n_leaves", "saved")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = ordered_turns(conversations)
    convs, rebuilt = rebuilt_turns(turns)
    seen = saved(prefixes(rebuilt), "prefixes")
    dropped(turns)

    nodes = seen.groupBy("k1", "k2").agg(F.min("conv_id").alias("conv_id"), F.max("pos").alias("depth"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    children = nodes.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("words"))
    nodes = saved(nodes, "nodes")

    last = seen.join(convs.select("conv_id", F.col("n_turns").alias("pos")), ["conv_id", "pos"]).select("k1", "k2", "conv_id")
    nothing = convs.filter("n_turns = 0").select(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id")
    hashes = saved(ends(last.unionByName(nothing)), "ends")
    dropped(seen)

    sums = nodes.agg(F.max("depth").alias("deepest"), F.coalesce(F.sum("leaf"), F.lit(0)).alias("n_leaves"), F.coalesce(F.sum("saving"), F.lit(0)).alias("saved"), F.count_if(F.col("depth") == 1).alias("n_children")).collect()[0]
    below = rolled_up(nodes, sums.deepest or 0)
    first = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    root = first.select(
        F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.lit(sums.n_children).cast("long").alias("n_children"), F.lit(max(1, sums.n_leaves)).cast("long").alias("n_leaves"), F.lit(sums.saved).cast("long").alias("saved"),
    )
    parents = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    top = first.select(F.col("conv_id").alias("parent_conv_id"))
    columns = ["k1", "k2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    deep = nodes.filter("depth > 1").join(parents, ["p1", "p2"]).select(columns)
    flat = nodes.filter("depth = 1").join(F.broadcast(top)).select(columns)  # one row: the root
    out = deep.unionByName(flat).join(below, ["k1", "k2"]).unionByName(root).join(hashes, ["k1", "k2"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def crc32_sql(octets: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a list of octets; `crc` is a one-row table with the list `t`."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, ({octets})::BIGINT[]), lambda c, x: xor(c >> 8, crc.t[(xor(c, x) & 255) + 1])), 4294967295::BIGINT)"


#: The table of crc32, by its rule.
CRC_SQL = "crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v FROM (SELECT unnest(range(256))::BIGINT AS i)))"


def oracle() -> str:
    """DuckDB SQL for `prefix_trie` over conversations whose turns have numbers of their own."""
    h = crc32_sql("list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x))")
    return f"""
WITH {CRC_SQL},
t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, '')) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, {h} % 4 AS h FROM (SELECT DISTINCT c FROM t), crc),
r AS (SELECT convs.c, 0 AS own, t.i, role, text FROM convs JOIN t ON t.c = convs.c - convs.c % 20 WHERE t.i <= h
  UNION ALL SELECT convs.c, 1, t.i, role, text FROM convs JOIN t ON t.c = convs.c WHERE t.i > h),
p AS (SELECT c, row_number() OVER w AS d, list({{'role': role, 'text': text}}) OVER w AS seq, text FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i)),
n AS (SELECT c, max(d) AS n_turns FROM p GROUP BY c),
m AS (SELECT c, d, min(c) OVER (PARTITION BY d, seq) AS node, text FROM p UNION ALL SELECT c, 0, (SELECT min(c) FROM convs), '' FROM convs),
nodes AS (SELECT d, node, count(*) AS n_convs, any_value(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'))) AS words,
  coalesce(string_agg(m.c::VARCHAR, ',' ORDER BY m.c) FILTER (coalesce(n_turns, 0) = d), '') AS at_end FROM m LEFT JOIN n ON m.c = n.c GROUP BY d, node),
edges AS (SELECT nodes.d, nodes.node, m.node AS parent FROM nodes LEFT JOIN m ON m.c = nodes.node AND m.d = nodes.d - 1),
kids AS (SELECT d - 1 AS d, parent AS node, count(*) AS k FROM edges WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT nodes.*, edges.parent, coalesce(k, 0) AS k FROM nodes JOIN edges USING (d, node) LEFT JOIN kids USING (d, node)),
sums AS (SELECT m.d, m.node, sum((x.k = 0)::INT) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved FROM full_nodes x JOIN m ON m.c = x.node AND m.d <= x.d GROUP BY 1, 2)
SELECT node AS conv_id, d AS depth, parent AS parent_conv_id, n_convs, k AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(at_end) AS ends_sha256
FROM full_nodes JOIN sums USING (d, node)"""
