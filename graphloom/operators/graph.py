"""Property-graph operators over nodes, edges (src, dst, type, ...) and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import saved

#: Weights of the function scores, and the flags that call for a trace.
SCORE = {"ext": 3, "ext_user": 4, "write": 2, "token": 2, "open": 2}
TRACE_FLAGS = ("PROXY_UPGRADEABLE", "CROSS_CHAIN", "CALLBACK", "TEMPORAL", "HAS_SIGNATURES", "MIGRATION", "LOW_LEVEL_CALL")


def public(f: DataFrame) -> DataFrame:
    return f.filter(F.col("visibility").isin("external", "public"))


def unrestricted(f: DataFrame) -> DataFrame:
    return public(f).filter(F.size(F.coalesce("modifiers", F.array().cast("array<string>"))) == 0)


def real(f: DataFrame, contracts: DataFrame) -> DataFrame:
    """Functions that can change state, of contracts that are neither interfaces nor libraries."""
    other = contracts.filter("is_interface or is_library").select(F.col("name").alias("contract"))
    return f.filter(~F.col("mutability").isin("view", "pure")).join(F.broadcast(other), "contract", "left_anti")


def build_edges(rows: DataFrame) -> DataFrame:
    """At most one edge for each (src, dst): the last by ord wins, its attributes with it."""
    own = [c for c in rows.columns if c not in ("src", "dst", "ord")]
    return rows.groupBy("src", "dst").agg(F.max_by(F.struct(*own), "ord").alias("e")).select("src", "dst", "e.*")


def guarded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target exists."""
    return edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def implicit_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Endpoints that no node row declares."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def out_counts(edges: DataFrame, **weights: Column) -> DataFrame:
    """One sum for each named expression over the out-edges of a node."""
    return edges.groupBy("src").agg(*(F.sum(w).alias(n) for n, w in weights.items()))


def kind(name: str) -> Column:
    return F.col("type") == name


def function_score(f: DataFrame, contracts: DataFrame, edges: DataFrame, flags: DataFrame) -> DataFrame:
    """(id, score): weighted out-edges, 2 without modifiers, 1 for each flag; 0 for functions that are not real."""
    weight = F.when(kind("EXTERNAL_CALL"), F.when(F.col("data_source") == "user_input", SCORE["ext_user"]).otherwise(SCORE["ext"])).when(kind("WRITES"), SCORE["write"]).when(kind("TOKEN_FLOW"), SCORE["token"]).otherwise(0)
    out = out_counts(edges, w=weight)
    n = flags.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("n_flags"))
    rows = f.join(out, F.col("id") == F.col("src"), "left").join(n, "id", "left").join(real(f, contracts).select("id", F.lit(True).alias("real")), "id", "left")
    score = F.coalesce("w", F.lit(0)) + F.when(F.size("modifiers") == 0, SCORE["open"]).otherwise(0) + F.coalesce("n_flags", F.lit(0))
    return rows.select("id", F.when(F.col("real"), score).otherwise(0).cast("long").alias("score"))


def state_sets(f: DataFrame, edges: DataFrame, same_contract: bool = True) -> DataFrame:
    """One row a function that reads or writes: (id, grp, times, open, out, touches, writes), a table in the checkpoint folder.

    grp is the contract (one for all without same_contract), times: its rows in f, open: how many of them are public, out: it
    calls out or moves tokens."""
    flow = edges.filter(kind("READS") | kind("WRITES")).groupBy(F.col("src").alias("id")).agg(F.collect_set("dst").alias("touches"), F.collect_set(F.when(kind("WRITES"), F.col("dst"))).alias("writes"))
    ext = edges.filter(kind("EXTERNAL_CALL") | kind("TOKEN_FLOW")).select(F.col("src").alias("id")).distinct().withColumn("out", F.lit(True))
    rows = f.select("id", (F.col("contract") if same_contract else F.lit("")).alias("grp"), F.col("visibility").isin("external", "public").alias("public"))
    # by id alone, so that the groups lie as the join needs them
    own = rows.repartition("id").groupBy("id", "grp").agg(F.count("*").alias("times"), F.count_if("public").alias("open"))
    return saved(own.join(flow, "id").join(ext, "id", "left").withColumn("out", F.coalesce("out", F.lit(False))), "state")


def _numbered(sets: DataFrame, column: str, numbers: DataFrame) -> DataFrame:
    """(id, grp, times, open, nos, vars, bits, many): a column's variables with their numbers, ascending, and their bits modulo 64.

    With 64 variables or fewer in the group the bits say all, and `many` is empty; else it has the numbers."""
    rows = sets.select("id", "grp", "times", "open", F.explode(column).alias("var")).join(numbers, ["grp", "var"])
    own = rows.groupBy("id", "grp", "times", "open").agg(F.array_sort(F.collect_list("no")).alias("nos"), F.array_sort(F.collect_list("var")).alias("vars"), F.bit_or(F.expr("shiftleft(1L, no % 64)")).alias("bits"), F.max("n").alias("n"))
    return own.select("id", "grp", "times", "open", "nos", "vars", "bits", F.when(F.col("n") > 64, F.col("nos")).otherwise(F.array().cast("array<int>")).alias("many"))


def _writers_and_touchers(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Writers (a, grp, times, open, no, vars, bits, many, before, many_before), a row for each variable with the writer's variables
    before it; touchers (id, grp, times, open, nos, vars, bits, many) that are public."""
    from pyspark.sql import Window

    out = sets.filter("out")
    own = Window.partitionBy("grp")
    # only variables that a caller writes count
    known = out.select("grp", F.explode("writes").alias("var")).distinct()
    numbers = known.select("grp", "var", (F.row_number().over(own.orderBy("var")) - 1).alias("no"), F.count("*").over(own).alias("n"))
    writers = _numbered(out, "writes", numbers).select("*", F.posexplode("nos").alias("pos", "no"))
    before = F.expr("aggregate(slice(nos, 1, pos), 0L, (x, i) -> x | shiftleft(1L, i % 64))")
    writers = writers.select(F.col("id").alias("a"), "grp", "times", "open", "no", "vars", "bits", "many", before.alias("before"), F.expr("if(size(many) = 0, many, slice(many, 1, pos))").alias("many_before"))
    return writers, _numbered(sets.filter("open > 0"), "touches", numbers)


#: The variables before this one of a writer w have none in common with those of a toucher t.
_FIRST_SHARED = "w.grp = t.grp and w.no = t.no and ((w.before & t.bits) = 0L or (size(t.many) > 0 and not arrays_overlap(w.many_before, t.many)))"


def shared_state_pairs(f: DataFrame, edges: DataFrame, same_contract: bool = True) -> DataFrame:
    """(a, b, n_vars, vars): a calls out and writes the variables vars that public b reads or writes, b is not a. n_vars is how
    many there are, once for each row of a and each public row of b in f. Edges: one at most for each pair of nodes. Needs a
    checkpoint folder.

    Writers and touchers meet at each variable of a contract, and a pair stays where it shares its first: no pair is made
    twice, so that none is sorted or sent. What is stored and sent grows with the edges, not with the pairs."""
    writers, touchers = _writers_and_touchers(state_sets(f, edges, same_contract))
    touched = touchers.select(F.col("id").alias("b"), "grp", "open", "vars", "bits", "many", F.explode("nos").alias("no"))
    met = writers.alias("w").join(touched.alias("t"), F.expr(_FIRST_SHARED + " and w.a <> t.b"))
    shared = "if(size(t.many) = 0, cast(bit_count(w.bits & t.bits) as bigint), cast(size(array_intersect(w.many, t.many)) as bigint))"
    return met.select("w.a", "t.b", F.expr(f"{shared} * w.times * t.open").alias("n_vars"), F.expr("array_intersect(w.vars, t.vars)").alias("vars"))


def shared_state_counts(f: DataFrame, edges: DataFrame, same_contract: bool = True) -> DataFrame:
    """(a, n_pairs, n_vars): how many rows shared_state_pairs has for a, and the sum of their n_vars, counted without pairs.

    A variable adds those touchers that touch none of the writer's variables before it. Writers with the same variables up to
    there, and touchers with the same variables, are one row each. A public writer touches its own variables, and is taken off.
    Repeated rows of f count in n_vars as in the pairs."""
    writers, touchers = _writers_and_touchers(state_sets(f, edges, same_contract))
    alike = touchers.groupBy("grp", "nos", "bits", "many").agg(F.count("*").alias("n"), F.sum("open").alias("m"))
    touched = alike.select("grp", "bits", "many", "n", "m", F.explode("nos").alias("no"))
    step = ["grp", "no", "before", "many_before"]
    new = writers.select(*step).distinct().alias("w").join(touched.alias("t"), F.expr(_FIRST_SHARED)).groupBy(*(F.col(f"w.{c}").alias(c) for c in step)).agg(F.sum("n").alias("new"))
    every = touched.groupBy("grp", "no").agg(F.sum("m").alias("every"))
    found = writers.join(every, ["grp", "no"]).join(new, step, "left").groupBy("a", "times", "open").agg(F.sum(F.coalesce("new", F.lit(0))).alias("n"), F.sum("every").alias("m"), F.count("*").alias("k"))
    return found.select("a", F.expr("n - if(open > 0, 1, 0)").alias("n_pairs"), F.expr("times * (m - open * k)").alias("n_vars")).filter("n_pairs > 0")


def two_hop(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, via, b) of edges (src, dst) that meet in a target, a and b different."""
    x = first.select(F.col("src").alias("a"), F.col("dst").alias("via"))
    y = second.select(F.col("src").alias("b"), F.col("dst").alias("via"))
    return x.join(y, "via").filter("a <> b")


def others_beyond(first: DataFrame, second: DataFrame) -> DataFrame:
    """(a, via, n): how many pairs two_hop gives for a and via, counted without making them."""
    x = first.groupBy(F.col("src").alias("a"), F.col("dst").alias("via")).agg(F.count("*").alias("own"))
    y = second.groupBy(F.col("src").alias("a"), F.col("dst").alias("via")).agg(F.count("*").alias("n"))
    total = y.groupBy("via").agg(F.sum("n").alias("total"))
    found = x.join(total, "via").join(y, ["a", "via"], "left")
    return found.select("a", "via", (F.col("own") * (F.col("total") - F.coalesce("n", F.lit(0)))).alias("n")).filter("n > 0")


def co_write_gaps(writes: DataFrame, top: int = 10) -> DataFrame:
    """Pairs of variables that some functions write together and others alone: (a, b, both, only_one).

    Every function's variables are paired; counts of one variable come from its own group."""
    w = writes.select(F.col("src").alias("fn"), F.col("dst").alias("var")).distinct()
    n = w.groupBy("var").agg(F.count("*").alias("n"))
    both = w.alias("x").join(w.alias("y"), F.expr("x.fn = y.fn and x.var < y.var")).groupBy(F.col("x.var").alias("a"), F.col("y.var").alias("b")).agg(F.count("*").alias("both"))
    counted = both.join(n.select(F.col("var").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("var").alias("b"), F.col("n").alias("nb")), "b")
    gaps = counted.select("a", "b", "both", (F.col("na") + F.col("nb") - 2 * F.col("both")).alias("only_one")).filter("only_one >= 1")
    return gaps.orderBy(F.desc("only_one"), "a", "b").limit(top)


def mutation_matrix(edges: DataFrame, shown: int = 6) -> DataFrame:
    """(var, n_writers, n_readers, writers, readers) of written variables; lists in id order, at most `shown` long.

    Lists keep only their smallest ids, so a hub variable needs no more memory than another."""
    flow = edges.filter(kind("READS") | kind("WRITES"))
    counts = flow.groupBy("dst").agg(F.count_if(kind("WRITES")).alias("n_writers"), F.count_if(kind("READS")).alias("n_readers"))
    from pyspark.sql import Window

    first = flow.withColumn("rk", F.row_number().over(Window.partitionBy("dst", "type").orderBy("src"))).filter(F.col("rk") <= shown)
    lists = first.groupBy("dst").agg(*(F.array_join(F.array_sort(F.collect_list(F.when(kind(t), F.col("src")))), ", ").alias(n) for t, n in (("WRITES", "writers"), ("READS", "readers"))))
    return counts.filter("n_writers > 0").join(lists, "dst").withColumnRenamed("dst", "var")


def reach(edges: DataFrame, source: str, max_depth: int) -> DataFrame:
    """(id, depth) of the nodes that breadth-first search reaches from a source, by a frontier that grows each round."""
    spark = edges.sparkSession
    step = edges.select("src", "dst").distinct()
    seen = spark.createDataFrame([(source, 0)], "id string, depth int")
    front = seen
    for d in range(1, max_depth + 1):
        front = front.join(step, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def cap_unchecked_writers(writes: DataFrame, reads: DataFrame, caps: DataFrame) -> DataFrame:
    """(cap, fn): writers of other variables of the cap's contract that never touch the cap. caps: (cap, var)."""
    pairs = caps.join(writes.select(F.col("dst").alias("var"), F.col("src").alias("fn")), "var").select("cap", "fn").distinct()
    return pairs.join(reads.select(F.col("dst").alias("cap"), F.col("src").alias("fn")), ["cap", "fn"], "left_anti")


def asof_enclosing(marks: DataFrame, group: str, order: list[str], is_decl: Column, name: Column) -> DataFrame:
    """Adds `scope`: the last declaration at or before each row, in one ordered pass per group."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("scope", F.last(F.when(is_decl, name), ignorenulls=True).over(w))
