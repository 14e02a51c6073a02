"""Hand-computed cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as T
from graphloom.functions.ranks import parse_severity, severity_rank
from graphloom.operators import budget, findings, graph, retrieval
from graphloom.sources import contracts, ingest, markup
from graphloom.streaming import usage


@pytest.fixture(autouse=True)
def checkpoints(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "amount"), [("$4.5M", 4.5e6), ("500K USDC", 5e5), ("$40M+", 4e7), ("1,234", 1234.0), ("", 0.0), (".", 0.0), ("1.2.3", 0.0)])
def test_amounts(spark, text, amount):
    assert one(spark, T.parse_amount(F.lit(text))) == amount


@pytest.mark.parametrize(("size", "starts"), [(0, [0]), (1, [0]), (2000, [0]), (2001, [0, 1800]), (3800, [0, 1800]), (3801, [0, 1800, 3600])])
def test_chunk_starts(spark, size, starts):
    assert one(spark, T.chunk_starts(F.lit("x" * size))) == starts


def test_shingles_and_jaccard(spark):
    assert one(spark, T.shingles(F.lit("A b c d"))) == ["a b c", "b c d"]
    assert one(spark, T.shingles(F.lit("a a"))) == ["a"]
    assert one(spark, T.shingles(F.lit(""))) == []
    assert one(spark, T.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)


def test_severity(spark):
    assert one(spark, parse_severity(F.lit(" hIGH "))) == "High"
    assert one(spark, parse_severity(F.lit("?"))) == "Medium"
    assert one(spark, severity_rank(F.lit("Critical"))) == 0


def test_leading_characters_are_a_set(spark):
    assert one(spark, T.strip_leading(F.lit("../x"), "./")) == "x"
    assert one(spark, T.strip_leading(F.lit(".hidden"), "./")) == "hidden"


def test_rrf_sums_over_lists_whatever_their_order(spark):
    a = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "chunk_id int, list_no int, rank int")
    b = spark.createDataFrame([(2, 2, 1)], "chunk_id int, list_no int, rank int")
    for lists in ([a, b], [b, a]):
        got = {r.chunk_id: (r.n_lists, r.rrf_score) for r in retrieval.rrf(lists).collect()}
        assert got == {1: (1, pytest.approx(1 / 61)), 2: (2, pytest.approx(1 / 62 + 1 / 61))}


def test_greedy_dedup_keeps_the_end_of_a_chain(spark):
    ids = spark.createDataFrame([(i, i) for i in (1, 2, 3)], "chunk_id int, rk int")
    pairs = spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")
    assert {r.chunk_id: r.kept for r in retrieval.greedy_dedup(ids, pairs).collect()} == {1: True, 2: False, 3: True}


def near_texts(spark):
    """Copies, near copies that share common words, chains of near copies, and texts without words."""
    rng = random.Random(9)
    texts = []
    for _ in range(6):
        words = [f"w{rng.randrange(300)}" for _ in range(90)] + ["the", "same", "end", "of", "all"] * 3
        texts += [words] * 4
        for _ in range(5):
            words = [*words]
            words[rng.randrange(90)] = "new"
            texts += [words]
    rng.shuffle(texts)
    texts = [" ".join(x) for x in texts] + ["a b", "A b", "", "-"]
    sets = [set(zip(w, w[1:], w[2:], strict=False)) if len(w) >= 3 else set(w) for w in (x.lower().replace("-", "").split() for x in texts)]
    likeness = {(i, j): len(x & y) / len(x | y) for i, x in enumerate(sets) for j, y in enumerate(sets) if i < j and x and y}
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string"), {k: v for k, v in likeness.items() if v >= 0.92}


def test_similar_pairs_with_copies(spark):
    chunks, want = near_texts(spark)
    rows = retrieval.similar_pairs(chunks, 0.92).collect()
    assert {(r.a, r.b): r.similarity for r in rows} == pytest.approx(want)
    assert len(rows) == len(want)
    members, pairs = retrieval.similar_classes(chunks, 0.92)
    n = members.select("rep").distinct().count()
    assert n < members.count()
    assert pairs.count() < len(want) / 2  # copies make no pairs of their own


def test_near_dedup_with_copies(spark):
    chunks, pairs = near_texts(spark)
    kept = []
    for i in range(chunks.count()):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert {r.chunk_id for r in retrieval.near_dedup(chunks, 0.92).filter("kept").collect()} == set(kept)
    assert retrieval.near_dedup(chunks, 0.92).count() == chunks.count()


def test_budgets(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([40, 70, 20], 1)], "g string, i int, n int")
    assert [r.i for r in budget.hard_prefix(rows, ["g"], ["i"], F.col("n"), 100).collect()] == [1]
    assert [r.i for r in budget.soft_prefix(rows, ["g"], ["i"], F.col("n"), 100).orderBy("i").collect()] == [1, 2]
    items = F.array(*(F.struct(F.lit(i).cast("long").alias("id"), F.lit(n).cast("long").alias("n")) for i, n in enumerate([40, 70, 20], 1)))
    assert one(spark, budget.skip_fold(items, 100)) == [1, 3]


def test_last_edge_of_a_pair_wins(spark):
    rows = spark.createDataFrame([("a", "b", "READS", 0), ("a", "b", "WRITES", 1)], "src string, dst string, type string, ord int")
    assert [r.type for r in graph.build_edges(rows).collect()] == ["WRITES"]


def test_reach_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "b"), ("b", "c")], "src string, dst string")
    assert {r.id: r.depth for r in graph.reach(edges, "a", 8).collect()} == {"a": 0, "b": 1, "c": 2}


def shared_state(spark, n_vars):
    """Functions and edges of two contracts, and the pairs by brute force: {(a, b): n_vars}."""
    rng = random.Random(n_vars)
    f = [(f"f{i}", f"C{i % 2}", ("public", "external", "private")[rng.randrange(3)]) for i in range(60)]
    edges = {(x[0], f"v{rng.randrange(n_vars)}"): rng.choice(["READS", "WRITES"]) for x in f for _ in range(n_vars // 5)} | {(x[0], "ext:0"): "EXTERNAL_CALL" for x in f[::3]} | {("f1", "token:0"): "TOKEN_FLOW", ("f5", "f1"): "CALLS"}
    calls = {s for (s, _), t in edges.items() if t in ("EXTERNAL_CALL", "TOKEN_FLOW")}
    w, touch = ({x[0]: {d for (s, d), t in edges.items() if s == x[0] and t in kinds} for x in f} for kinds in (("WRITES",), ("READS", "WRITES")))
    want = {(a[0], b[0]): len(w[a[0]] & touch[b[0]]) for a in f for b in f if a != b and a[0] in calls and a[1] == b[1] and b[2] != "private" and w[a[0]] & touch[b[0]]}
    return spark.createDataFrame(f, "id string, contract string, visibility string"), spark.createDataFrame([(s, d, t) for (s, d), t in edges.items()], "src string, dst string, type string"), want


@pytest.mark.parametrize("n_vars", [10, 64, 150])
def test_shared_state_counts(spark, n_vars):
    f, edges, want = shared_state(spark, n_vars)
    rows = graph.shared_state_counts(f, edges)
    assert {r.a: (r.n_pairs, r.n_vars) for r in rows.collect()} == {x: (sum(a == x for a, _ in want), sum(n for (a, _), n in want.items() if a == x)) for x, _ in want}


@pytest.mark.parametrize("n_vars", [10, 64, 150])
def test_shared_state_pairs_are_not_shuffled(spark, n_vars):
    f, edges, want = shared_state(spark, n_vars)
    rows = graph.shared_state_pairs(f, edges)
    found = rows.collect()
    assert {(r.a, r.b): r.n_vars for r in found} == want
    assert len(found) == len(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan.split("Aggregate")[0]  # nothing groups what the join of both sides gives


@pytest.mark.parametrize("n_vars", [10, 64, 150])
def test_shared_state_of_repeated_functions(spark, n_vars):
    f, edges, want = shared_state(spark, n_vars)
    rows = f.collect()
    # f0 has two rows more, f3 one more that is private
    times = {r.id: 1 for r in rows} | {"f0": 3, "f3": 2}
    open_rows = {r.id: int(r.visibility != "private") * (3 if r.id == "f0" else 1) for r in rows}
    again = f.union(f.filter("id = 'f0'")).union(f.filter("id = 'f0'")).union(f.filter("id = 'f3'").withColumn("visibility", F.lit("private")))
    want = {(a, b): n * times[a] * open_rows[b] for (a, b), n in want.items()}
    found = graph.shared_state_pairs(again, edges).collect()
    assert {(r.a, r.b): r.n_vars for r in found} == want
    assert len(found) == len(want)
    counts = graph.shared_state_counts(again, edges).collect()
    assert {r.a: (r.n_pairs, r.n_vars) for r in counts} == {x: (sum(a == x for a, _ in want), sum(n for (a, _), n in want.items() if a == x)) for x, _ in want}
    assert len(counts) == len({a for a, _ in want})


@pytest.mark.parametrize("n_vars", [10, 64, 150])
def test_shared_state_pairs_name_their_variables(spark, n_vars):
    f, edges, want = shared_state(spark, n_vars)
    kinds = {(e.src, e.dst): e.type for e in edges.collect()}
    found = {(r.a, r.b): r.vars for r in graph.shared_state_pairs(f, edges).collect()}
    assert found == {(a, b): sorted(d for (s, d), t in kinds.items() if s == a and t == "WRITES" and kinds.get((b, d)) in ("READS", "WRITES")) for a, b in want}


@pytest.mark.parametrize("table", ["customer", "nation"])
def test_shared_state_pairs_of_repeated_rows_as_in_sql(spark, tmp_path, table):
    import shutil

    from graphloom.plans.catalogue import ORACLE_SQL, QUERIES

    from . import oracle

    for t in oracle.TABLES:
        shutil.copy(f"/root/testdata/sf0.001/{t}.parquet", tmp_path)
    con = oracle.connect("/root/testdata/sf0.001")
    key = {"customer": "c_custkey", "nation": "n_nationkey"}[table]
    con.execute(f"COPY (SELECT * FROM {table} UNION ALL SELECT * FROM {table} WHERE {key} % 3 = 0) TO '{tmp_path}/{table}.parquet'")
    oracle.compare(spark, oracle.connect(str(tmp_path)), "shared_state_pairs", QUERIES["shared_state_pairs"], ORACLE_SQL["shared_state_pairs"], str(tmp_path))


def test_novel_keeps_doubles_of_a_batch(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "y"), (3, "y")], "id int, k string")
    assert sorted(r.id for r in findings.novel(rows, rows.filter("id = 1"), ["k"]).collect()) == [2, 3]
    assert sorted(r.id for r in findings.first_wins(rows, ["k"], ["id"]).collect()) == [1, 2]


def test_verdicts(spark):
    v = lambda said, score: one(spark, findings.judge_verdict(F.lit(said), F.lit(score)))
    assert [v("CONFIRMED", 80), v("CONFIRMED", 79), v("CONFIRMED", 49), v("REFUTED", 99)] == ["Confirmed", "Contested", "Refuted", "Refuted"]


def test_parser():
    text = """contract A is B {
    uint256 total;
    mapping(address => uint256) public held;
    function pay(address to) external onlyOwner { held[to] += 1; to.call{value: 1}(""); emit Paid(to); }
    function read(uint256 held) public view returns (uint256) { return total == 1 ? held : 0; }
    function bare() internal;
}"""
    rows = contracts.parse("a.sol", text)
    facts = {(r[1], r[3], r[4]) for r in rows}
    assert {("writes", "pay", "held"), ("emits", "pay", "Paid"), ("reads", "read", "total"), ("inherits", "A", "B"), ("external_call", "pay", "to")} <= facts
    assert not any(k == "reads" and f == "read" and t == "held" for k, f, t in facts)  # the parameter hides it
    call = next(r for r in rows if r[1] == "external_call")
    assert call[5] == "user_input"
    assert next(r[9] for r in rows if r[1] == "function" and r[3] == "read") == 5
    assert contracts.parse("b.sol", "contract C { function f() public { x") != []


def test_insert_if_absent_twice(spark):
    batch = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k int, v string")
    new = ingest.insert_if_absent(batch.limit(0), batch, ["k"])
    assert new.count() == 2
    assert ingest.insert_if_absent(new, batch, ["k"]).isEmpty()


def test_graph_roundtrip(spark, tmp_path):
    n = spark.createDataFrame([("a",)], "id string")
    ingest.write_graph(n, n, n, str(tmp_path / "g"))
    assert [x.first()["id"] for x in ingest.read_graph(spark, str(tmp_path / "g"))] == ["a"] * 3


def test_scan_sources(spark, tmp_path):
    for p in ("src/a.sol", "src/test/b.sol", "src/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    got = ingest.scan_sources(spark, str(tmp_path / "src"))
    assert [r.path.rsplit("/", 1)[1] for r in got.collect()] == ["a.sol"]


def test_sections(spark):
    text = "# A\n" + "x" * 200 + "\n## B\n" + "y" * 200 + "\n### C\nshort"
    got = markup.sections(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t").orderBy("section").collect()
    assert [(r.heading, len(r.body)) for r in got] == [("A", 200), ("B", 200)]


def test_streaming_dedup_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = usage.stream_dedup(stream.withColumnRenamed("user_id", "task_id"), late="60 days").writeStream.format("memory").queryName("tasks").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tasks").count() == events.select("user_id").distinct().count()


def test_filter_reaches_the_scan(spark):
    from graphloom.plans.views import Views

    plan = Views(spark, "/root/testdata/sf0.001").chunks.filter("subcategory = 'en'").select("chunk_id")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(lang,en)" in plan
    assert "text:string" not in plan
