"""Full-text search, source lookups, typed wiring and replies against plain Python and on edge cases."""

import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from graphloom.functions.stem import STOP_WORDS, stem
from graphloom.operators import fulltext, lookup, retrieval, wiring
from graphloom.sources import replies

SF = "/root/testdata/sf0.001"
#: Words of the published sample vocabulary of the English stemmer, each with its stem.
STEMS = """consign consign consigned consign consigning consign consignment consign consistency consist consistently consist consolation consol consolatory consolatori
consolidating consolid consolingly consol consonant conson conspicuously conspicu conspiracy conspiraci conspirators conspir conspiring conspir constables constabl constancy constanc
knackeries knackeri knavish knavish kneaded knead kneeling kneel knightly knight knitted knit knives knive knocker knocker knots knot
generously generous communication communic skies sky dying die happiness happi relational relat hopping hop hoping hope caresses caress ties tie cries cri gas gas this this
kiwis kiwi proceeds proceed luxuriated luxuri hopefully hope sensibilities sensibl nationality nation vileness vile apology apolog singing sing feed feed agreed agre enjoy enjoy
say say by by electricity electr usefulness use adoption adopt controller control rolled roll""".split()


@pytest.fixture
def folder(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    return str(tmp_path)


def test_stems(spark):
    rows = spark.createDataFrame(list(zip(STEMS[::2], STEMS[1::2], strict=True)), "word string, want string")
    assert rows.select("word", "want", stem(F.col("word")).alias("got")).filter("want <> got").collect() == []


def test_words_begin_like_their_stems(spark):
    rng = random.Random(5)
    ends = "s es ed ing ly ies ied bility ational ization iviti abli y ying fulness ogy li".split()
    made = [rng.choice(["nob", "sens", "d", "l", "t", "sk", "gener", "cr", "hop", "aa"]) + rng.choice(["", "a", "i", "tt"]) + rng.choice(ends) for _ in range(400)]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("word"))
    words = docs.union(spark.createDataFrame([(w,) for w in made], "word string")).filter("word <> ''").distinct()
    rows = words.select("word", stem(F.col("word")).alias("stem")).collect()
    assert all(r.word.startswith(fulltext.beginning(r.stem)) for r in rows)


def brute_rank(stems, query):
    places = [(i + 1, s) for i, s in enumerate(stems) if s in query]
    out, last_begin = 0.0, 0
    for j, (q, _) in enumerate(places):
        last = {s: k for k, (_, s) in enumerate(places[: j + 1])}
        if len(last) == len(query):
            k = min(last.values())
            if places[k][0] > last_begin:
                last_begin = places[k][0]
                out += 0.1 / (1 + (q - last_begin) - (j - k))
    return round(out, 9)


def test_cover_rank_equals_brute_force(spark, folder):
    rng = random.Random(7)
    words = {"hoped": "hope", "hopes": "hope", "hoping": "hope", "runs": "run", "running": "run", "sky": "sky", "skies": "sky", "the": None, "tree": "tree"}
    texts = [" ".join(rng.choice(list(words)) for _ in range(rng.randint(0, 30))) for _ in range(120)] + [None, "", "Hoping! RUNS; skies"]
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, chunk_text string")
    fulltext.write_index(rows, f"{folder}/index", 4)
    for query, lexemes in (("the hope", ["hope"]), ("running of skies", ["run", "sky"]), ("hopes, running and sky", ["hope", "run", "sky"])):
        assert fulltext.query_lexemes(spark, query) == lexemes
        want = {}
        for i, t in enumerate(texts):
            stems = [words.get(w) for w in re.findall(r"\w+", (t or "").lower())]
            if set(lexemes) <= set(stems):
                want[i] = brute_rank(stems, lexemes)
        assert dict(map(tuple, fulltext.search(rows, query).collect())) == want
        assert dict(map(tuple, fulltext.search_index(spark, f"{folder}/index", query, 4).collect())) == want
    for nothing in ("", "the of and", "?!"):
        assert fulltext.search(rows, nothing).count() == 0
        assert fulltext.search_index(spark, f"{folder}/index", nothing, 4).count() == 0
    assert fulltext.search(rows, "absent").count() == 0
    assert len(STOP_WORDS) == 127


def test_representatives_take_the_larger_vector_score(spark):
    rows = lambda no, *own: spark.createDataFrame([(i, no, 1, s) for i, s in own], "chunk_id long, list_no int, rank int, score double")
    got = retrieval.representatives([rows(1, (1, 0.5), (2, 0.5), (3, -0.1)), rows(2, (1, 0.5), (2, 0.7)), rows(3, (3, 0.4), (1, 9.0), (4, 0.2))])
    assert sorted(map(tuple, got.collect())) == [(1, 1, 0.5, 0.0), (2, 2, 0.7, 0.0), (3, 3, 0.0, 0.4), (4, 3, 0.0, 0.2)]


# source lookups


@pytest.fixture
def code(spark):
    files = {"a.sol": "contract VaultX {\n f\n}\nline4\nline5", "b.sol": "Vault\n" + "\n".join(f"l{i}" for i in range(2, 101)), "c.sol": "", "d.sol": "my$Pool Vault"}
    defs = [
        ("fn:Vault.f1", "f1", "Vault", "b.sol", 10, 12, 1),
        ("fn:Vault.f2", "f2", "Vault", None, 2, None, 2),
        ("fn:Pool.f1", "f1", "Pool", "none.sol", 1, 1, 3),
        ("fn:Pool.f3", "f3", "Pool", "b.sol", None, None, 4),
        ("fn:Gone.f", "f", "Gone", None, 3, 4, 5),
        ("fn:Vault.f4", "f4", "Vault", "b.sol", 99, 300, 6),
        ("fn:Vault.f5", "f5", "Vault", "b.sol", 50, 51, 7),
    ]
    return (
        spark.createDataFrame(list(files.items()), "path string, content string"),
        spark.createDataFrame(defs, "id string, name string, contract string, file string, line_start int, line_end int, ord long"),
        files,
        defs,
    )


def test_first_files_find_names_inside_words(spark, code):
    names = ["Vault", "VaultX", "Pool", "my$P", "Gone", "", "l1", "no way", "vault", "4"]
    want = {n: next((p for p, c in sorted(code[2].items()) if n in c), None) for n in names if re.fullmatch(r"[\w$]+", n)}
    got = dict(map(tuple, lookup.first_files(code[0], spark.createDataFrame([(n,) for n in names], "name string")).collect()))
    assert got == {n: p for n, p in want.items() if p}
    assert lookup.first_files(code[0], spark.createDataFrame([], "name string")).count() == 0


def brute_snippet(files, d):
    _, _, contract, file, first, last, _ = d
    path = file if file in files else next((p for p, c in sorted(files.items()) if contract in c), None)
    if not first or path is None:
        return None
    lines = files[path].split("\n")
    cut = lines[max(0, first - 1) : min(len(lines), last or first + 60)]
    return path, first, last or first + len("\n".join(cut).split("\n")), "\n".join(cut)


def test_snippets(code):
    files, defs = code[2:]
    want = {d[0]: s for d in defs if (s := brute_snippet(files, d))}
    assert {r[0]: tuple(r)[1:] for r in lookup.snippets(code[1], code[0]).collect()} == want


def test_finding_and_proof_sources(spark, code):
    files, defs = code[:2]
    calls = spark.createDataFrame([("fn:Vault.f1", f"fn:Vault.f{k}", o) for o, k in enumerate((5, 4, 9, 2, 1))] + [("fn:Vault.f2", "fn:Vault.f5", 1)], "src string, dst string, ord long")
    degrees = calls.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    places = ["Vault.f1", "Vault . f2:L3", "Vault.f9", "Pool", "Gone.f", "", None, "Nowhere.g", "Vault.f1:L4-9, VaultX.a:Lx , Pool.z:L1,VaultX:L2", "a:b.c:L1", "Vault.f:L99999"]
    rows = spark.createDataFrame(list(enumerate(places)), "id long, location string")
    got = dict(map(tuple, lookup.finding_sources(rows, defs, calls, degrees, files).collect()))
    titles = {i: re.findall(r"^// \S+ — (\S+) \(L(\d+-\d+)\)$", s, re.M) for i, s in got.items()}
    assert [t[0] for t in titles[0]] == ["Vault.f1()", "Vault.f2()", "Vault.f5()", "Vault.f4()"]
    assert [t[0] for t in titles[1]] == ["Vault.f2()", "Vault.f5()"]
    assert got[0].split("\n\n")[0].split("\n")[1:] == [f"l{i}" for i in range(6, 16)]
    assert got[2] == code[2]["a.sol"]  # `VaultX` contains Vault
    assert got[3] == code[2]["d.sol"]
    assert got[4] == lookup.NOT_FOUND
    assert {got[i] for i in (5, 6, 7)} == {lookup.NOT_AVAILABLE}
    proof = dict(map(tuple, lookup.proof_sources(rows, files).collect()))
    whole = "// a.sol (L1-5)\n" + code[2]["a.sol"]
    assert proof[8] == whole + "\n\n// d.sol (L1-1)\n" + code[2]["d.sol"]
    assert proof[10] == "// a.sol (L99995-5)\n"
    assert proof[9] != lookup.NOT_HERE  # `a` stands before the colon
    assert {proof[i] for i in (0, 1, 3, 5, 6)} == {lookup.NOT_HERE}


def test_soft_budget_ends_with_the_text_that_reaches_it(spark):
    items = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(len(t)).alias("n")) for t in ("aaa", "bb", "cccc", "d")))
    assert spark.range(1).select(*(lookup.soft_join(items, n) for n in (0, 3, 4, 5, 6, 99))).first()[:] == ("", "aaa", "aaa\n\nbb", "aaa\n\nbb", "aaa\n\nbb\n\ncccc", "aaa\n\nbb\n\ncccc\n\nd")


def test_related_functions_of_a_large_contract(spark):
    rng = random.Random(2)
    defs = [(f"fn:{c}.{n}#{k}", n, c, k) for k, (c, n) in enumerate((rng.choice("AAAB"), f"f{rng.choice([0] * 20 + list(range(60)))}") for _ in range(300))]
    places = [f"{c}.{n}:L1" for c in "ABC" for n in ("f0", "f7", "f99")] + ["A", "", "A.f0"]
    rows = spark.createDataFrame(list(enumerate(places)), "id long, location string")
    nodes = spark.createDataFrame(defs, "id string, name string, contract string, ord long")
    got = {r.id: list(r.fn_ids) for r in lookup.related_functions(rows, nodes).collect()}
    for i, p in enumerate(places):
        c, n = p.split(".")[0], p.split(".")[1].split(":")[0] if "." in p else ""
        want = []
        for d in defs:
            if d[2] == c:
                want.insert(0, d[0]) if d[1] == n else want.append(d[0])
        assert got[i] == want[:12]


# wiring


def test_transitive_writes_with_cycles(spark, folder):
    rng = random.Random(9)
    calls = [(f"f{rng.randrange(40)}", f"f{rng.randrange(40)}") for _ in range(60)] + [(f"g{i}", f"g{i + 1}") for i in range(20)] + [("g20", "g0")]
    writes = [(f"f{rng.randrange(40)}", f"v{rng.randrange(9)}") for _ in range(25)] + [("g20", "w"), ("g3", "w")]
    out = defaultdict(set)
    for s, d in calls:
        out[s].add(d)
    want = set()
    for f in {x for c in calls for x in c} | {w[0] for w in writes}:
        seen, todo = {f}, [f]
        while todo:
            for x in out[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        want |= {(f, v) for s, v in writes if s in seen}
    kinds = "src string, dst string"
    w, c = spark.createDataFrame(writes * 2, kinds), spark.createDataFrame(calls * 2, kinds)
    rows = wiring.transitive_writes(w, c).collect()
    assert len(rows) == len(want)
    assert {(r.src, r.dst) for r in rows} == want
    assert {r.src: r.depth for r in rows if r.dst == "w"}["g4"] == 16
    nodes = spark.createDataFrame([(x,) for x in {*(f"f{i}" for i in range(0, 40, 2)), *(f"v{i}" for i in range(9))}], "id string")
    edges = wiring.typed_edges(w, spark.createDataFrame([("f0", "v0"), ("f2", "v1"), ("f2", "f4")], kinds), c, nodes).collect()
    assert len({(r.src, r.dst) for r in edges}) == len(edges)
    assert {(r.src, r.dst) for r in edges if r.type == "WRITES"} == {(s, v) for s, v in want if int(s[1:]) % 2 == 0 and s[0] == "f"}
    assert wiring.transitive_writes(w.limit(0), c).count() == 0


def test_transitive_writes_are_stored_once(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    kinds = "src string, dst string"
    w, c = spark.createDataFrame([("c12", f"v{i}") for i in range(20)], kinds), spark.createDataFrame([(f"c{i:02}", f"c{i + 1:02}") for i in range(12)], kinds)
    rows = wiring.transitive_writes(w, c)
    assert rows.count() == 13 * 20
    tables = [str(p) for p in tmp_path.rglob("writes-*") if p.is_dir()]
    assert sum(spark.read.schema(rows.schema).parquet(p).count() for p in tables) == 13 * 20
    assert not list(tmp_path.rglob("rdd-*"))


def test_points_to_follows_long_chains_and_cycles(spark, folder):
    refs = [(1, i, f"r{i}", i + 1 if i < 70 else None) for i in range(71)] + [(2, i, f"r{i}", (i + 1) % 5) for i in range(5)] + [(3, 0, "p", 0), (3, 1, "q", 99), (4, 7, "r70", None)]
    params = [(1, "r70"), (2, "none"), (3, "p")]
    got = {(r.fn, r.ref): (r.label, r.data_source) for r in wiring.points_to(spark.createDataFrame(refs, "fn long, ref long, name string, points_to long"), spark.createDataFrame(params, "fn long, name string")).collect()}
    assert len(got) == len(refs)
    assert {got[1, i][1] for i in range(71)} == {"user_input"}
    assert got[1, 0][0] == "r1"
    assert {got[2, i][1] for i in range(5)} == {"state"}
    assert got[3, 0] == ("p", "user_input")
    assert got[3, 1] == ("q", "state")
    assert got[4, 7] == ("r70", "state")


# replies


def column(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[1] for r in rows.select("i", f(F.col("t"))).orderBy("i").collect()]


def test_json_array(spark):
    texts = ['say ```json\n[1, 2]\n``` end', 'x [ {"a": "]"}, [1] ] y', "[1, 2", r'["a \" ] \\", "b"] z]', r"\[1]", "", None, "```\n[3]\n```", '["' + "x\\n" * 50_000 + '"]', 'a "[" [4]']
    want = ["[1, 2]", '[ {"a": "]"}, [1] ]', None, r'["a \" ] \\", "b"]', "[1]", None, None, "[3]", texts[8], None]
    assert column(spark, replies.json_array, texts) == want


def test_objects(spark):
    one = json.dumps({"a": {"b": [1, "é"]}})
    texts = [f"```json\n{one}\n``` x", f"```\n{one}\n```", f"so {one} and {{}}", f"```json\n{one}", "{broken} {}", "none", None, "", '{"a": "}"}', f"```json\nno\n``` {one}", "{" * 20_000 + "}" * 20_000]
    plain = lambda f: [json.loads(x) if x else None for x in column(spark, lambda c: F.to_json(f(c)), texts[:-1])]
    own = json.loads(one)
    assert plain(replies.any_object) == [own, own, own, own, None, None, None, None, None, own]
    assert plain(replies.fenced_object) == [own, own, own, own, None, None, None, None, {"a": "}"}, None]
    assert column(spark, replies.balanced_object, texts[-1:]) == texts[-1:]


def test_enrichment_defaults(spark):
    reply = {"trust_boundaries": [{}, {"name": "n", "trust_level": 5, "related_modifiers": ["m"]}], "invariants": [{"related_vars": ["v", "w"]}, {"id": "X"}], "protocol_type": "amm"}
    rows = spark.createDataFrame([(1, json.dumps(reply)), (2, "{}"), (3, "[]"), (4, None)], "k int, t string")
    nodes, edges, meta = (sorted(map(tuple, x.collect()), key=repr) for x in replies.enrichment(rows, ["k"], "t"))
    assert [n[2] for n in nodes] == ["invariant:INV-1", "invariant:X", "trust:n", "trust:unknown"]
    assert [n[4] for n in nodes if n[1] == "TrustBoundary"] == ["5", "UNTRUSTED"]
    assert edges == [(1, "invariant:INV-1", "v"), (1, "invariant:INV-1", "w")]
    assert meta == [(1, "amm", "", []), (2, "unknown", "", []), (3, "unknown", "", [])]
