"""Operators 11 to 13 against their SQL, brute force and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from graphloom.llm import conversations, rules, variants
from graphloom.llm.queries import ORACLE_SQL, QUERIES

from .. import oracle

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    oracle.compare(spark, oracle.connect(SF), name, QUERIES[name], ORACLE_SQL[name], SF)


# 11: spelling variants


def brute_variants(rows):
    count = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                count[w] += 1
    words = {w: n for w, n in count.items() if n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    forms, out = {}, {}
    for w, n in words.items():
        by = [v for v in words if near(w, v)]
        best = min(by, key=lambda v: (-words[v], v), default=None)
        forms[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = [n, len(by), words[forms[w]] if forms[w] else None]
    for w, row in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        row[:0] = [forms[w], root]
    return {w: tuple(row) for w, row in out.items()}


def own_variants(df):
    rows = variants.variants(df).collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def misspelt(rng, w):
    k, c = rng.randrange(len(w) + 1), rng.choice("abeéÿ")
    return rng.choice([w[:k] + c + w[k:], w[: max(0, k - 1)] + w[k:], w[: max(0, k - 1)] + c + w[k:]])


def test_variants_equal_brute_force(docs):
    rng = random.Random(11)
    # repeated letters, common halves, letters beyond ASCII and chains of forms
    seeds = ["aaaaaa", "abababab", "banana", "bananas", "bandana", "élèveÿt", "stations", "rotation", "notation", "abcdefghijklm"]
    rows = []
    for i in range(300):
        words = [rng.choice(seeds) for _ in range(12)]
        words = [misspelt(rng, w) if rng.random() < 0.3 else w for w in words]
        words = [misspelt(rng, w) if rng.random() < 0.2 else w for w in words]
        rows.append((i if i % 50 else None, " ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in words) + "! x9y" + " stationsz" * (i < 28) + " stationszq" * (i < 5), None, None))
    want = brute_variants([r[:2] for r in rows])
    assert any(f and r != f for f, r, *_ in want.values())
    assert own_variants(docs(rows)) == want


def test_variants_in_blocks(docs, monkeypatch):
    # a group of many words with one half in common is dealt in blocks and taken in pieces, and loses no pair
    monkeypatch.setattr(variants, "BLOCK", 7)
    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(4)) + "tion" for _ in range(150)]
    rows = [(i, " ".join(words), None, None) for i in range(6)]
    assert own_variants(docs(rows)) == brute_variants([r[:2] for r in rows])


def test_variants_kernel_keeps_indexed_words(monkeypatch):
    words = sorted({a + b + c + "tion" for a in "abcde" for b in "abcde" for c in "abcde"})
    rank = variants.np.arange(variants.GRAMS, dtype=variants.np.int32)
    (posted,) = variants._posted(rank)(iter([pa.RecordBatch.from_arrays([pa.array(words), pa.array([5] * len(words))], names=["word", "n"])]))
    rows = pa.Table.from_batches([posted]).append_column("block", pa.array([0] * posted.num_rows)).sort_by([(c, "ascending") for c in ("key", "block", "query", "word")])
    whole = sorted(variants.near_pairs(rows.combine_chunks()))
    monkeypatch.setattr(variants, "ROWS", 10)
    pieces = [p for b in variants._searched(iter(rows.to_batches(max_chunksize=3))) for p in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert sorted(pieces) == whole
    assert len(whole) == len(words) * 12 // 2


def test_variants_edges(docs, edge, none):
    assert variants.variants(none).count() == 0
    assert own_variants(edge) == {}
    long = "xy" * 50_000
    rows = [(1, f"{long} {long}z"[:200_010], None, None)] * 5 + [(None, None, None, None), (2, "", None, None), (3, "×÷" * 4, None, None)]
    assert own_variants(docs(rows)) == brute_variants([r[:2] for r in rows])


# 12: conversations


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        kids = [s for s in below if len(s) == len(seq) + 1]
        leaves = [s for s in below if not any(x[: len(s)] == s and len(x) == len(s) + 1 for x in below)]
        saved = sum((len(nodes[s]) - 1) * len(WORD.findall(s[-1][1])) for s in below if s)
        ends = ",".join(map(str, sorted(c for c in members if len(full[c]) == len(seq))))
        parent = min(nodes[seq[:-1]]) if seq else None
        out.append((min(members), len(seq), parent, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def turns_of(spark, rows):
    kinds = "conv_id long, turn long, role string, text string, k1 long, n int, part string"
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], kinds)


def own_trie(df):
    columns = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()
    return sorted(map(tuple, conversations.prefix_trie(df).select(columns).collect()), key=repr)


def test_trie_equals_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for c in [*range(60), 101, 102, 119, 200]:
        common = rng.randint(0, 6)
        for t in range(rng.randint(1, 12)):
            rows.append((c, t if t else None, "user" if t % 2 else None, f"turn {t} of all\n" if t < common else rng.choice([None, "", f"own {c % 3} words", "a b"])))
    rng.shuffle(rows)
    assert own_trie(turns_of(spark, rows)) == brute_trie(rows)


def test_trie_of_long_conversations(spark, monkeypatch):
    # deeper than a block, so that digests are carried over blocks and pointers jump many times
    monkeypatch.setattr(conversations, "BLOCK", 4)
    monkeypatch.setattr(conversations, "CHUNK", 3)
    rows = [(c, t, "u", f"t{min(t, 40)} w" if t < 45 - c % 2 else f"{c}") for c in range(21) for t in range(50 + c % 3)]
    assert own_trie(turns_of(spark, rows)) == brute_trie(rows)


def test_trie_edges(spark):
    assert conversations.prefix_trie(turns_of(spark, [])).count() == 0
    # null ids, only turnless conversations, repeated rows, ties, a long text, negative ids
    turnless = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 >= 1][:3]
    rows = [(c, 1, "u", "gone") for c in turnless]
    assert own_trie(turns_of(spark, [*rows, (None, 1, "u", "x")])) == brute_trie(rows)
    rows = [(0, 1, "u", "a"), (0, 1, "u", "a"), (0, None, None, None), (20, 2, "u", "w " * 100_000), (20, 2, "u", "w " * 100_000), (23, 5, "u", None), (40, 9, "", "")]
    assert own_trie(turns_of(spark, rows)) == brute_trie(rows)
    assert conversations.prefix_trie(turns_of(spark, [(-7, 1, "u", "a b"), (-20, 1, "u", "c")])).count() >= 2


# 13: quality rules


def brute_rules(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    n, sign = len(words), len(re.findall(r"[#*$%&|<>]", text))
    base = n < 10 or 100 * len(covered) > 20 * n
    return n, sum(map(len, words)), sign, len(lines) - len(set(lines)), len(covered), base


def test_rules_equal_brute_force(docs):
    rng = random.Random(13)
    texts = [None, "", " \n\t", "one", "a b c d e", "a b c d e " * 2, "x " * 40, "the of\n" * 30, "é  # $%&|<>\x0b\x0c\r", "same line\n\nsame line\n same line"]
    for _ in range(150):
        words = [rng.choice("the of ba ce di fo gu # a|b".split()) + ("" if rng.random() < 0.6 else str(rng.randint(0, 30))) for _ in range(rng.randint(0, 60))]
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", " "]) for w in words) + " ".join(words[: rng.choice([0, 0, 5, 9])]))
    rows = [(i if i % 9 else None, t, None, None) for i, t in enumerate(texts)]
    got = sorted(tuple(r)[1:6] + (r.base_failed,) for r in rules.judged(docs(rows)).collect())
    assert got == sorted(brute_rules(t) for t in texts)


def test_rules_verdicts(docs):
    prose = " ".join(f"the word{i} of place{i} and" for i in range(20))
    bad = {
        "word_length": " ".join(f"the of {'x' * 60}{i} and" for i in range(20)),
        "symbols": " ".join(f"the word{i}### of and" for i in range(20)),
        "stop_words": " ".join(f"word{i} place{i}" for i in range(20)),
        "double_words": " ".join(f"the the word{i} word{i}" for i in range(20)),
        "dup_lines": "\n".join(f"the word{i} of\nand" for i in range(3)) + "\nand" * 9,
    }
    rows = [(0, prose, None, None), *((k, t, None, None) for k, t in enumerate(bad.values(), 1))]
    got = {r.doc_id: (r.kept, r.failed_rules, r.base_failed) for r in rules.judged(docs(rows)).collect()}
    assert got[0] == (True, "", False)
    for k, name in enumerate(bad, 1):
        kept, failed, base = got[k]
        assert not kept
        assert name in failed.split(",") or base


def test_rules_hold_out_quality_labels(spark):
    # the thresholds keep labelled good documents but for the base rules, and drop bad ones
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = rules.judged(docs).join(labels, "doc_id").collect()
    assert all(r.kept or r.base_failed for r in rows if r.quality == 1)
    assert not any(r.kept for r in rows if r.quality == 0)


def test_rules_edges(edge, none, docs):
    assert rules.judged(none).count() == 0
    rows = rules.judged(edge).collect()
    assert len(rows) == 7
    assert not any(r.kept for r in rows)
    (long,) = rules.judged(docs([(1, " ".join(f"the w{i % 70000}" for i in range(300_000)), None, None)])).collect()
    assert (long.n_words, long.n_repeat_words) == (600_000, 600_000)


def test_rules_need_one_projection(docs):
    plan = rules.judged(docs([(1, "a", None, None)]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Generate|Join", plan)
