"""Operator 11: spelling variants, by a positional q-gram inverted index with a count filter.

Words of one edit's difference, of lengths m and m or m + 1, agree in the first m // 2 letters or in the last
m - m // 2. Of each such part a word posts its POSTED rarest positional q-grams; words that share them meet in a group, which
fixes length and place. There every word's padded positional q-grams are indexed. A query of length m reads the lists
of its q-grams at the same place for words of length m, and at the same place or one further for words of length
m + 1. One edit spoils at most q q-grams, so a near word is in max(m, m') - 1 lists or more. Queries with fewer lists
leave; the shorter lists of the others are merged on a heap, the longest are searched for what was found, words in
enough lists are kept, and the edit is verified.

Defined results: a null text has no words; a null doc_id counts as empty text before the colon; repeated rows count
each; ties between near words go to the smallest in code-point order; an empty table gives an empty result; extra
columns are ignored. Words of any length are compared whole. Groups with more than BLOCK indexed words are dealt in
blocks that the group's queries visit all, so no group must fit one task. Every form has five times the occurrences
or more, so forms have no cycles and a chain is at most log5 of the largest count long.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, mix64, parts, saved
from .conversations import CRC_SQL, crc32_sql

#: What a run is, when a letter goes, fewest letters and occurrences of a word, and how much larger a form is.
EVERY, LETTERS, OCCURRENCES, TIMES = 199, 6, 5, 5
RUN = f"[A-Za-zÀ-ÿ]{{{LETTERS},}}"

Q = 3
#: Letters are a-z and U+00C0 to U+00FF, and 0 pads; so there are BASE ** Q q-grams at most.
BASE = 1 + 26 + 64
GRAMS = BASE**Q
#: Rare q-grams of a part that a posting names; stands for no q-gram.
POSTED, NONE = 2, np.iinfo(np.int64).max
#: Indexed words of a group that one task holds; rows and letters that the kernel takes at once.
BLOCK, ROWS, SIZE = 4096, 20_000, 4_000_000

A_Z, a_z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def typed(doc_id: Column, run: Column) -> Column:
    """A run in lower case (A-Z only), without one letter where the checksum says so."""
    low = F.when(run.rlike("[A-Z]"), F.translate(run, A_Z, a_z)).otherwise(run)
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), low))
    gone = (h % F.length(low)).cast("int")
    return F.when(h % EVERY == 0, F.concat(F.substring(low, F.lit(1), gone), F.substring(low, gone + 2, F.length(low)))).otherwise(low)


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of all words with LETTERS code points and OCCURRENCES or more."""
    # shorter runs cannot give a word
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    words = runs.select(typed(F.col("doc_id"), F.col("run")).alias("word")).filter(F.length("word") >= LETTERS)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= OCCURRENCES)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers 1 to BASE - 1 of all letters, and the words' offsets."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points - 96, points - 0xC0 + 27), np.r_[0, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))]


def _grams(codes: np.ndarray) -> np.ndarray:
    return (codes[:-2] * BASE + codes[1:-1]) * BASE + codes[2:] if len(codes) > 2 else np.zeros(0, np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(GRAMS, np.int64)
    for b in batches:
        codes, offsets = letters(b.column(0).to_pylist())
        g = _grams(codes)
        inside = np.ones(len(g), bool)
        for back in (1, 2):  # windows that cross words
            inside[(offsets[1:-1] - back)[(offsets[1:-1] - back >= 0) & (offsets[1:-1] - back < len(g))]] = False
        count += np.bincount(g[inside], minlength=GRAMS)
    some = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], names=["gram", "n"])


def rarity(words: DataFrame) -> np.ndarray:
    """Rank of every q-gram, the rarest first. Bounded by the alphabet: GRAMS numbers at most, whatever the input."""
    counts = words.select("word").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(GRAMS, np.int64)
    n[counts["gram"].to_numpy()] = counts["n"].to_numpy()
    rank = np.empty(GRAMS, np.int32)
    rank[np.argsort(n, kind="stable")] = np.arange(GRAMS, dtype=np.int32)
    return rank


def _rarest(value: np.ndarray, begin: np.ndarray, end: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """A hash of the POSTED rarest positional q-grams of disjoint parts (begin to end); value holds rank and place."""
    key = mix64(kind.astype(np.uint64))
    if not len(begin):
        return key.view(np.int64)
    value = value.copy()
    for _ in range(POSTED):
        best = np.minimum.reduceat(value, np.stack([begin, end], 1).ravel())[::2]
        more = best < NONE
        place = np.where(more, best & ((1 << 40) - 1), begin)
        key = mix64(key + mix64(np.where(more, (best >> 40) + 1, 0).astype(np.uint64)) * np.uint64(2) + mix64((place - begin).astype(np.uint64)))
        value[place] = NONE
    return key.view(np.int64)


def _posted(rank: np.ndarray):
    """(key, m, query, word, n): the groups of a word, as indexed word and as query; m holds the length and the part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            codes, offsets = letters(words)
            if not len(words):
                continue
            value = np.r_[(rank[_grams(codes)].astype(np.int64) << 40) | np.arange(len(codes) - Q + 1), NONE]
            size = np.diff(offsets)
            keys, of, length, side = [], [], [], []
            for m in (size, size - 1):
                use = np.flatnonzero(m >= LETTERS)
                half = m[use] // 2
                for k, (i, j) in enumerate(((offsets[use], offsets[use] + half), (offsets[use + 1] - (m[use] - half), offsets[use + 1]))):
                    keys.append(_rarest(value, i, j - Q + 1, m[use] * 2 + k))
                    of.append(use)
                    length.append(m[use])
                    side.append(np.full(len(use), k))
            key, of, length, side = map(np.concatenate, (keys, of, length, side))
            asks = size[of] == length
            both = lambda x: np.r_[x, x[asks]]
            rows = pa.array(both(of))
            yield pa.RecordBatch.from_arrays([pa.array(both(key)), pa.array(both(length * 2 + side)), pa.array(np.r_[np.zeros(len(of), bool), np.ones(int(asks.sum()), bool)]), b.column(0).take(rows), b.column(1).take(rows)], names=["key", "m", "query", "word", "n"])

    return run


def _padded(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The padded q-grams of words: number of the word, q-gram, place."""
    codes, offsets = letters(words)
    size = np.diff(offsets)
    wide = size + 2 * (Q - 1)
    start = np.cumsum(wide) - wide
    full = np.zeros(int(wide.sum()), np.int64)
    full[np.arange(len(codes)) + np.repeat(start + Q - 1 - offsets[:-1], size)] = codes
    of = np.repeat(np.arange(len(words)), wide - Q + 1)
    at = np.arange(len(of)) - np.repeat(np.cumsum(wide - Q + 1) - (wide - Q + 1), wide - Q + 1)
    return of, _grams(full)[start[of] + at], at


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b; b is as long as a or one longer."""
    if len(a) == len(b):
        i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
        return i < len(a) and a[i + 1 :] == b[i + 1 :]
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i:] == b[i + 1 :]


def merged(lists: list[np.ndarray], least: int) -> Iterator[int]:
    """Members of at least so many ascending lists. The shorter lists are merged on a heap; who is in two of them is
    looked up in the least - 2 longest."""
    lists = sorted(lists, key=len)
    cut = max(1, len(lists) - least + 2)
    short, long = lists[:cut], lists[cut:][::-1]
    few = least - len(long)

    def enough(i: int, times: int) -> bool:
        for k, x in enumerate(long):
            if times >= least or times + len(long) - k < least:
                break
            at = bisect_left(x, i)
            times += at < len(x) and x[at] == i
        return times >= least

    last, times = -1, 0
    for i in heapq.merge(*(x.tolist() for x in short)):
        if i != last:
            if times >= few and enough(last, times):
                yield last
            last, times = i, 0
        times += 1
    if times >= few and enough(last, times):
        yield last


def near_pairs(rows: pa.Table) -> Iterator[tuple[str, int, str, int]]:
    """Near pairs of whole groups (key, block), whose indexed words stand before their queries; the first of a pair is the query."""
    key, block, m, asks, words, n = (rows.column(c).to_pylist() if c == "word" else rows.column(c).to_numpy() for c in ("key", "block", "m", "query", "word", "n"))
    group = np.cumsum(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
    m, side = m // 2, m % 2
    indexed, queries = np.flatnonzero(~asks), np.flatnonzero(asks)
    if not len(indexed) or not len(queries):
        return
    size = np.fromiter(map(len, words), np.int64, len(words))
    hashed = lambda g, length, gram, at: mix64(mix64(g.astype(np.uint64) * np.uint64(GRAMS) + gram.astype(np.uint64)) + mix64(length.astype(np.uint64) + mix64(at.astype(np.uint64))))
    of, gram, at = _padded([words[i] for i in indexed])
    of = indexed[of]
    posted = hashed(group[of], size[of], gram, at)
    order = np.argsort(posted, kind="stable")  # rows ascend inside a list
    posted, holders = posted[order], of[order]
    own = {(group[i], words[i]) for i in indexed}
    here = np.fromiter(((group[i], words[i]) in own for i in queries), np.int64, len(queries))
    q_of, q_gram, q_at = _padded([words[i] for i in queries])
    q_row = queries[q_of]
    for longer in (0, 1):
        low, high = [], []
        for p in (q_at, q_at + 1)[: 1 + longer]:
            k = hashed(group[q_row], size[q_row] + longer, q_gram, p)
            low.append(np.searchsorted(posted, k, "left"))
            high.append(np.searchsorted(posted, k, "right"))
        low, high, asker = np.concatenate(low), np.concatenate(high), np.tile(q_of, 1 + longer)
        # a list counts if another word is in it; an indexed query is in all of its own lists
        some = high - low > (0 if longer else here[asker])
        asker, low, high = asker[some], low[some], high[some]
        least = size[queries] + longer - 1
        by = np.argsort(asker, kind="stable")
        bounds = np.searchsorted(asker[by], np.arange(len(queries) + 1))
        for k in np.flatnonzero(np.diff(bounds) >= least):
            q = queries[k]
            a, half = words[q], m[q] // 2
            for i in merged([holders[low[x] : high[x]] for x in by[bounds[k] : bounds[k + 1]]], int(least[k])):
                b = words[i]
                # a pair whose first parts are equal belongs to their group, any other pair to that of the second parts
                if (longer or a < b) and side[q] != (a[:half] == b[:half]) and one_edit(a, b):
                    yield a, int(n[q]), b, int(n[i])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """near_pairs over rows sorted by group. Of a group that is larger than the kernel takes the indexed words stay,
    BLOCK or about that, while its queries pass."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        pairs = list(near_pairs(rows.combine_chunks()))
        kinds = {"a": pa.string(), "n_a": pa.int64(), "b": pa.string(), "n_b": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    held = None
    for b in batches:
        held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        if held.num_rows < ROWS and held.nbytes < SIZE:
            continue
        key, block, asks = (held.column(c).to_numpy() for c in ("key", "block", "query"))
        last = int(np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])[-1])
        if last:
            yield found(held.slice(0, last))
            held, asks = held.slice(last), asks[last:]
        if (held.num_rows >= ROWS or held.nbytes >= SIZE) and asks.any():
            yield found(held)
            held = held.filter(pa.array(~asks))
    if held is not None and held.num_rows:
        yield found(held)


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (struct of -n and word) of the words of (word, n) that have a near word."""
    n = parts(words.sparkSession)
    posted = saved(words.mapInArrow(_posted(rarity(words)), "key long, m long, query boolean, word string, n long"), "postings")
    large = posted.filter("not query").groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK)
    large = large.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    blocks = F.coalesce("blocks", F.lit(1))
    mine = F.when(F.col("query"), F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.hash("word"), blocks)))
    dealt = posted.join(large, "key", "left").select("key", F.explode(mine).alias("block"), "query", "word", "m", "n")
    rows = dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "query", "word")
    pairs = rows.mapInArrow(_searched, "a string, n_a long, b string, n_b long")
    ways = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("word")).alias("near")), F.struct(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("minus"), F.col("a").alias("word")).alias("near")))
    out = pairs.select(F.explode(ways).alias("w")).groupBy("w.word").agg(F.count("*").alias("n_near"), F.min("w.near").alias("best"))
    out = saved(out, "near")
    dropped(posted)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """word, root of (word, form): the ends of all chains, by doubling."""
    now = saved(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = saved(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        dropped(now)
        now = ahead
        if not now.filter("moved").take(1):
            return now.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = saved(vocabulary(docs), "vocabulary")
    near = words.join(near_words(words), "word", "left")
    larger = -F.col("best.minus") >= TIMES * F.col("n")
    known = near.select("word", F.when(larger, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(larger, -F.col("best.minus")).alias("form_n"))
    known = saved(known, "forms")
    ends = roots(known.filter("form is not null"))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL for `variants` over documents."""
    octets = "flatten(list_transform(string_split(doc || ':' || low, ''), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [192 + ord(x) // 64, 128 + ord(x) % 64] END))"
    return f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc, low, length(low) AS size, count(*) AS k FROM (SELECT doc, translate(run, '{A_Z}', '{a_z}') AS low FROM runs) WHERE length(low) >= 6 GROUP BY ALL),
sums AS (SELECT low, size, k, {crc32_sql(octets)} AS h FROM low, crc),
words AS (SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN low[:h % size] || low[h % size + 2:] ELSE low END AS word, k FROM sums) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT a, b, n_b FROM (
  SELECT x.word AS a, y.word AS b, y.n AS n_b FROM cut x JOIN cut y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
  UNION ALL SELECT x.word, y.word, y.n FROM cut x JOIN words y ON x.rest = y.word
  UNION ALL SELECT y.word, x.word, x.n FROM cut x JOIN words y ON x.rest = y.word)),
near AS (SELECT a, count(*) AS n_near, first(b ORDER BY n_b DESC, b) AS b, max(n_b) AS n_b FROM pairs GROUP BY a),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN n_b >= 5 * n THEN b END AS form, CASE WHEN n_b >= 5 * n THEN n_b END AS form_n FROM words LEFT JOIN near ON word = a),
chain AS (SELECT word, word AS root FROM forms UNION SELECT chain.word, forms.form FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT chain.word, root FROM chain JOIN forms ON root = forms.word WHERE forms.form IS NULL) USING (word)"""
