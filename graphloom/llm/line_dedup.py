"""Operator 5: line dedup by pairwise alignment.

Documents that share lines become pairs of a later and an earlier document (by doc_id): a rare line, in RARE documents
or fewer, pairs each of them with every earlier one. Windows, the shortest runs of lines with MIN_WORDS words that start
or that end at a line, do the same for blocks of frequent lines only: a window without a rare line pairs each of its
documents with the holder before it, in chains of about CHAIN holders whose heads are chained in turn, so that pairs
grow with the lines and no document meets all others.

Each pair is aligned by patience diff (lines unique in both anchor the alignment, which is then refined between
anchors), and aligned common blocks of MIN_WORDS words or more are deleted from the later one. Where lines are left
over that the earlier text has too, blocks may be moved or repeated: each stretch of them that both texts have is
aligned on its own, until none is left. Nothing is deleted but what an alignment gives.

Any common block is covered by windows inside it, and all documents of a window are paired or chained, so a text keeps
no block of MIN_WORDS words that an earlier document has. The first holder of a block keeps it, with all its copies
there. Blocks are those of the given texts, not ones that deletions bring together; hashes of 64 bits stand for lines
and windows.

Defined results: empty lines never count; null and empty texts are left alone; nulls in doc_id come last in the order;
rows equal in doc_id and text are one document and are treated alike; among rows that share a doc_id alone, a hash of
the text decides which is earlier; an empty table gives an empty one; a text is handled in one piece, however long.
Other columns are kept; columns of docs that are called n_lines or n_removed give way to the new ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import dropped, mix64, parts, runs, saved, segment_hashes, slices, utf8

RARE, CHAIN, MIN_WORDS = 6, 128, 8
LINE = np.dtype([("h", "<u8"), ("w", "<u4")])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def lines_of(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Hash and number of words of every line that is not empty, for each text."""
    starts, ends = runs(data != 10, offsets)
    out = np.empty(len(starts), LINE)
    out["h"] = segment_hashes(data, starts, ends)
    begins = np.zeros(len(data) + 1, np.int64)
    word = data > 32
    fresh = np.r_[True, ~word[:-1]] if len(data) else word
    fresh[offsets[offsets < len(data)]] = True  # the text before may end in a word
    begins[1:] = np.cumsum(word & fresh)
    out["w"] = begins[ends] - begins[starts]
    at = np.searchsorted(starts, offsets)
    return [out[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]


def windows(lines: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first line and end of the shortest runs of a text's lines with min_words or more from, and up to, each line."""
    n = len(lines)
    words = np.r_[0, np.cumsum(lines["w"], dtype=np.int64)]
    at = np.arange(n + 1)
    end, start = np.searchsorted(words, words + min_words, "left"), np.searchsorted(words, words - min_words, "right") - 1
    i, j = np.concatenate([at[end <= n], start[start >= 0]]), np.concatenate([end[end <= n], at[start >= 0]])
    powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE)].astype(np.uint64))
    back = np.cumprod(np.r_[np.uint64(1), np.full(n, _INVERSE)].astype(np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(lines["h"] * powers[:n], dtype=np.uint64)]
    return mix64((sums[j] - sums[i]) * back[i] + (j - i).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), i, j


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(2))
        for i, j in slices(offsets):
            own = lines_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            heads = [np.unique(x["h"]).view(np.int64) for x in own]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array([x.tobytes() for x in own], pa.binary()), pa.array(heads, pa.list_(pa.int64()))],
                names=["ord", "digest", "lines", "heads"],
            )


def _frequent_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (ord, digest, lines, often): hashes of the windows that consist of lines in often."""
    for b in batches:
        spans = []
        for x, often in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            lines = np.frombuffer(x, LINE)
            h, i, j = windows(lines)
            other = np.r_[0, np.cumsum(~np.isin(lines["h"], np.array(often, np.int64).view(np.uint64)))]
            spans.append(np.unique(h[other[i] == other[j]]).view(np.int64))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(spans, pa.list_(pa.int64()))], names=["ord", "digest", "spans"])


def increasing(values: list[int]) -> list[int]:
    """Places of a longest increasing subsequence."""
    from bisect import bisect_left

    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal lines, ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, n, j, m = todo.pop()
        while i < n and j < m and a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        while i < n and j < m and a[n - 1] == b[m - 1]:
            n, m = n - 1, m - 1
            found.append((n, m))
        if i >= n or j >= m:
            continue
        once_a: dict[int, int] = {}
        once_b: dict[int, int] = {}
        for once, own, lo, hi in ((once_a, a, i, n), (once_b, b, j, m)):
            for k in range(lo, hi):
                once[own[k]] = -1 if own[k] in once else k
        both = [(k, once_b[h]) for h, k in once_a.items() if k >= 0 and once_b.get(h, -1) >= 0]
        anchors = [both[k] for k in increasing([y for _, y in both])]
        for x, y in anchors:
            todo.append((i, x, j, y))
            i, j = x, y  # the anchor itself is the first equal line of the next part
        if anchors:
            todo.append((i, n, j, m))
    return sorted(found)


def aligned_blocks(a: list[int], b: list[int], words: list[int], min_words: int) -> list[int]:
    """Places in a of the lines in aligned blocks of min_words or more."""
    gone: list[int] = []
    block: list[int] = []
    last = None
    for i, j in [*patience(a, b), (-9, -9)]:
        if last is None or (i, j) != (last[0] + 1, last[1] + 1):
            if sum(words[k] for k in block) >= min_words:
                gone += block
            block = []
        block.append(i)
        last = (i, j)
    return gone


def left_over(a: list[int], b: list[int], words: list[int], gone: set[int], min_words: int) -> bool:
    """Whether a run of lines that b has too holds min_words or more, and a line that is not gone."""
    theirs = set(b)
    if all(k in gone or h not in theirs for k, h in enumerate(a)):
        return False
    total, fresh = 0, False
    for k, h in enumerate(a):
        if h in theirs:
            total, fresh = total + words[k], fresh or k not in gone
            if fresh and total >= min_words:
                return True
        else:
            total, fresh = 0, False
    return False


def common_lines(later: np.ndarray, earlier: np.ndarray, min_words: int = MIN_WORDS) -> list[int]:
    """Numbers of the later text's lines that lie in aligned blocks of min_words or more: of the whole texts first, then
    of each stretch that is left and that the earlier text has at another place."""
    a, b, words = later["h"].tolist(), earlier["h"].tolist(), later["w"].tolist()
    gone = set(aligned_blocks(a, b, words, min_words))
    if left_over(a, b, words, gone, min_words):
        h, i, j = windows(later, min_words)
        g, x, y = windows(earlier, min_words)
        place = dict(zip(g.tolist(), zip(x.tolist(), y.tolist(), strict=True), strict=True))
        for k in np.flatnonzero(np.isin(h, g)).tolist():
            start, end = int(i[k]), int(j[k])
            if any(n not in gone for n in range(start, end)):
                there = b[slice(*place[int(h[k])])]
                gone.update(start + n for n in aligned_blocks(a[start:end], there, words[start:end], min_words))
    return sorted(gone)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        gone = [common_lines(np.frombuffer(x, LINE), np.frombuffer(y, LINE)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(gone, pa.list_(pa.int32()))], names=["ord", "digest", "gone"])


def _rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (row, text, gone): row, the text without the lines in gone, n_lines, n_removed."""
    for b in batches:
        texts, total, removed = [], [], []
        for t, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            lines = t.split("\n") if t else []
            total.append(sum(x != "" for x in lines))
            removed.append(len(gone or []))
            if gone:
                away, n, kept = set(gone), -1, []
                for x in lines:
                    n += x != ""
                    if x == "" or n not in away:
                        kept.append(x)
                t = "\n".join(kept) if any(kept) else ""
            texts.append(t)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(total, pa.int64()), pa.array(removed, pa.int64())], names=["row", "text", "n_lines", "n_removed"])


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(ord, digest, gone): line numbers to delete, of every document that loses lines."""
    keys = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64("text").alias("digest"), F.col("text").cast("string"))
    rows = keys.filter("text is not null and text <> ''").mapInArrow(_lines, "ord long, digest long, lines binary, heads array<long>")
    rows = saved(rows.dropDuplicates(["ord", "digest"]), "lines")
    me = F.struct("ord", "digest")
    held = rows.select(me.alias("later"), F.explode("heads").alias("h"))
    shared = saved(held.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    rare = held.join(shared.filter(F.col("n") <= RARE), "h").groupBy("h").agg(F.array_sort(F.collect_list("later")).alias("all"))
    few = rare.select("all", F.posexplode("all").alias("k", "later")).filter("k > 0").select("later", F.explode(F.expr("slice(all, 1, k)")).alias("earlier"))
    often = held.join(shared.filter(F.col("n") > RARE), "h").groupBy("later.ord", "later.digest").agg(F.collect_list("h").alias("often"))
    spans = rows.join(often, ["ord", "digest"]).select("ord", "digest", "lines", "often").mapInArrow(_frequent_windows, "ord long, digest long, spans array<long>")
    spans = saved(spans.select(me.alias("later"), F.explode("spans").alias("h")), "spans")
    chain = spans.join(spans.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "h")
    chain = chain.withColumn("chain", F.pmod(F.xxhash64("later", "h"), F.ceil(F.col("n") / CHAIN)))
    chain = chain.repartition(parts(docs.sparkSession), "h", "chain")  # else the chains of a window would share its task
    chain = chain.withColumn("earlier", F.lag("later").over(Window.partitionBy("h", "chain").orderBy("later")))
    heads = chain.filter("earlier is null").select("h", "later").withColumn("earlier", F.lag("later").over(Window.partitionBy("h").orderBy("later")))
    linked = chain.select("later", "earlier").union(heads.select("later", "earlier")).filter("earlier is not null")
    pairs = linked.union(few).distinct().select("later.*", F.col("earlier.ord").alias("e_ord"), F.col("earlier.digest").alias("e_digest"))
    text = rows.select("ord", "digest", "lines")
    own = pairs.join(text, ["ord", "digest"])
    other = text.select(F.col("ord").alias("e_ord"), F.col("digest").alias("e_digest"), F.col("lines").alias("e_lines"))
    met = own.join(other, ["e_ord", "e_digest"]).select("ord", "digest", "lines", "e_lines")
    gone = met.mapInArrow(_aligned, "ord long, digest long, gone array<int>").select("ord", "digest", F.explode("gone").alias("line"))
    gone = saved(gone.groupBy("ord", "digest").agg(F.collect_set("line").alias("_gone")), "gone")
    dropped(rows, shared, spans)
    return gone


def rewritten(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, as given), text, n_lines and n_removed of every row of docs."""
    gone = repeated_lines(docs)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("ord"), F.xxhash64("text").alias("digest"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(gone, ["ord", "digest"], "left").select("row", F.col("row.text").cast("string").alias("text"), "_gone")
    out = StructType([StructField("row", docs.schema), StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_removed", LongType())])
    return rows.mapInArrow(_rewritten, out)


def without_repeats(docs: DataFrame) -> DataFrame:
    """The rows of docs with text rewritten, and n_lines, n_removed."""
    new = ("n_lines", "n_removed")
    own = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in new]
    return rewritten(docs).select(*own, *new)
