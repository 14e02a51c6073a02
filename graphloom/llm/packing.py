"""Operator 8: conflict-constrained best-fit packing of documents into sequences.

Lengths are words. Texts longer than CAPACITY are cut into pieces of CAPACITY words and a rest. Pieces are dealt to
shards of about SHARD_WORDS words by a hash, and each shard is packed by best fit, longest first: bins stand in order
of their free room, each with a bitmap of its sources and duplicate clusters; the search starts at the tightest bin
that has room and goes on to its successors until one holds neither the source nor the cluster of the piece. Without
any, a new bin opens. Blocks of successors that all hold the source, or all the cluster, are passed over at once. Bits
go to the BITS most frequent sources and clusters of a shard; for each other the bins that hold it are known.

Defined results: a text without words (or null) has one row with bin_id null and n_words 0; a null source conflicts
with nothing; texts equal in words' letters are one cluster unless a cluster column is named; ties go by doc_id, then
piece; repeated rows are pieces of one cluster; an empty table gives an empty one; a text of any length is read once
and cut. Extra columns are ignored. Memory is bounded by a shard; rows without words are not held.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, slices, utf8

CAPACITY, SHARD_WORDS = 2048, 4_000_000
#: Sources and clusters of a shard that have bits, and bins in a block of the order.
BITS, BLOCK = 2048, 256
SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id long, bin_start int"


class Bins:
    """Open bins in order of free room, then number, in blocks. A bin's bitmap has the bits of the sources and clusters it
    holds, and a block has the bits that all its bins share: the search for a successor passes over a block whose bins
    all hold the source or the cluster of the piece."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bits: list[int] = []  # of every bin, full ones too
        self.used: list[int] = []
        self.blocks: list[list[tuple[int, int]]] = []  # (free words, bin), ascending
        self.lasts: list[tuple[int, int]] = []
        self.common: list[int] = []

    def tightest(self, n: int, mask: int, barred: set[int]) -> tuple[int, int] | None:
        """Block and place of the tightest bin with n free words, no bit of the mask, and not barred."""
        first = bisect_left(self.lasts, (n, -1))
        for b in range(first, len(self.blocks)):
            if self.common[b] & mask:
                continue
            block = self.blocks[b]
            for i in range(bisect_left(block, (n, -1)) if b == first else 0, len(block)):
                k = block[i][1]
                if not self.bits[k] & mask and k not in barred:
                    return b, i
        return None

    def taken(self, at: tuple[int, int] | None) -> int:
        """The bin at a place, which is free for a new place then; a new bin if there is none."""
        if at is None:
            self.bits.append(0)
            self.used.append(0)
            return len(self.bits) - 1
        b, i = at
        block = self.blocks[b]
        _, k = block.pop(i)
        if block:
            self.lasts[b], self.common[b] = block[-1], reduce(and_, (self.bits[x] for _, x in block))
        else:
            del self.blocks[b], self.lasts[b], self.common[b]
        return k

    def put(self, k: int, n: int, mask: int) -> None:
        """n words more in bin k, which goes back to its place in the order unless it is full."""
        self.bits[k] |= mask
        self.used[k] += n
        if self.used[k] == self.capacity:
            return
        key = (self.capacity - self.used[k], k)
        if not self.blocks:
            self.blocks, self.lasts, self.common = [[key]], [key], [self.bits[k]]
            return
        b = min(bisect_left(self.lasts, key), len(self.blocks) - 1)
        block = self.blocks[b]
        insort(block, key)
        self.lasts[b] = block[-1]
        self.common[b] &= self.bits[k]
        if len(block) > 2 * BLOCK:
            halves = block[:BLOCK], block[BLOCK:]
            self.blocks[b : b + 1] = halves
            self.lasts[b : b + 1] = [x[-1] for x in halves]
            self.common[b : b + 1] = [reduce(and_, (self.bits[x] for _, x in half)) for half in halves]


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(bin, start within it) of every piece, in the order given."""
    keys = [tuple((kind, x) for kind, x in pair if x is not None) for pair in (((0, s), (1, c)) for s, c in zip(sources, clusters, strict=True))]
    # one alone conflicts with nothing; the most frequent have bits, the others a set of the few bins that hold them
    often = [(x, n) for x, n in Counter(x for own in keys for x in own).most_common() if n > 1]
    bit = {x: 1 << i for i, (x, _) in enumerate(often[:BITS])}
    seldom: dict[tuple, set[int]] = {x: set() for x, _ in often[BITS:]}
    bins = Bins(capacity)
    out = []
    for n, own in zip(lengths, keys, strict=True):
        mask = sum(bit.get(x, 0) for x in own)
        few = [seldom[x] for x in own if x in seldom]
        k = bins.taken(bins.tightest(n, mask, set().union(*few) if few else set()))
        out.append((k, bins.used[k]))
        bins.put(k, n, mask)
        for x in few:
            x.add(k)
    return out


def _measured(capacity: int):
    """Number of words of every text, as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(3))
            words = np.zeros(b.num_rows, np.int64)
            for i, j in slices(offsets):
                d, o = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                on = d > 32
                first = on.copy()
                first[1:] &= ~on[:-1]
                begin = o[:-1][o[:-1] < len(d)]
                first[begin] = on[begin]
                total = np.r_[0, np.cumsum(first)]
                words[i:j] = total[o[1:]] - total[o[:-1]]
            n = np.maximum(1, -(-words // capacity))
            row = np.repeat(np.arange(b.num_rows), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            size = np.minimum(words[row] - piece * capacity, capacity)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), b.column(2).take(take), pa.array(piece.astype(np.int32)), pa.array(size)], names=["doc_id", "source", "cluster", "piece", "n_words"])

    return run


def _packed(capacity: int):
    """Rows come sorted by shard, then longest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            places = best_fit([r[5] for r in held], [r[2] for r in held], [r[3] for r in held], capacity)
            return batch([(i, piece, piece * capacity, n, shard << 32 | k, at) for (shard, i, _, _, piece, n), (k, at) in zip(held, places, strict=True)])

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        for b in batches:
            bare = []
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not r[5]:
                    bare.append((r[1], r[4], 0, 0, None, None))
                    continue
                if held and held[0][0] != r[0]:
                    yield flush()
                    held = []
                held.append(r)
            if bare:
                yield batch(bare)
        if held:
            yield flush()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, cluster_col: str | None = None) -> DataFrame:
    """The bin and place of every piece of every document (see SCHEMA)."""
    letters = F.xxhash64(F.regexp_replace(F.lower("text"), r"\s+", " "))
    cluster = F.col(cluster_col).cast("long") if cluster_col else F.when(F.col("text").isNotNull(), letters)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), cluster.alias("cluster"), F.col("text").cast("string"))
    # about six characters a word; an estimate is enough for the number of shards
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, round(chars / 6 / SHARD_WORDS))
    pieces = rows.mapInArrow(_measured(capacity), "doc_id long, source string, cluster long, piece int, n_words long")
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)).cast("int")
    dealt = pieces.select(shard.alias("shard"), *pieces.columns).repartitionById(shards, F.col("shard")) if shards <= 4 * parts(docs.sparkSession) else pieces.select(shard.alias("shard"), *pieces.columns).repartition("shard")
    return dealt.sortWithinPartitions("shard", F.desc("n_words"), "doc_id", "piece", "source", "cluster").mapInArrow(_packed(capacity), SCHEMA)
