"""Operator 2: n-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set holds its distinct five-word shingles, as 64-bit hashes; equal sets collapse to one node first.

1. A shingle that no other set has cannot count towards an overlap, so a set in which more than a fifth of the shingles
   are alone links with nothing and leaves. A hashed share of all shingles, in five bytes each, is enough to show that
   for most sets; what a task can tell of its own rows it does not send.
2. For the sets left, all shingles are counted exactly. Ordered rare before frequent, of n shingles the first
   n - ceil(0.8 n) + 1 are the prefix of a set, and sets that link share one of them. Shingles that are alone fill the
   prefix first and need no inverted-list entry; those that are frequent by a hint of fixed size come last.
3. Each list ties its sets to one centre, so candidates grow with the lists and not with their squares. Lists of
   frequent shingles are split by salt, and the parts' centres tied in turn.
4. A centre and a block of its candidates form one search: an inverted index over the block, the short lists merged
   on a heap, the long ones probed by bisection (DivideSkip), and sets with the required overlap retained.
5. Links give components. In lists whose sets lie in different components, pairs across components are held against
   two bounds: what is left of both sets from that shingle on, and the bits in which their parity bitmaps differ, which
   are never more than the shingles in which the sets do. Of the pairs that pass, first the nearest of each set in each
   other component is searched, then, with the components merged, all that still lie in different ones. Pairs inside a
   component need no search, which keeps large groups of near copies from growing with their squares.

Defined results: a null or empty text has n_shingles 0 and stands alone; equal texts share a component; rows with a
null doc_id have a null component_id and give no links. Extra columns are ignored. Hashes of 64 bits stand for
shingles and sets, so two that differ are taken for equal with a chance of about 2^-64 a pair.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, dropped, mix64, parts, runs, saved, segment_hashes, slices, utf8

SHINGLE, PERCENT = 5, 80
#: Shingles that the order puts last; a hint of fixed size that goes to every task.
FREQUENT = 1 << 16
#: Hashes that a task counts at once for the hint, and how often one must occur among them.
COUNTED, SEEN = 1 << 22, 4
#: Bytes of text whose shingles a task holds at once.
PORTION = 1 << 24
#: Share of all shingles, by hash, whose owners are counted over all rows.
SHARE = 0.4
#: Candidates of a centre that are searched in one block.
BLOCK = 256
#: Sets of a list that are compared in one block; longer lists are dealt as pairs of blocks.
LISTED = 4096

_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_GAP = np.zeros(256, bool)
_GAP[[32, *range(9, 14)]] = True
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of every text, given as bytes and offsets."""
    starts, ends = runs(~_GAP[data], offsets)
    words = segment_hashes(data, starts, ends, _FOLDED)
    at = np.searchsorted(starts, offsets)  # first word of each text
    if len(words) >= SHINGLE:
        m = len(words) - SHINGLE + 1
        every = words[:m] * _MULT[0]
        for k in range(1, SHINGLE):
            every += words[k : k + m] * _MULT[k]
        every = mix64(every)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(at[i]), int(at[i + 1])
        if b - a >= SHINGLE:
            out.append(np.unique(every[a : b - SHINGLE + 1]))
        elif b > a:  # the whole sequence as one
            with np.errstate(over="ignore"):
                total = np.uint64(b - a)
                for w in words[a:b]:
                    total = mix64(np.array([total * _MULT[1] + w]))[0]
            out.append(np.array([total]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(column) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = utf8(column)
    for i, j in slices(offsets):
        yield from enumerate(shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i)


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where their texts hold more than PORTION bytes; a longer text is alone."""
    for b in batches:
        for i, j in slices(utf8(b.column(column))[1], PORTION):
            yield b.slice(i, j - i)


def node_of(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that occur in SEEN different sets or more of those that a task holds at once."""
    held: list[np.ndarray] = []
    nodes: set[int] = set()
    size = 0

    def flush():
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= SEEN
        return pa.RecordBatch.from_arrays([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    for b in batches:
        for _, s in _sets(b.column(0)):
            if len(s) and (v := node_of(s)) not in nodes:
                nodes.add(v)
                held.append(s)
                size += len(s)
                if size >= COUNTED:
                    yield flush()
                    held, nodes, size = [], set(), 0
    if held:
        yield flush()


def frequent(docs: DataFrame) -> np.ndarray:
    """At most FREQUENT hashes, most common last: those above a count that a small histogram gives."""
    counts = saved(docs.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "counts")
    level = F.floor(F.log2(F.col("n").cast("double")) * 8)
    left, least = FREQUENT, None
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        left -= r["count"]
        if left < 0:
            break
        least = r["level"]
    rows = counts.filter(level >= least).orderBy("n", "h").select("h").collect() if least is not None else []
    dropped(counts)
    return np.array([r.h for r in rows], np.int64).view(np.uint64)


def allowed(n):
    """How many shingles a set of n may have that a linked set lacks; n may be a number or a Column."""
    return n - n * PERCENT // 100 - (n * PERCENT % 100 > 0)


def _grouped(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal values."""
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    return first, np.r_[first[1:], len(at)] if len(at) else first


def _five(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _told(buckets: int):
    """For each row (kind 0) doc_id, n, node, how many of its shingles are in the share, and how many of those another
    set of the batch has too. For each bucket (kind 1) the shingles of the share that one set of the batch has, by
    set, and (marked) those that several have, once."""
    limit = np.uint64(int(SHARE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, 1):
            ids, n, node, sets = b.column(0), [], [], {}
            for known, (_, s) in zip(ids.is_valid().to_pylist(), _sets(b.column(1)), strict=True):
                v = node_of(s) if len(s) else None
                n.append(len(s))
                node.append(v)
                if known and v is not None and v not in sets:  # a row without an id must not stand for one with an id
                    sets[v] = s[: int(np.searchsorted(s, limit))]
            names = np.array(list(sets), np.int64)
            sizes = np.array([len(x) for x in sets.values()], np.int64)
            h = np.concatenate([*sets.values(), np.zeros(0, np.uint64)])
            own = np.repeat(np.arange(len(names)), sizes)
            order = np.argsort(h, kind="stable")
            h, own = h[order], own[order]
            first, end = _grouped(h)
            several = np.repeat(end - first > 1, end - first)
            local = np.bincount(own[several], minlength=len(names))
            row = dict(zip(names.tolist(), zip(sizes.tolist(), local.tolist(), strict=True), strict=True))
            told = [row.get(v, (0, 0)) for v in node]
            m = len(n)
            empty = pa.nulls(m, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m, np.int32)), ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array([x[0] for x in told], pa.int64()), pa.array([x[1] for x in told], pa.int64()), pa.nulls(m, pa.int32()), empty, empty, empty, empty], names=_TOLD)
            one, many = h[~several], h[first[end - first > 1]]
            own = own[~several]
            at = ((one >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((own, at))
            one, own, at = one[order], own[order], at[order]
            at_many = ((many >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(at_many, kind="stable")
            many, at_many = many[order], at_many[order]
            used = np.union1d(at, at_many)
            lo, hi = np.searchsorted(at, used), np.searchsorted(at, used, "right")
            lo2, hi2 = np.searchsorted(at_many, used), np.searchsorted(at_many, used, "right")
            blobs: list[list[bytes]] = [[], [], [], []]
            for i, j, i2, j2 in zip(lo, hi, lo2, hi2, strict=True):
                f, e = _grouped(own[i:j])
                pieces = -(-(e - f) // 255)
                size = np.full(int(pieces.sum()), 255)
                size[np.cumsum(pieces) - 1] = (e - f) - 255 * (pieces - 1)
                blobs[0].append(np.repeat(names[own[i:j][f]], pieces).tobytes())
                blobs[1].append(size.astype("u1").tobytes())
                blobs[2].append(_five(one[i:j]))
                blobs[3].append(_five(many[i2:j2]))
            m = len(used)
            none = pa.nulls(m, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int32)), none, none, none, none, none, pa.array(used, pa.int32()), *(pa.array(x, pa.binary()) for x in blobs)], names=_TOLD)

    return run


_TOLD = ["kind", "doc_id", "n", "node", "sampled", "local", "bucket", "nodes", "counts", "hashes", "marked"]
_TOLD_TYPES = "kind int, doc_id long, n long, node long, sampled long, local long, bucket int, nodes binary, counts binary, hashes binary, marked binary"


def _shared_in(buckets: int):
    """From the entries of a bucket: how many shingles of each set another set has too, packed by the bucket of the
    set. Two shingles that agree in bucket and five bytes count as one, which can only keep a set that might have left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, k = _shared(batches)
        target = (mix64(node.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(target, kind="stable")
        node, k, target = node[order], k[order], target[order]
        first, end = _grouped(target)
        yield pa.RecordBatch.from_arrays([pa.array(target[first]), pa.array([node[i:j].tobytes() for i, j in zip(first, end, strict=True)], pa.binary()), pa.array([k[i:j].astype("<u4").tobytes() for i, j in zip(first, end, strict=True)], pa.binary())], names=["bucket", "nodes", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, k = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for b in batches:
        node += [np.frombuffer(x, "<i8") for x in b.column(0).to_pylist()]
        k += [np.frombuffer(x, "<u4") for x in b.column(1).to_pylist()]
    node, at = np.unique(np.concatenate(node), return_inverse=True)
    k = np.bincount(at, weights=np.concatenate(k), minlength=len(node)).astype(np.int64)
    for i in range(0, len(node), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(node[i : i + (1 << 16)]), pa.array(k[i : i + (1 << 16)])], names=["node", "k"])


def _shared(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    node, h, marked = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for b in batches:
        for nodes, counts, hashes, more in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            node.append(np.repeat(np.frombuffer(nodes, "<i8"), np.frombuffer(counts, "u1")))
            h.append(_from_five(hashes))
            marked.append(_from_five(more))
    node, h, marked = np.concatenate(node), np.concatenate(h), np.unique(np.concatenate(marked))
    order = np.argsort(h, kind="stable")
    node, h = node[order], h[order]
    first, end = _grouped(h)
    if not len(first):
        return node, first
    shared = np.minimum.reduceat(node, first) != np.maximum.reduceat(node, first)
    if len(marked):
        shared |= marked[np.minimum(np.searchsorted(marked, h[first]), len(marked) - 1)] == h[first]
    pick = np.repeat(shared, end - first)
    node, h = node[pick], h[pick]
    order = np.lexsort((h, node))
    node, h = node[order], h[order]
    fresh = np.r_[True, (node[1:] != node[:-1]) | (h[1:] != h[:-1])][: len(node)]
    return np.unique(node[fresh], return_counts=True)


def parities(s: np.ndarray) -> np.ndarray:
    """Whether an even or odd number of the set's hashes falls on each bit, of two bits a shingle or more, a power of two."""
    m = max(64, 1 << (2 * len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1, bitorder="little").view("<u8")


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, one a row, at a smaller size."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows that share a doc_id, those whose text has the set in question, with its parities."""
    for b in batches:
        node = b.column(0).to_pylist()
        bits = [parities(s).tobytes() if node_of(s) == v else None for v, (_, s) in zip(node, _sets(b.column(1)), strict=True)]
        bits = pa.array(bits, pa.binary())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), bits], names=["node", "text", "bits"]).filter(bits.is_valid())


_COUNT = np.dtype([("h", "<u8"), ("df", "<u4")])
_ENTRY = np.dtype([("h", "<u8"), ("rest", "<u4")])
#: Counts of frequent shingles start here; their order is the hint's.
_HEAVY = 1 << 31


_PACKED = ["bucket", "heavy", "nodes", "sizes", "counts", "body"]
_PACKED_TYPES = "bucket int, heavy boolean, nodes binary, sizes binary, counts binary, body binary"


def _packed(at: np.ndarray, heavy: bool, node: np.ndarray, n: np.ndarray, body: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket in `at`: its entries by set, with the sizes of the sets."""
    order = np.lexsort((node, at))
    at, node, n, body = at[order], node[order], n[order], body[order]
    rows = [[], [], [], [], [], []]
    for i, j in zip(*_grouped(at), strict=True):
        f, e = _grouped(node[i:j])
        for x, y in zip(rows, (int(at[i]), heavy, node[i:j][f].tobytes(), n[i:j][f].astype("<u4").tobytes(), (e - f).astype("<u4").tobytes(), body[i:j].tobytes()), strict=True):
            x.append(y)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.bool_(), *[pa.binary()] * 4), strict=True)], names=_PACKED)


def _unpacked(nodes: bytes, sizes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    times = np.frombuffer(counts, "<u4")
    return np.repeat(np.frombuffer(nodes, "<i8"), times), np.repeat(np.frombuffer(sizes, "<u4"), times)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(np.ascontiguousarray(x).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _spread(by_count: np.ndarray, buckets: int):
    """Every shingle of every set, by its bucket; the frequent ones go by the bucket of their set, with the hint's order as count."""
    rank = np.argsort(by_count)
    often = by_count[rank]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches, 1):
            sets = [s for _, s in _sets(b.column(1))]
            sizes = np.array([len(s) for s in sets], np.int64)
            h = np.concatenate([*sets, np.zeros(0, np.uint64)])
            node, n = np.repeat(np.array(b.column(0).to_pylist(), np.int64), sizes), np.repeat(sizes, sizes)
            heavy = np.zeros(len(h), bool)
            if len(often):
                near = np.minimum(np.searchsorted(often, h), len(often) - 1)
                heavy = often[near] == h
                body = np.empty(int(heavy.sum()), _COUNT)
                body["h"], body["df"] = h[heavy], _HEAVY + rank[near[heavy]]
                yield _packed(_bucket(node[heavy], buckets), True, node[heavy], n[heavy], body)
            yield _packed(_bucket(h[~heavy], buckets), False, node[~heavy], n[~heavy], h[~heavy])

    return run


def _frequencies(buckets: int):
    """From the entries of a bucket: for each set its shingles that other sets have too, with the number of sets, by the bucket of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, n, h = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.uint64)]
        for b in batches:
            for i, heavy in enumerate(b.column(1).to_pylist()):
                if heavy:  # it is in its set's bucket already
                    yield b.slice(i, 1)
                    continue
                own, size = _unpacked(*(b.column(k)[i].as_py() for k in (2, 3, 4)))
                node.append(own)
                n.append(size)
                h.append(np.frombuffer(b.column(5)[i].as_py(), "<u8"))
        node, n, h = np.concatenate(node), np.concatenate(n), np.concatenate(h)
        order = np.lexsort((node, h))
        node, n, h = node[order], n[order], h[order]
        fresh = np.r_[True, (node[1:] != node[:-1]) | (h[1:] != h[:-1])][: len(node)]  # repeated rows of one set
        node, n, h = node[fresh], n[fresh], h[fresh]
        first, end = _grouped(h)
        df = np.repeat(end - first, end - first)
        pick = df > 1
        body = np.empty(int(pick.sum()), _COUNT)
        body["h"], body["df"] = h[pick], df[pick]
        yield _packed(_bucket(node[pick], buckets), False, node[pick], n[pick], body)

    return run


def _prefixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix of every set (node, n) that can still link: its rarest shingles that other sets have, each with the
    number of those from there on, which bounds the overlap of two sets that first meet in it."""
    node, n, body = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)], [np.zeros(0, _COUNT)]
    for b in batches:
        for nodes, sizes, counts, part in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            own, size = _unpacked(nodes, sizes, counts)
            node.append(own)
            n.append(size)
            body.append(np.frombuffer(part, _COUNT))
    node, n, body = np.concatenate(node), np.concatenate(n), np.concatenate(body)
    order = np.lexsort((body["h"], body["df"], node))
    node, n, body = node[order], n[order], body[order]
    fresh = np.r_[True, (node[1:] != node[:-1]) | (body["h"][1:] != body["h"][:-1])][: len(node)]
    node, n, body = node[fresh], n[fresh], body[fresh]
    rows = [[], [], []]
    for i, j in zip(*_grouped(node), strict=True):
        size = int(n[i])
        length = (j - i) - (size - allowed(size)) + 1  # the prefix without the shingles that are alone
        if length > 0:
            entries = np.empty(length, _ENTRY)
            entries["h"], entries["rest"] = body["h"][i : i + length], np.arange(j - i, j - i - length, -1)
            for x, y in zip(rows, (int(node[i]), size, entries.tobytes()), strict=True):
                x.append(y)
        if len(rows[0]) >= 4096:
            yield _prefix_batch(rows)
            rows = [[], [], []]
    yield _prefix_batch(rows)


def _prefix_batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["node", "n", "prefix"])


_POSTING = np.dtype([("h", "<u8"), ("node", "<i8"), ("n", "<u4"), ("rest", "<u4")])


def _dealt(by_count: np.ndarray, buckets: int):
    """Inverted-list entries, packed by the bucket of their shingle; those of frequent ones are spread by set."""
    often = np.sort(by_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(2).to_pylist()
            sizes = np.array([len(x) // _ENTRY.itemsize for x in raw], np.int64)
            rows = np.empty(int(sizes.sum()), _POSTING)
            entries = np.frombuffer(b"".join(raw), _ENTRY)
            rows["h"], rows["rest"] = entries["h"], entries["rest"]
            rows["node"] = np.repeat(np.asarray(b.column(0), np.int64), sizes)
            rows["n"] = np.repeat(np.asarray(b.column(1), np.int64), sizes)
            key = rows["h"].copy()
            if len(often):
                heavy = often[np.minimum(np.searchsorted(often, key), len(often) - 1)] == key
                key[heavy] ^= mix64(np.ascontiguousarray(rows["node"][heavy]).view(np.uint64))
            at = (mix64(key) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(at, kind="stable")
            rows, at = rows[order], at[order]
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
            ends = np.r_[first[1:], len(at)] if len(at) else first
            yield pa.RecordBatch.from_arrays([pa.array(at[first]), pa.array([rows[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary())], names=["bucket", "rows"])

    return run


def _listed(by_count: np.ndarray):
    """From the entries of a bucket: (0, centre, set), (1, shingle, set) of lists that hold more pairs, (2, shingle, centre) of split lists."""
    often = np.sort(by_count)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = [x for b in batches for x in b.column(0).to_pylist()]
        if not raw:
            return
        rows = np.frombuffer(b"".join(raw), _POSTING)
        raw.clear()
        # the centre is the set of a list with the least share of shingles before this one, as it is likely to link most
        ahead = ((rows["n"].astype(np.int64) - rows["rest"]) << 20) // np.maximum(rows["n"], 1)
        rows = rows[np.lexsort((rows["node"], ahead, rows["h"]))]
        first = np.flatnonzero(np.r_[True, rows["h"][1:] != rows["h"][:-1]])
        sizes = np.diff(np.r_[first, len(rows)])
        heavy = often[np.minimum(np.searchsorted(often, rows["h"][first]), len(often) - 1)] == rows["h"][first] if len(often) else np.zeros(len(first), bool)
        keep = heavy | (sizes > 1)
        rows, sizes, heavy = rows[np.repeat(keep, sizes)], sizes[keep], heavy[keep]
        first = np.cumsum(sizes) - sizes
        centre = np.repeat(first, sizes)
        n, rest = rows["n"].astype(np.int64), rows["rest"].astype(np.int64)
        near = (_least(n, n[centre]) <= np.minimum(rest, rest[centre])) & (centre != np.arange(len(rows)))
        pairs = np.unique(np.stack([rows["node"][centre][near], rows["node"][near]], axis=1), axis=0)
        none = np.zeros(len(pairs), np.int64)
        more, top = np.repeat(heavy | (sizes > 2), sizes), first[heavy]
        h = rows["h"].view(np.int64) if rows["h"].flags.c_contiguous else np.ascontiguousarray(rows["h"]).view(np.int64)
        for kind, columns in ((0, (pairs[:, 0], pairs[:, 1], none, none)), (1, (h[more], rows["node"][more], n[more], rest[more])), (2, (h[top], rows["node"][top], n[top], rest[top]))):
            for i in range(0, len(columns[0]), 1 << 16):
                part = [pa.array(np.ascontiguousarray(x[i : i + (1 << 16)])) for x in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part[0]), kind, np.int32)), *part], names=["kind", "a", "b", "n", "rest"])

    return run


def _least(n, m):
    """The least overlap of linked sets of n and m shingles."""
    return -(-PERCENT * (n + m) // (100 + PERCENT))


class Index:
    """Inverted lists over a block of sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")  # owners ascend in each list
        every, owner = every[order], owner[order]
        first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
        self.keys, self.first, self.end, self.owner = every[first], first, np.r_[first[1:], len(every)], owner

    def search(self, query: np.ndarray) -> list[int]:
        """Sets whose Jaccard similarity with the query is PERCENT or more, by DivideSkip."""
        at = np.searchsorted(self.keys, query)
        at = at[at < len(self.keys)] if len(at) and at[-1] >= len(self.keys) else at
        at = at[self.keys[at] == query[: len(at)]]
        least = -(-PERCENT * len(query) // 100)  # overlap that any answer has
        if len(at) < least:
            return []
        lengths = self.end[at] - self.first[at]
        at = at[np.argsort(lengths, kind="stable")]
        longest = int(lengths.max())
        long = min(least - 1, int(least / (0.01 * math.log2(longest + 1) + 1)))
        lists = [self.owner[self.first[i] : self.end[i]].tolist() for i in at]
        short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
        found, last, n = [], -1, 0

        def settle(y: int, n: int) -> None:
            need = -(-PERCENT * (len(query) + self.sizes[y]) // (100 + PERCENT))
            if n < least - len(rest):
                return
            left = len(rest)
            for own in reversed(rest):  # the longest first: most likely to hold y
                if n >= need or n + left < need:
                    break
                i = bisect_left(own, y)
                n += i < len(own) and own[i] == y
                left -= 1
            if n >= need:
                found.append(y)

        for y in heapq.merge(*short):
            if y == last:
                n += 1
            else:
                if last >= 0:
                    settle(last, n)
                last, n = y, 1
        if last >= 0:
            settle(last, n)
        return found


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by centre and block, the centre first; emits the links between both."""
    key, nodes, sets = None, [], []

    def links() -> list[tuple[int, int]]:
        if len(nodes) < 2:
            return []
        # only the centre searches: pairs of its candidates that matter still meet when the components are compared
        return [(nodes[0], nodes[y]) for y in Index(sets).search(sets[0]) if y]

    def batch(found: list[tuple[int, int]]):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

    found: list[tuple[int, int]] = []
    for b in batches:
        for (_, s), a, block, node in zip(_sets(b.column(3)), *(b.column(i).to_pylist() for i in range(3)), strict=True):
            if (a, block) != key:
                found += links()
                key, nodes, sets = (a, block), [], []
                if len(found) > 10_000:
                    yield batch(found)
                    found = []
            if node not in nodes[-1:]:  # repeated rows
                nodes.append(node)
                sets.append(s)
    found += links()
    yield batch(found)


def search(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) among candidate pairs (a, b) of texts (node, text), found in blocks around each a."""
    n = parts(pairs.sparkSession)
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    member = pairs.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("int").alias("block"), F.col("b").alias("node"), F.lit(1).alias("later"))
    centre = blocks.select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("a").alias("node"), F.lit(0).alias("later"))
    rows = member.union(centre).join(texts.select("node", "text"), "node").repartition(n, "a", "block").sortWithinPartitions("a", "block", "later", "node")
    # texts are smaller than their sets in a shuffle, so they travel and the sets are made again
    return saved(rows.select("a", "block", "node", "text").mapInArrow(_searched, "a long, b long"), "links")


def _across(node: np.ndarray, n: np.ndarray, rest: np.ndarray, root: np.ndarray, ask: np.ndarray, answer: np.ndarray, bits: list[np.ndarray], best: bool) -> Iterator[tuple[int, int]]:
    """Pairs of entries ask x answer of a list that lie in different components and that the bounds let pass; with best,
    only the nearest of each set in each other component."""
    words = np.array([len(x) for x in bits])
    place = np.zeros(len(node), np.int64)
    tables = {}
    for w in np.unique(words):
        own = np.flatnonzero(words == w)
        place[own] = np.arange(len(own))
        tables[w] = np.stack([bits[i] for i in own])
    for x in ask:
        with_ = answer[(root[answer] != root[x]) & (_least(n[answer], n[x]) <= np.minimum(rest[answer], rest[x]))]
        for w in np.unique(words[with_]):
            near = with_[words[with_] == w]
            least = min(int(w), int(words[x]))
            apart = np.bitwise_count(folded(tables[w][place[near]], least) ^ folded(bits[x], least)).sum(axis=1, dtype=np.int64)
            ok = apart <= n[near] + n[x] - 2 * _least(n[near], n[x])
            near, apart = near[ok], apart[ok]
            if best and len(near):
                order = np.lexsort((node[near], apart, root[near]))
                near = near[order][_grouped(root[near][order])[0]]
            for y in near.tolist():
                yield (int(node[x]), int(node[y])) if node[x] < node[y] else (int(node[y]), int(node[x]))


def _compared(best: bool):
    """Rows come sorted by list and pair of blocks; emits the pairs that are to be searched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, seen = None, [], set()

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.int64())], names=["a", "b"])

        def pairs():
            node, n, rest, root, side = (np.array([r[i] for r in rows], np.int64) for i in range(5))
            ask, answer = (np.flatnonzero(side == i) for i in key[1:])
            return _across(node, n, rest, root, ask, answer, [np.frombuffer(r[5], "<u8") for r in rows], best)

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(9)]
            for h, lo, hi, *row in zip(*columns, strict=True):
                if (h, lo, hi) != key:
                    if rows:
                        seen.update(pairs())
                    if len(seen) > 100_000:
                        yield batch()
                        seen = set()
                    key, rows = (h, lo, hi), []
                rows.append(row)
        if rows:
            seen.update(pairs())
        yield batch()

    return run


def across(own: DataFrame, best: bool) -> DataFrame:
    """Pairs (a, b) to search, of list entries own (h, node, n, rest, root, m, bits), m the length of the list."""
    blocks = F.ceil(F.col("m") / LISTED).cast("int")
    side = own.withColumn("side", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = side.select("h", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "node", "n", "rest", "root", "side", "bits")
    dealt = dealt.repartition(parts(own.sparkSession), "h", "lo", "hi").sortWithinPartitions("h", "lo", "hi")
    return dealt.mapInArrow(_compared(best), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that links reach, for every node with a link. Large-star and small-star in turn."""
    edges = saved(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        after = saved(small, "edges")
        new, old = after.subtract(edges).isEmpty(), edges.subtract(after).isEmpty()
        dropped(edges)
        edges = after
        if new and old:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    buckets = parts(spark)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    told = saved(docs.mapInArrow(_told(buckets), _TOLD_TYPES), "told")
    sets = saved(told.filter("kind = 0").select("doc_id", "n", "node", "sampled", "local"), "sets")
    packed = told.filter("kind = 1").repartitionById(buckets, F.col("bucket")).select("nodes", "counts", "hashes", "marked").mapInArrow(_shared_in(buckets), "bucket int, nodes binary, counts binary")
    elsewhere = saved(packed.repartitionById(buckets, F.col("bucket")).select("nodes", "counts").mapInArrow(_summed, "node long, k long"), "shared")
    dropped(told)
    nodes = sets.filter("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min("sampled").alias("sampled"), F.min("local").alias("local"))
    alone = F.col("sampled") - F.col("local") - F.coalesce("k", F.lit(0))
    nodes = saved(nodes.join(elsewhere, "node", "left").filter(alone <= F.floor(F.col("n") * (100 - PERCENT) / 100)).select("node", "doc_id"), "nodes")
    # the sets left grow with the corpus: no broadcast
    texts = saved(docs.join(nodes.hint("merge"), "doc_id").select("node", "text").mapInArrow(_right, "node long, text string, bits binary"), "texts")
    dropped(elsewhere)
    often = frequent(texts.select("text"))
    body = ["nodes", "sizes", "counts", "body"]
    spread = texts.select("node", "text").mapInArrow(_spread(often, buckets), _PACKED_TYPES).repartitionById(buckets, F.col("bucket"))
    counted = spread.mapInArrow(_frequencies(buckets), _PACKED_TYPES).repartitionById(buckets, F.col("bucket"))
    prefixes = saved(counted.select(*body).mapInArrow(_prefixed, "node long, n long, prefix binary"), "prefixes")
    dealt = prefixes.mapInArrow(_dealt(often, buckets), "bucket int, rows binary")
    lists = saved(dealt.repartitionById(buckets, F.col("bucket")).select("rows").mapInArrow(_listed(often), "kind int, a long, b long, n long, rest long"), "lists")
    dropped(prefixes)

    fits = f"{100 + PERCENT} * least(x.rest, y.rest) >= {PERCENT} * (x.n + y.n)"
    split = lists.filter("kind = 2").select(F.col("a").alias("h"), F.col("b").alias("node"), "n", "rest")
    top = split.groupBy("h").agg(F.min_by(F.struct("node", "n", "rest"), F.struct(F.col("n") - F.col("rest"), "node")).alias("y")).select("h", "y.*")
    tied = split.alias("x").join(top.alias("y"), F.expr(f"x.h = y.h and x.node <> y.node and {fits}")).select(F.col("y.node").alias("a"), F.col("x.node").alias("b"))
    pairs = saved(lists.filter("kind = 0").select("a", "b").union(tied).distinct(), "pairs")
    links = search(pairs, texts)
    root = components(links)

    open_ = lists.filter("kind = 1").select(F.col("a").alias("h"), F.col("b").alias("node"), "n", "rest").distinct()
    for best in (True, False):
        own = open_.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = own.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("m")).filter("lo <> hi").select("h", "m")
        own = own.join(mixed, "h").join(texts.select("node", "bits"), "node")
        new = across(own, best)
        done = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        new = saved(new.join(done, ["a", "b"], "left_anti"), "pairs")
        if new.isEmpty():
            continue  # pairs that were searched before can hide no others
        links = saved(links.union(search(new, texts)), "links")
        root = components(links)
        pairs = saved(pairs.union(new), "pairs")

    rows = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = rows.join(first, "root", "left")
    dropped(lists, texts)
    return out.select("doc_id", "n_shingles", F.when(F.col("root").isNull() | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
