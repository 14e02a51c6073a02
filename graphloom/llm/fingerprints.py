"""Operator 1: document fingerprints as invertible Bloom lookup tables (IBLT).

A text is a multiset of paragraphs (cut at newlines, and at sentence ends so that a text of one block has
more than one cell entry). Every paragraph digest goes into one cell of each of three sub-tables; a cell holds a
count, the xor of its digests and the xor of their check values. Two sketches of equal size subtract cell by cell;
peeling pure cells recovers the differing digests. Where peeling stalls, both versions are sketched again with
twice the cells and other seeds, until it ends.

Defined results: a null text counts as empty; equal texts have equal fingerprints; two texts without paragraphs
have likeness 1; repeated paragraphs count as often as they occur; a null doc_id stands last in the order; rows of
one doc_id are ordered by text. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE_BYTES, mix64, parts, runs, segment_hashes, utf8

#: Cells of the sketch that is the fingerprint; a multiple of three.
CELLS = 24
#: Doublings after which the difference is taken digest by digest. Peeling ends long before for any text seen.
LEVELS = 26
BATCH_ROWS = 512

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"


def paragraph_digests(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(digest, text number) of every paragraph; the k-th equal paragraph of a text has a digest of its own."""
    data, offsets = utf8(pa.array(texts, pa.large_string()))
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = data != 10
    stop = (data == 46) | (data == 33) | (data == 63)
    space = (data[1:] == 32) & stop[:-1]
    inside[1:][space] = False  # the space after a full stop parts two sentences
    starts, ends = runs(inside, offsets)
    keys = segment_hashes(data, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    new = np.r_[True, (k[1:] != k[:-1]) | (o[1:] != o[:-1])] if len(k) else np.zeros(0, bool)
    at = np.arange(len(k))
    nth = at - np.maximum.accumulate(np.where(new, at, 0)) if len(k) else at
    return mix64(k + nth.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), o


def check_of(keys: np.ndarray) -> np.ndarray:
    return mix64(keys ^ np.uint64(0x5851F42D4C957F2D))


def cells_of(keys: np.ndarray, owner: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of every digest, as indices in a table of `cells` per owner."""
    third = cells // 3
    out = np.empty((3, len(keys)), np.int64)
    for j in range(3):
        out[j] = owner * cells + j * third + (mix64(keys + np.uint64((cells * 8 + j + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(third)).astype(np.int64)
    return out


class Sketches:
    """One IBLT for each of n texts."""

    def __init__(self, n: int, cells: int):
        self.n, self.cells = n, cells
        self.count = np.zeros(n * cells, np.int64)
        self.keys = np.zeros(n * cells, np.uint64)
        self.checks = np.zeros(n * cells, np.uint64)

    def add(self, keys: np.ndarray, owner: np.ndarray, sign: np.ndarray | int = 1) -> None:
        checks = check_of(keys)
        for at in cells_of(keys, owner, self.cells):
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.keys, at, keys)
            np.bitwise_xor.at(self.checks, at, checks)

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.n, self.cells)
        out.count, out.keys, out.checks = self.count - other.count, self.keys ^ other.keys, self.checks ^ other.checks
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Digests only in the first, digests only in the second, and whether the peeling ended, for each text."""
        plus, less = np.zeros(self.n, np.int64), np.zeros(self.n, np.int64)
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[check_of(self.keys[pure]) == self.checks[pure]]
            if not len(pure):
                break
            owner, keys, sign = pure // self.cells, self.keys[pure], self.count[pure]
            order = np.lexsort((keys, owner))
            owner, keys, sign = owner[order], keys[order], sign[order]
            one = np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]
            owner, keys, sign = owner[one], keys[one], sign[one]
            np.add.at(plus, owner[sign > 0], 1)
            np.add.at(less, owner[sign < 0], 1)
            self.add(keys, owner, -sign)
        left = ((self.count != 0) | (self.keys != 0) | (self.checks != 0)).reshape(self.n, self.cells).any(axis=1)
        return plus, less, ~left

    def text(self, n_keys: np.ndarray) -> list[str]:
        packed = np.empty((self.n * self.cells, 14), np.uint8)
        packed[:, :2] = self.count.astype("<u2").view(np.uint8).reshape(-1, 2)
        packed[:, 2:10] = self.keys.astype("<u8").view(np.uint8).reshape(-1, 8)
        packed[:, 10:] = (self.checks >> np.uint64(32)).astype("<u4").view(np.uint8).reshape(-1, 4)
        rows = packed.reshape(self.n, -1)
        return [f"iblt{self.cells}:{n}:{base64.b64encode(r.tobytes()).decode()}" for n, r in zip(n_keys.tolist(), rows, strict=True)]


def sketched(digests: tuple[np.ndarray, np.ndarray], n: int, cells: int = CELLS) -> Sketches:
    out = Sketches(n, cells)
    out.add(*digests)
    return out


def likeness(first: tuple[np.ndarray, np.ndarray], second: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """Share of common digests in all digests of both texts, for n pairs of texts, by subtracting and peeling."""
    counts = [np.bincount(owner, minlength=n) for _, owner in (first, second)]
    plus, less = np.zeros(n, np.int64), np.zeros(n, np.int64)
    open_, cells = np.arange(n), CELLS
    for _ in range(LEVELS):
        if not len(open_):
            break
        place = np.full(n, -1)
        place[open_] = np.arange(len(open_))
        a, b = ((keys[place[owner] >= 0], place[owner][place[owner] >= 0]) for keys, owner in (first, second))
        p, m, done = sketched(a, len(open_), cells).minus(sketched(b, len(open_), cells)).peel()
        plus[open_[done]], less[open_[done]] = p[done], m[done]
        open_, cells = open_[~done], 2 * cells
    for i in open_.tolist():
        a, b = first[0][first[1] == i], second[0][second[1] == i]
        plus[i], less[i] = len(np.setdiff1d(a, b)), len(np.setdiff1d(b, a))
    common = counts[0] - plus
    union = common + plus + less
    return np.where(union == 0, 1.0, common / np.maximum(union, 1))


def versions(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows for texts and the texts that follow them."""
    edited = []
    for t, f in zip(texts, following, strict=True):
        k = len(t) // 3
        edited.append(t[: len(t) - k] + f[:k])
    n = len(texts)
    own, new, nxt = (paragraph_digests(x) for x in (texts, edited, following))
    n_own, n_new = np.bincount(own[1], minlength=n), np.bincount(new[1], minlength=n)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
            pa.array(sketched(own, n).text(n_own), pa.string()),
            pa.array(sketched(new, n).text(n_new), pa.string()),
            pa.array(likeness(own, new, n), pa.float64()),
            pa.array(likeness(own, nxt, n), pa.float64()),
            pa.array(n_own, pa.int64()),
        ],
        names=[x.split()[0] for x in SCHEMA.split(", ")],
    )


def _placed(starts: np.ndarray):
    """Deal rows to the bucket of their id; the first id of a bucket also goes to the bucket before, as look-ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up, n = starts[::-1], len(starts)
        for b in batches:
            null = np.asarray(b.column(0).is_null())
            ids = np.asarray(b.column(0).fill_null(0), np.int64)
            at = n - 1 - np.searchsorted(up, ids, "left") if n else np.zeros(len(ids), np.int64)
            at = np.where(null, max(n - 1, 0), np.clip(at, 0, max(n - 1, 0)))
            ahead = np.flatnonzero(~null & (starts[at] == ids)) if n else np.zeros(0, np.int64)
            rows = pa.array(np.r_[np.arange(len(ids)), ahead])
            place = np.r_[at, (at[ahead] - 1) % max(n, 1)].astype(np.int32)
            look = np.r_[np.zeros(len(ids), bool), np.ones(len(ahead), bool)]
            yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(look), b.column(0).take(rows), b.column(1).take(rows)], names=["place", "look", "doc_id", "text"])

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; each is compared with the row after it, the last of a bucket with its look-ahead."""
    held: list[tuple] = []  # rows whose successor is known to be the next element
    first, place, closed, size = None, None, False, 0

    def flush(keep_last: bool):
        rows = held[:-1] if keep_last else held
        if rows:
            yield versions([r[0] for r in rows], [r[1] for r in rows], [r[1] for r in held[1:]] if keep_last else [r[1] for r in [*held[1:], first]])

    for b in batches:
        places, looks = b.column(0).to_pylist(), b.column(1).to_pylist()
        ids, texts = b.column(2).to_pylist(), b.column(3).to_pylist()
        for p, look, i, t in zip(places, looks, ids, texts, strict=True):
            t = t or ""
            if p != place:
                if held and not closed:
                    yield from flush(False)
                held, first, place, closed, size = [], (i, t), p, False, 0
            if closed:
                continue
            held.append((i, t))
            size += 4 * len(t)
            if look:
                yield from flush(True)
                held, closed = [], True
            elif len(held) > BATCH_ROWS or size > 4 * SLICE_BYTES:
                yield from flush(True)
                held, size = held[-1:], 4 * len(t)
    if held and not closed:
        yield from flush(False)


def document_versions(docs: DataFrame) -> DataFrame:
    """Fingerprint every text and its edited version (see SCHEMA). One shuffle of the texts, by ranges of doc_id."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    k = parts(spark)
    cut = docs.agg(F.max("doc_id"), F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 20 * k + 1000)).first()
    starts = np.array(sorted({x for x in [cut[0], *(cut[1] or [])] if x is not None}, reverse=True), np.int64)
    dealt = docs.mapInArrow(_placed(starts), "place int, look boolean, doc_id long, text string").repartitionById(max(1, len(starts)), F.col("place"))
    return dealt.sortWithinPartitions("place", "look", F.desc_nulls_last("doc_id"), "text").mapInArrow(_compared, SCHEMA)
