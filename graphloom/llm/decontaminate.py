"""Operator 3: benchmark decontamination by pigeonhole edit matching.

Texts are compared in lower case with every run of other characters than letters and digits as one space, and a space at
both ends, so that items match whole words and a word boundary that is missing is an edit. An item of m characters has
an error budget of k = RATE * m edits, whatever its length, and is split into k + 1 pieces, of which one at least
survives any k edits; pieces are found exactly with one automaton, and each hit is verified with Myers' bit-parallel
distance in the window that the item could fill. An item that a text holds at several places gives one row, with the
nearest place; of equally near ones, the first.

Benchmarks go to the tasks in blocks of at most BLOCK_CHARS characters, one pass over the documents for each.

Defined results: null or empty texts and items match nothing; repeated items match each for itself; repeated rows get
equal results; empty tables give empty ones; a text is searched in one piece, however long. Extra columns are kept by
`clean` and ignored by `contaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 0.06
BLOCK_CHARS = 8_000_000

_OTHER = re.compile(r"[\W_]+")
_ITEM = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """Lower case, other characters as single spaces, with a space at both ends."""
    return f" {_OTHER.sub(' ', text.lower()).strip()} "


def within(pattern_bits: dict[str, int], m: int, window: str, k: int) -> tuple[int, int] | None:
    """Least distance of the pattern to any part of the window, if k or less, and the end of the first such part."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    get = pattern_bits.get
    for i, c in enumerate(window):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        if score <= k and (best is None or score < best[0]):
            best = (score, i + 1)
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best


def bits(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    """Pieces of all items in one automaton."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items: list[tuple[int, str, int, dict[str, int], dict[str, int]]] = []
        self.auto = ahocorasick.Automaton()
        for item_id, text in items:
            body = plain(text)
            if not body.strip():
                continue
            m, k = len(body), int(RATE * len(body.strip()))
            number = len(self.items)
            self.items.append((item_id, body, k, bits(body), bits(body[::-1])))
            for j in range(k + 1):
                a, b = j * m // (k + 1), (j + 1) * m // (k + 1)
                self.auto.add_word(body[a:b], [*self.auto.get(body[a:b], []), (number, a)])
        if self.items:
            self.auto.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, distance, start, end) in the plain text, the best place of each item found."""
        if not self.items:
            return []
        starts: dict[int, set[int]] = {}
        for end, hits in self.auto.iter(text):
            # each piece knows its place in its item: hits of one item on near diagonals share a window
            for number, at in hits:
                starts.setdefault(number, set()).add(end - at)
        found = []
        for number, ends in starts.items():
            _, body, k, forward, backward = self.items[number]
            m, best, done = len(body), None, -1
            for d in sorted(ends):
                # d is where the hit piece ends, less its place: the item begins within k of d - (length of the piece) + 1
                lo, hi = max(0, d - m // (k + 1) - k), min(len(text), d + m + k + 1)
                if hi <= done:
                    continue
                done = hi
                got = within(forward, m, text[lo:hi], k)
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], lo + got[1])
            if best:
                # the same search from the end backwards gives where the part begins
                distance, end = best
                back = within(backward, m, text[max(0, end - m - k) : end][::-1], distance)
                start = end - (back[1] if back else m)
                found.append((number, distance, start + text.startswith(" ", start), end - text.startswith(" ", end - 1)))
        return found


def _original(text: str, start: int, end: int) -> tuple[int, int]:
    """A place in the plain text as a place in the text itself. Lower case may be longer than the letter it is of."""
    at = []
    low = [(c, i) for i, ch in enumerate(text) for c in ch.lower()]
    joined = "".join(c for c, _ in low)
    first = True
    at.append(0)
    for m in _ITEM.finditer(joined):
        if not first:
            at.append(low[m.start() - 1][1])
        first = False
        at.extend(low[j][1] for j in range(m.start(), m.end()))
    at.append(len(text))
    own = at[start:end]
    return (own[0], own[-1] + 1) if own else (0, 0)


def blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items in blocks of bounded size, each read on its own."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter("text is not null and text <> ''")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // BLOCK_CHARS)
    for i in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield sorted(((r[0], r[1]) for r in part.collect()), key=lambda x: (x[0] is None, x))


def _matches(items: list[tuple[int, str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(items)
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and (found := m.search(plain(t))):
                    out += [(i, m.items[n][0], d, *_original(t, s, e)) for n, d, s, e in found]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "distance", "start", "end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance and place (code points, end exclusive) of every document and item that it contains."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, distance long, start long, end long"
    out = None
    for items in blocks(benchmark):
        part = rows.mapInArrow(_matches(items), schema)
        out = part if out is None else out.union(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _without(items: list[tuple[int, str]], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(items)
        for b in batches:
            yield b.filter(pa.array([not (t and m.search(plain(t))) for t in b.column(at).to_pylist()], pa.bool_()))

    return run


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item."""
    # the columns go along as one, whatever their names
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.col("text").cast("string").alias("text"))
    for items in blocks(benchmark):
        rows = rows.mapInArrow(_without(items, 1), rows.schema)
    return rows.select("doc.*")
