"""Operator 4: quality scores by Bradley-Terry ranking.

Preference pairs (a text labelled 1 over one labelled 0) teach a linear score by logistic loss on the difference of
their feature vectors. Features are shares of byte classes, word statistics and hashed byte pairs of the whole text.
The cut between classes is the quantile of training scores that parts the labels best, searched around the share of
label 0; the reported score is a logistic curve through CUT at that quantile.

The model is fitted on a bounded sample of labelled rows (SAMPLE_PER_CLASS rows a label, chosen by a hash of the id).
Defined results: a null text counts as empty and is scored like any other; without labels of both kinds every score
is 0.5. Rows are scored one by one, so repeated rows get equal results; extra columns are ignored. A doc_id with
several labels counts once for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import runs, segment_hashes, slices, utf8

#: Bound of the training sample; pairs drawn from it; steps of the fit; the score at the cut.
SAMPLE_PER_CLASS, PAIRS, EPOCHS, DECAY, CUT = 2000, 60_000, 6, 1e-4, 0.3
PAIR_BINS = 128
WORD_FEATURES = 10


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, features) of whole texts, given as bytes and offsets."""
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    size = np.maximum(lengths, 1)[:, None]
    owner = np.repeat(np.arange(n), lengths)
    single = np.bincount(owner * 128 + np.minimum(data, 127), minlength=n * 128).reshape(n, 128) / size
    pair = (data[:-1].astype(np.int64) * 31 + data[1:] * 17) % PAIR_BINS if len(data) > 1 else np.zeros(0, np.int64)
    double = np.bincount(owner[: len(pair)] * PAIR_BINS + pair, minlength=n * PAIR_BINS).reshape(n, PAIR_BINS) / size
    starts, ends = runs(data > 32, offsets)
    words = segment_hashes(data, starts, ends)
    at = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(at, minlength=n)
    some = np.maximum(count, 1)
    order = np.lexsort((words, at))
    w, a = words[order], at[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (a[1:] != a[:-1])
    first = np.flatnonzero(new)
    times = np.diff(np.r_[first, len(w)])
    most = np.zeros(n)
    np.maximum.at(most, a[first], times)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
    chars = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    share = lambda hit: np.bincount(at[hit], minlength=n) / some
    lines, line_ends = runs(data != 10, offsets)
    upper = np.bincount(owner, (data >= 65) & (data <= 90), minlength=n)
    letters = np.bincount(owner, ((data | 32) >= 97) & ((data | 32) <= 122) | (data >= 128), minlength=n)
    word = np.stack(
        [
            np.log1p(lengths) / 10,
            np.bincount(at, chars, minlength=n) / some / 10,
            np.bincount(a[first], minlength=n) / some,
            most / some,
            share(again),
            share(chars <= 3),
            share((last < 48) & (last != 46) & (last != 44) | (last > 122) & (last < 128)),
            upper / np.maximum(letters, 1),
            letters / size[:, 0],
            np.bincount(np.searchsorted(offsets, lines, "right") - 1, minlength=n) / some,
        ],
        axis=1,
    )
    return np.concatenate([word, np.sqrt(single), np.sqrt(double)], axis=1).astype(np.float32)


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight

    def share(self, x: np.ndarray) -> np.ndarray:
        """Score between 0 and 1, CUT at the cut."""
        v = np.clip(self.score(x) - self.cut, -30, 30)
        return 1 / (1 + (1 / CUT - 1) * np.exp(-v))


def fit_pairs(x: np.ndarray, y: np.ndarray, share_0: float, seed: int = 5) -> Ranker | None:
    """Fit on features and labels 0/1; share_0 is the share of label 0 among all labelled rows."""
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return None
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-3
    m = Ranker(x.mean(axis=0), scale, np.zeros(x.shape[1]), 0.0)
    z = np.clip((x - m.mean) / scale, -8, 8)
    a, b = rng.choice(good, PAIRS), rng.choice(bad, PAIRS)
    first, second, step = np.zeros_like(m.weight), np.zeros_like(m.weight), 0
    for epoch in range(EPOCHS):
        for i in range(0, PAIRS, 500):
            d = z[a[i : i + 500]] - z[b[i : i + 500]]
            p = 1 / (1 + np.exp(np.clip(d @ m.weight, -30, 30)))  # chance that the pair comes out wrong
            g = DECAY * m.weight - d.T @ p / len(d)
            step += 1
            first += 0.1 * (g - first)
            second += 0.01 * (g * g - second)
            m.weight -= 0.02 * 0.6**epoch * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    s = m.score(x)
    weight = np.where(y == 1, (1 - share_0) / len(good), share_0 / len(bad))
    order = np.argsort(s)
    below = np.cumsum(weight[order])
    best = -1.0
    for q in share_0 * np.linspace(0.5, 1.5, 41):
        i = min(max(1, int(np.searchsorted(below, q, "right"))), len(s) - 1)
        cut = (s[order[i - 1]] + s[order[i]]) / 2
        right = ((s[good] >= cut).mean() + (s[bad] < cut).mean()) / 2
        if right > best:
            best, m.cut = right, float(cut)
    return m


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(0))
        for i, j in slices(offsets):
            x = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), b.column(1).slice(i, j - i)], names=["x", "quality"])


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column) -> Ranker | None:
    """Train on labelled rows that `learn` admits (an expression over doc_id)."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).filter(F.col("quality").isin(0, 1) & learn)
    counts = {r[0]: r[1] for r in known.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return None
    part = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 20)) / float(1 << 20)
    keep = F.lit(False)
    for label, n in counts.items():
        keep |= (F.col("quality") == label) & (part < min(1.0, SAMPLE_PER_CLASS / n))
    # bounded by 2 * SAMPLE_PER_CLASS rows on average, so that a broadcast is safe at every size
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(known.filter(keep)), "doc_id").select(F.coalesce("text", F.lit("")), "quality")
    got = sorted((r.x, r.quality) for r in rows.mapInArrow(_featured, "x binary, quality int").collect())
    if not got:
        return None
    x = np.stack([np.frombuffer(bytes(r[0]), np.float32) for r in got])
    return fit_pairs(x, np.array([r[1] for r in got]), counts[0] / (counts[0] + counts[1]))


def _scored(m: Ranker | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            score = np.full(b.num_rows, 0.5)
            if m is not None:
                for i, j in slices(offsets):
                    score[i:j] = m.share(features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted; learns only labels of rows that are not held out."""
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = fit(docs, labels, ~out)
    rows = docs.select(F.col("doc_id").cast("long"), out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double, predicted int")
