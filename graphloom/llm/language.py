"""Operator 6: language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on a bounded sample of labelled texts (SAMPLE_PER_LANG texts a
language, one window each; short texts and the rest of every text are padded, and padding has no label). Whole texts are cut into windows of WINDOW bytes, all of which the network reads in both
directions; a softmax labels every byte position and a document's probabilities are the mean over its positions.

Defined results: a null text, or one without a letter, has `und` with score 0; with nothing to learn from (an empty
table, no labels) every prediction is `und` with score 0. Ties go to the language that sorts first. Rows are
predicted one by one, so repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SLICE_BYTES, slices, utf8

#: Bounds of the training sample: texts a language, and code points of the one window taken of a text.
SAMPLE_PER_LANG, SAMPLE_CHARS = 400, 384
#: Network and training.
HIDDEN, WINDOW, EPOCHS, BATCH, RATE = 6, 64, 4, 256, 0.02
#: Fewest windows of a step and steps of a training on a small sample.
LEAST_BATCH, LEAST_STEPS = 16, 160
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Direction:
    """Weights of one direction: byte table (256, 3H), recurrent (H, 3H), bias of the candidate's recurrent part (H)."""

    table: np.ndarray
    recur: np.ndarray
    bias: np.ndarray


@dataclass
class Model:
    langs: list[str]
    forward: Direction
    backward: Direction
    out: np.ndarray
    out_bias: np.ndarray


def _direction(rng: np.random.Generator) -> Direction:
    return Direction(rng.normal(0, 0.3, (256, 3 * HIDDEN)).astype(np.float32), rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(np.float32), np.zeros(HIDDEN, np.float32))


def states(x: np.ndarray, d: Direction, keep: dict | None = None) -> np.ndarray:
    """Hidden states (T, B, H) for bytes (T, B), time ascending. keep: gets what training needs."""
    steps, lanes = x.shape
    h = np.zeros((lanes, HIDDEN), np.float32)
    out = np.empty((steps, lanes, HIDDEN), np.float32)
    halves = np.r_[np.full(2 * HIDDEN, 0.5), np.ones(HIDDEN)].astype(np.float32)  # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
    table, recur = d.table * halves, d.recur * halves
    gates = np.empty((steps, lanes, 2 * HIDDEN), np.float32) if keep is not None else None
    cand, pre = (np.empty((2, steps, lanes, HIDDEN), np.float32)) if keep is not None else (None, None)
    u = np.empty((lanes, 3 * HIDDEN), np.float32)
    for t in range(steps):
        a = table.take(x[t], axis=0)
        np.matmul(h, recur, out=u)
        g = a[:, : 2 * HIDDEN]
        g += u[:, : 2 * HIDDEN]
        np.tanh(g, out=g)
        g *= 0.5
        g += 0.5
        m = u[:, 2 * HIDDEN :]
        m += d.bias
        if keep is not None:
            gates[t], pre[t] = g, m
        n = a[:, 2 * HIDDEN :]
        m *= g[:, :HIDDEN]
        n += m
        np.tanh(n, out=n)
        if keep is not None:
            cand[t] = n
        # h = n + z * (h - n)
        h = h - n
        h *= g[:, HIDDEN:]
        h += n
        out[t] = h
    if keep is not None:
        keep |= {"gates": gates, "cand": cand, "pre": pre}
    return out


def _back(x: np.ndarray, d: Direction, hs: np.ndarray, kept: dict, dout: np.ndarray) -> Direction:
    """Gradients by backpropagation through time; dout (T, B, H) is the loss by hidden state."""
    steps, lanes = x.shape
    gt, gr, gb = np.zeros_like(d.table), np.zeros_like(d.recur), np.zeros_like(d.bias)
    da = np.empty((steps, lanes, 3 * HIDDEN), np.float32)
    dh = np.zeros((lanes, HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        before = hs[t - 1] if t else np.zeros((lanes, HIDDEN), np.float32)
        r, z = kept["gates"][t, :, :HIDDEN], kept["gates"][t, :, HIDDEN:]
        n, m = kept["cand"][t], kept["pre"][t]
        dh = dh + dout[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (before - n) * z * (1 - z)
        dr = dn * m * r * (1 - r)
        du = np.concatenate([dr, dz, dn * r], axis=1)
        da[t] = np.concatenate([dr, dz, dn], axis=1)
        gr += before.T @ du
        gb += du[:, 2 * HIDDEN :].sum(axis=0)
        dh = dh * z + du @ d.recur.T
    flat, rows = x.reshape(-1), da.reshape(-1, 3 * HIDDEN)
    order = np.argsort(flat, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(flat[order]) != 0])
    gt[flat[order][at]] = np.add.reduceat(rows[order], at, axis=0)
    return Direction(gt, gr, gb)


def _softmax(v: np.ndarray) -> np.ndarray:
    v = np.exp(v - v.max(axis=-1, keepdims=True))
    return v / v.sum(axis=-1, keepdims=True)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model | None:
    """Fit on windows of the given texts, every position labelled with the text's language."""
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    windows, target, size = [], [], []
    for text, lang in zip(texts, labels, strict=True):
        raw = _FOLD[np.frombuffer(text.encode(), np.uint8)]
        for i in range(0, len(raw), WINDOW):
            own = raw[i : i + WINDOW]
            windows.append(np.pad(own, (0, WINDOW - len(own)), constant_values=32))
            target.append(langs.index(lang))
            size.append(len(own))
    if not windows:
        return None
    data, y, c, size = np.stack(windows), np.array(target), len(langs), np.array(size)
    m = Model(langs, _direction(rng), _direction(rng), rng.normal(0, 0.3, (2 * HIDDEN, c)).astype(np.float32), np.zeros(c, np.float32))
    weights = [m.forward.table, m.forward.recur, m.forward.bias, m.backward.table, m.backward.recur, m.backward.bias, m.out, m.out_bias]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    share = np.bincount(y, size, minlength=c) / size.sum()
    weight = (1 / (c * np.maximum(share[y], 1e-9))).astype(np.float32)  # the positions of languages count alike
    # a small sample is read more often, in smaller parts
    batch = int(np.clip(len(data) // 8, LEAST_BATCH, BATCH))
    epochs = max(EPOCHS, -(-LEAST_STEPS // -(-len(data) // batch)))
    for epoch in range(epochs):
        order = rng.permutation(len(data))
        for i in range(0, len(order), batch):
            pick = order[i : i + batch]
            x = np.ascontiguousarray(data[pick].T)
            kf: dict = {}
            kb: dict = {}
            hf, hb = states(x, m.forward, kf), states(x[::-1], m.backward, kb)
            both = np.concatenate([hf, hb[::-1]], axis=2)
            p = _softmax(both @ m.out + m.out_bias)
            p[:, np.arange(len(pick)), y[pick]] -= 1
            p *= (weight[pick] / (len(pick) * WINDOW))[None, :, None]
            p *= (np.arange(WINDOW)[:, None] < size[pick])[:, :, None]  # what pads a window has no language
            dboth = p @ m.out.T
            gf = _back(x, m.forward, hf, kf, dboth[:, :, :HIDDEN])
            gb = _back(x[::-1], m.backward, hb, kb, dboth[::-1, :, HIDDEN:])
            grads = [gf.table, gf.recur, gf.bias, gb.table, gb.recur, gb.bias, both.reshape(-1, 2 * HIDDEN).T @ p.reshape(-1, c), p.sum(axis=(0, 1))]
            step += 1
            rate = RATE * 0.5 ** (EPOCHS * epoch / epochs)
            for w, g, a, b in zip(weights, grads, first, second, strict=True):  # Adam
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return m


#: Windows that the network reads side by side, fewer with more languages than LANGS.
LANES, LANGS = 1024, 64


class Reader:
    """The trained network laid out for reading: gates by rows, windows by columns, both directions in one step."""

    def __init__(self, m: Model):
        h, f, b = HIDDEN, m.forward, m.backward
        half = np.r_[np.full(2 * h, 0.5), np.ones(h)].astype(np.float32)[:, None]  # sigmoid(v) = tanh(v / 2) / 2 + 1 / 2
        self.tables = [np.ascontiguousarray(d.table.T * half) for d in (f, b)]
        self.recur = np.zeros((6 * h, 2 * h), np.float32)  # rows: r, z, candidate, each of both directions
        for k, d in enumerate((f, b)):
            for gate in range(3):
                rows = slice((2 * gate + k) * h, (2 * gate + k + 1) * h)
                self.recur[rows, k * h : (k + 1) * h] = (d.recur.T * half)[gate * h : (gate + 1) * h]
        self.bias = np.concatenate([f.bias, b.bias])[:, None]
        self.out, self.out_bias, self.langs = np.ascontiguousarray(m.out.T), m.out_bias[:, None], m.langs

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Language probabilities (T, langs, B) at every position of bytes x (T, B)."""
        h = HIDDEN
        steps, lanes = x.shape
        logits = np.empty((steps, len(self.langs), lanes), np.float32)
        logits[:] = self.out_bias
        state, u, a = np.zeros((2 * h, lanes), np.float32), np.empty((6 * h, lanes), np.float32), np.empty((6 * h, lanes), np.float32)
        for t in range(steps):
            for k, at in ((0, x[t]), (1, x[steps - 1 - t])):
                for gate in range(3):
                    np.take(self.tables[k][gate * h : (gate + 1) * h], at, axis=1, out=a[(2 * gate + k) * h : (2 * gate + k + 1) * h], mode="clip")
            np.matmul(self.recur, state, out=u)
            g, n, m = a[: 4 * h], a[4 * h :], u[4 * h :]
            g += u[: 4 * h]
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            m += self.bias
            m *= g[: 2 * h]
            n += m
            np.tanh(n, out=n)
            state -= n
            state *= g[2 * h :]
            state += n
            logits[t] += self.out[:, :h] @ state[:h]
            logits[steps - 1 - t] += self.out[:, h:] @ state[h:]
        np.clip(logits, -30, 30, out=logits)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits


def predict(data: np.ndarray, offsets: np.ndarray, read: Reader) -> np.ndarray:
    """Mean position probabilities (rows, langs) of whole texts, given as bytes and offsets."""
    n, c = len(offsets) - 1, len(read.langs)
    lengths = np.diff(offsets)
    each = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(n), each)
    start = offsets[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
    end = offsets[owner + 1] if n else start
    total = np.zeros((n, c))
    data = _FOLD[data]
    lanes = max(1, LANES * LANGS // max(c, LANGS))
    for i in range(0, len(owner), lanes):
        s, e = start[i : i + lanes], end[i : i + lanes]
        at = s + np.arange(WINDOW)[:, None]
        real = at < e
        x = data[np.minimum(at, e - 1)].astype(np.intp)
        x[~real] = 32
        v = read(x)
        v *= real[:, None, :]
        np.add.at(total, owner[i : i + lanes], v.sum(axis=0).T)
    return total / np.maximum(lengths, 1)[:, None]


def fit(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Train on a bounded sample, alike for every language: the rows that `learn` admits, chosen by a hash of the id."""
    rows = docs.filter(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = [(r[0], SAMPLE_PER_LANG / r[1]) for r in rows.groupBy(F.col(lang_col).cast("string")).count().collect()]
    if not counts:
        return None
    share = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    rates = F.broadcast(docs.sparkSession.createDataFrame(counts, "_lang string, _rate double"))
    offset = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.greatest(F.length(text_col) - SAMPLE_CHARS, F.lit(1))) + 1
    window = F.col(text_col).substr(offset.cast("int"), F.lit(SAMPLE_CHARS))
    # the ids are counted above, so this stays near SAMPLE_PER_LANG rows a language
    rows = rows.join(rates, F.col(lang_col).cast("string") == F.col("_lang")).filter(share < F.col("_rate"))
    got = rows.select(F.col("_lang").alias("lang"), window.alias("text"), F.col(id_col).cast("string").alias("id")).collect()
    got = sorted(got, key=lambda r: (r.id or "", r.text))
    return train([r.text for r in got], [r.lang for r in got])


def has_letter(text_col: str = "text") -> F.Column:
    return F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))


def _labelled(m: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = Reader(m) if m is not None else None
        for b in batches:
            data, offsets = utf8(b.column("_text"))
            lang, score = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows)
            if read is not None:
                for i, j in slices(offsets, SLICE_BYTES * LANGS // max(len(m.langs), LANGS)):
                    p = predict(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], read)
                    best = p.argmax(axis=1)
                    lang[i:j], score[i:j] = np.array(m.langs, object)[best], p[np.arange(j - i), best]
            none = ~np.asarray(b.column("_letter").fill_null(False))
            lang[none], score[none] = UNKNOWN, 0.0
            kept = [x for x in b.schema.names if x not in ("_text", "_letter")]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in kept), pa.array(lang, pa.string()), pa.array(np.minimum(score, 1.0), pa.float64())], names=[*kept, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keep` with lang_pred and score. The model goes along with the tasks; its size is fixed."""
    rows = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text"), has_letter(text_col).alias("_letter"))
    kinds = T.StructType([*docs.select(*keep).schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_labelled(model), kinds)


def held_out(id_col: str = "doc_id", folds: int = 4, fold: int = 2) -> F.Column:
    return F.crc32(F.col(id_col).cast("string")) % folds == fold


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns only from the rows that are not held out."""
    out = held_out()
    model = fit(docs, F.coalesce(~out, F.lit(False)))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    return identify(rows, model, ["doc_id", "held_out"])
