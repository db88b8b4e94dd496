"""Quality rules: base counts and a calibrated logistic regression over hashed word and character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffer_of, pieces, utf8
from .textstats import PIECE, Batch, base_counts

BITS = 15
GROUPS = 3  # character 4-grams, words, word pairs
SIZE = GROUPS << BITS
SCALE = 60.0
#: Pairs of sparse rows that one step of the fit holds as doubles.
BLOCK = 1 << 18


class Limits(NamedTuple):
    """Fixed thresholds: words at least, repeated words in per cent at most, probability at least."""

    least_words: int = 50
    repeat_percent: int = 50
    least_probability: float = 0.5


class Model(NamedTuple):
    """Hashed weights, bias, and the calibration's slope and intercept."""

    weights: np.ndarray
    bias: float
    slope: float
    intercept: float


def gram_hashes(x: Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each group (document of each gram, feature index); grams never cross documents."""
    n = len(x.b)
    out = []
    if n >= 4:
        w = x.b.astype(np.uint32)
        code = ((w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]) * np.uint32(2654435761)
        doc = np.repeat(np.arange(x.docs, dtype=np.int32), np.diff(x.offs))
        inside = doc[:-3] == doc[3:]
        out.append((doc[:-3][inside], (code >> np.uint32(32 - BITS)).astype(np.int64)[inside]))
    else:
        out.append((np.zeros(0, np.int32), np.zeros(0, np.int64)))
    h = x.words()
    doc = np.repeat(np.arange(x.docs, dtype=np.int32), x.n_words)
    out.append((doc, (h >> np.uint64(64 - BITS)).astype(np.int64) + (1 << BITS)))
    at, pair = x.windows(h, 2)
    pair[h[at] == h[at + 1]] = 0  # a word said twice is one feature, whatever the word
    out.append((doc[at], (pair >> np.uint64(64 - BITS)).astype(np.int64) + (2 << BITS)))
    return out


def margins(x: Batch, weights: np.ndarray, bias: float) -> np.ndarray:
    """The sum over groups of the mean weight of a document's grams."""
    out = np.full(x.docs, bias)
    for doc, idx in gram_hashes(x):
        if len(doc):
            total = np.bincount(doc, weights[idx], minlength=x.docs)
            out += SCALE * total / np.maximum(np.bincount(doc, minlength=x.docs), 1)
    return out


def features(x: Batch) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows (index, value) whose product with the weights is the margin."""
    groups = gram_hashes(x)
    out = []
    for d in range(x.docs):
        idx, val = [], []
        for doc, i in groups:
            a, b = np.searchsorted(doc, (d, d + 1))
            if b > a:
                u, c = np.unique(i[a:b], return_counts=True)
                idx.append(u)
                val.append(c * (SCALE / (b - a)))
        out.append((np.concatenate(idx).astype(np.int32) if idx else np.zeros(0, np.int32), np.concatenate(val).astype(np.float32) if val else np.zeros(0, np.float32)))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, where=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``most`` labelled rows, those of the smallest id hashes: label and text bytes."""
    some = labels.select(F.col(id_col).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null")
    some = some.where(where) if where is not None else some
    some = some.orderBy(F.xxhash64("k"), "k", "y").limit(most)
    return docs.select(F.col(id_col).alias("k"), utf8(text_col).alias("raw")).join(F.broadcast(some), "k").select("y", "raw", "k")


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Sparse(NamedTuple):
    """Rows of (index, value) pairs, one after another; products go over ``BLOCK`` pairs or a row at a time."""

    starts: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.starts) - 1)
        for lo, hi in pieces(self.starts, BLOCK):
            at = slice(self.starts[lo], self.starts[hi])
            of = np.repeat(np.arange(hi - lo), np.diff(self.starts[lo : hi + 1]))
            out[lo:hi] = np.bincount(of, w[self.idx[at]] * self.val[at], minlength=hi - lo)
        return out

    def transposed_times(self, g: np.ndarray) -> np.ndarray:
        out = np.zeros(SIZE)
        for lo, hi in pieces(self.starts, BLOCK):
            at = slice(self.starts[lo], self.starts[hi])
            out += np.bincount(self.idx[at], self.val[at] * np.repeat(g[lo:hi], np.diff(self.starts[lo : hi + 1])), minlength=SIZE)
        return out


def fit_logistic(x: Sparse, y: np.ndarray, steps: int = 60, rate: float = 0.3, l2: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights of sparse rows by Adam over all rows, the classes weighing alike."""
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, b = np.zeros(SIZE), 0.0
    m1, m2, c1, c2 = np.zeros(SIZE), np.zeros(SIZE), 0.0, 0.0
    for k in range(1, steps + 1):
        g = (_sigmoid(x.times(w) + b) - y) * share
        gw = x.transposed_times(g) + l2 * w
        gb = g.sum()
        m1, m2 = 0.9 * m1 + 0.1 * gw, 0.999 * m2 + 0.001 * gw * gw
        c1, c2 = 0.9 * c1 + 0.1 * gb, 0.999 * c2 + 0.001 * gb * gb
        a, v = 1 - 0.9**k, 1 - 0.999**k
        w -= rate * (m1 / a) / (np.sqrt(m2 / v) + 1e-6)
        b -= rate * (c1 / a) / (np.sqrt(c2 / v) + 1e-6)
    return w, b


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Platt scaling by damped Newton steps on smoothed targets."""
    pos, neg = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = margin.mean(), margin.std() + 1e-9
    z = (margin - mean) / spread
    loss = lambda q: float((np.logaddexp(0, q[0] * z + q[1]) - t * (q[0] * z + q[1])).sum() + 5e-4 * q[0] ** 2)
    at = np.array([0.0, np.log((pos + 1) / (neg + 1))])
    for _ in range(steps):
        p = _sigmoid(at[0] * z + at[1])
        s = p * (1 - p)
        g = np.array([((p - t) * z).sum() + 1e-3 * at[0], (p - t).sum()])
        step = np.linalg.solve(np.array([[(s * z * z).sum() + 1e-3, (s * z).sum()], [(s * z).sum(), s.sum() + 1e-6]]), g)
        while loss(at - step) > loss(at) and abs(step).max() > 1e-9:
            step /= 2
        at = at - step
        if abs(step).max() < 1e-8:
            break
    a, b = at[0] / spread, at[1] - at[0] * mean / spread
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Fit on a bounded sample of labelled rows (``most``); a fifth of it calibrates.  None if there is one class only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffer_of(b.column(1))
            for lo, hi in pieces(offs, PIECE):
                rows = features(Batch(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(2).slice(lo, hi - lo).cast(pa.string()), b.column(0).slice(lo, hi - lo), pa.array([r[0].tobytes() for r in rows], pa.binary()), pa.array([r[1].tobytes() for r in rows], pa.binary())], names=["k", "y", "idx", "val"]
                )

    some = labelled_sample(docs, labels, "quality", most, None, id_col, text_col)
    some = some.groupBy("k", "y").agg(F.min_by("raw", F.struct(F.xxhash64("raw"), "raw")).alias("raw")).select("y", "raw", "k")  # one row of a repeated id
    got = some.mapInArrow(run, "k string, y int, idx binary, val binary").toArrow()  # a row has at most SIZE pairs
    keys = list(zip(got["k"].to_pylist(), got["y"].to_pylist(), strict=True))
    place, nth = np.array(sorted(range(len(keys)), key=keys.__getitem__), int), np.arange(len(keys))

    def part(at: np.ndarray) -> tuple[Sparse, np.ndarray]:
        rows = got.take(at)
        (idx, offs), (val, _) = (buffer_of(rows[c]) for c in ("idx", "val"))
        return Sparse(offs // 4, idx.view(np.int32), val.view(np.float32)), rows["y"].to_numpy().astype(float)

    held, fit = part(place[::5]), part(place[nth % 5 > 0])
    del got
    if any(len(set(y)) < 2 for _, y in (held, fit)):
        return None
    w, b = fit_logistic(*fit)
    out = Model(w.astype(np.float32), b, *calibrate(held[0].times(w) + b, held[1]))
    del held, fit
    pa.default_memory_pool().release_unused()  # else the driver keeps what the sample took
    return out


def judge(x: Batch, m: Model | None, limits: Limits) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, base_failed, probability, kept) of a batch; NaN probabilities without a model."""
    base = base_counts(x)
    failed = (base["n_words"] < limits.least_words) | (100 * base["n_repeat_words"] > limits.repeat_percent * base["n_words"])
    p = _sigmoid(m.slope * margins(x, m.weights, m.bias) + m.intercept) if m else np.full(x.docs, np.nan)
    return base, failed, p, ~failed & ((p >= limits.least_probability) if m else True)


def keep_documents(df: DataFrame, model: Model | None, limits: Limits = Limits(), text_col: str = "text") -> DataFrame:
    """The rows that the rules keep, with all their columns, in one pass over Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column(at).fill_null("").cast(pa.large_binary())
            data, offs = buffer_of(raw)
            for lo, hi in pieces(offs, PIECE):
                kept = judge(Batch(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]), shared.value, limits)[3]
                yield b.slice(lo, hi - lo).filter(pa.array(kept))

    return df.mapInArrow(run, df.schema)


def score_quality(df: DataFrame, model: Model | None, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, base_failed, probability and kept for every row, in one pass over Arrow batches.

    A null text has no words and fails the base rules.  Without a model every
    probability is null and the base rules decide alone.  Ids may be null or
    repeated; an empty table gives no rows; other columns are not read.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names), T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()), T.StructField("kept", T.BooleanType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # fixed by the parameters: SIZE weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            data, offs = buffer_of(b.column(1))
            for lo, hi in pieces(offs, PIECE):
                x = Batch(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                base, failed, p, kept = judge(x, m, limits)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(base[n].astype(np.int64)) for n in names), pa.array(failed), pa.array(p, from_pandas=True), pa.array(kept)], names=schema.fieldNames())

    return df.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(run, schema)
