"""Quality classifier: tree paths as conjunctive rules over statistics, lasso logistic weights, Spark column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffer_of, pieces, utf8
from .quality_rules import _sigmoid, labelled_sample
from .textstats import PIECE, SHAPE, Batch, shape

#: A rule: (statistic, "<=" or ">", value) conditions that must all hold.
Rule = tuple[tuple[int, str, float], ...]


class Ensemble(NamedTuple):
    rules: list[Rule]
    weights: list[float]
    bias: float


def _split(x: np.ndarray, r: np.ndarray, bins: int, least: int) -> tuple[float, int, float] | None:
    """The best (gain, statistic, value) of a least-squares split of residuals."""
    best = None
    n, total = len(r), r.sum()
    for j in range(x.shape[1]):
        for v in np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, bins), method="lower")):
            left = x[:, j] <= v
            k = int(left.sum())
            if k < least or n - k < least:
                continue
            s = r[left].sum()
            gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
            if best is None or gain > best[0] + 1e-12:
                best = (gain, j, float(v))
    return best


def _grow(x: np.ndarray, r: np.ndarray, at: np.ndarray, path: Rule, depth: int, leaves: list, paths: list, bins: int, least: int) -> None:
    if path:
        paths.append(path)
    found = _split(x[at], r[at], bins, least) if depth else None
    if not found or found[0] <= 1e-9:
        leaves.append((path, at))
        return
    _, j, v = found
    left = x[at, j] <= v
    _grow(x, r, at[left], (*path, (j, "<=", v)), depth - 1, leaves, paths, bins, least)
    _grow(x, r, at[~left], (*path, (j, ">", v)), depth - 1, leaves, paths, bins, least)


def tree_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, share: float = 0.5, seed: int = 7) -> list[Rule]:
    """Distinct paths to every node of gradient-boosted trees, each grown on a part of the rows and statistics."""
    rng = np.random.default_rng(seed)
    f = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[Rule, None] = {}
    for _ in range(trees):
        at = np.sort(rng.choice(len(y), max(2, int(share * len(y))), replace=False))
        use = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] * 2 // 3), replace=False))
        p = _sigmoid(f)
        leaves, paths = [], []
        _grow(x[:, use], y - p, at, (), depth, leaves, paths, 12, max(5, len(y) // 200))
        named = lambda path: tuple((int(use[j]), op, v) for j, op, v in path)
        rules |= dict.fromkeys(named(q) for q in paths)
        for path, rows in leaves:
            step = (y - p)[rows].sum() / max((p * (1 - p))[rows].sum(), 1e-3)
            f = f + 0.3 * np.clip(step, -4, 4) * holds(x, named(path))
    return list(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, v in rule:
        out &= (x[:, j] <= v) if op == "<=" else (x[:, j] > v)
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[np.ndarray, float]:
    """L1-penalised logistic weights by accelerated proximal gradient steps; the bias is free."""
    n, k = z.shape
    z1 = np.hstack([z, np.ones((n, 1))])
    v = np.ones(k + 1)
    for _ in range(20):
        v = z1.T @ (z1 @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.25 * float(v @ (z1.T @ (z1 @ v))) / n + 1e-9)
    w = np.zeros(k + 1)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))
    u, t = w.copy(), 1.0
    for _ in range(steps):
        g = z1.T @ (_sigmoid(z1 @ u) - y) / n
        new = u - rate * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


def fit(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Rules and weights; the penalty is the one of least loss on a fifth of the rows."""
    if len(y) < 20 or len(set(y.tolist())) < 2:
        return Ensemble([], [], float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    rules = tree_rules(x, y)
    z = np.stack([holds(x, r) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    held = np.arange(len(y)) % 5 == 0
    best = None
    for penalty in (0.03, 0.01, 0.003, 0.001):
        w, b = lasso_logistic(z[~held], y[~held], penalty)
        p = np.clip(_sigmoid(z[held] @ w + b), 1e-6, 1 - 1e-6)
        loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()
        if best is None or loss < best[0] - 1e-6:
            best = (loss, penalty)
    w, b = lasso_logistic(z, y, best[1])
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return Ensemble([rules[k] for k in keep], [float(w[k]) for k in keep], b)


def rule_column(rule: Rule) -> Column:
    """The conjunction as a Spark condition over the statistics' columns."""
    out = F.lit(True)
    for j, op, v in rule:
        c = F.col(SHAPE[j])
        out = out & ((c <= F.lit(v)) if op == "<=" else (c > F.lit(v)))
    return out


def score_column(model: Ensemble) -> Column:
    """The probability of label 1 as one Spark expression."""
    z = F.lit(model.bias)
    for rule, w in zip(model.rules, model.weights, strict=True):
        z = z + F.when(rule_column(rule), F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def statistics(df: DataFrame, key: str, raw: str) -> DataFrame:
    """One double column for each shape statistic beside ``key``."""
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), *(T.StructField(n, T.DoubleType()) for n in SHAPE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offs = buffer_of(b.column(1))
            for lo, hi in pieces(offs, PIECE):
                s = shape(Batch(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(s[:, j]) for j in range(len(SHAPE)))], names=schema.fieldNames())

    return df.select(key, raw).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose label is never learned: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Ensemble:
    """Fit on a bounded sample (``most``) of the rows that are not held out; only statistics of the text are inputs."""
    some = labelled_sample(docs, labels, "quality", most, ~held_out("k"), id_col, text_col)
    got = sorted(map(tuple, statistics(some.withColumn("y", F.struct("y", F.col("k").cast("string").alias("k"))), "y", "raw").collect()))
    x = np.array([r[1:] for r in got], float).reshape(len(got), len(SHAPE))
    order = np.random.default_rng(3).permutation(len(got))
    return fit(x[order], np.array([r[0]["y"] for r in got], float)[order])


def score_documents(df: DataFrame, model: Ensemble, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) for every row.

    A null or empty text has statistics of zero and is scored like any other.  A
    null id is not held out.  Repeated rows score alike; an empty table gives no
    rows; other columns are not read.  One pass without a shuffle.
    """
    stats = statistics(df.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw")), "doc_id", "raw")
    scored = stats.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
