"""Benchmark decontamination: rare n-gram seeds propose, Smith-Waterman alignment decides.

Texts are lower-cased words (``\\w+``).  An alignment scores 1 for an equal word
and -1 for a substitution, an insertion or a deletion; its similarity is the
score over the item's length.  At a similarity of at least ``s`` the edits of an item of L
words cost at most (1 - s) L.  A substitution or a deletion costs 2 and breaks at most 3
of its n-grams (n = 3), so 1.5 (1 - s) L are broken at most, and one of any
floor(1.5 (1 - s) L) + 1 seeds survives: the rarest ones in the corpus are
looked up, or all where an item has fewer.  An insertion costs 1 and breaks 2: a copy that differs
by insertions alone is sure to be found up to a cost of 0.75 (1 - s) L.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

WORD = re.compile(r"\w+")
N = 3


class Limits(NamedTuple):
    """Least similarity of a leak, and the benchmark items that one pass over the corpus takes."""

    similarity: float = 0.45
    block_items: int = 20_000


class Item(NamedTuple):
    item_id: int | None
    ids: np.ndarray


class Index:
    """Word ids of a block of benchmark items and their seeds; its size is bounded by the block."""

    def __init__(self, rows: list[tuple[int | None, str | None]], similarity: float) -> None:
        self.vocab: dict[str, int] = {}
        self.items = []
        for item_id, text in rows:
            words = WORD.findall((text or "").lower())
            if words:
                self.items.append(Item(item_id, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words])))
        self.similarity = similarity
        self.base = len(self.vocab) + 1
        self.n = [min(N, len(it.ids)) for it in self.items]
        self.seeds_of = [self.grams(it.ids, n) for it, n in zip(self.items, self.n, strict=True)]
        self.seeds = np.unique(np.concatenate([g for g, _ in self.seeds_of])) if self.items else np.zeros(0, np.int64)
        self.looked_up: np.ndarray = self.seeds

    def grams(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(code, position) of the n-grams whose words all are the benchmark's; n is part of the code."""
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        m = len(ids) - n + 1
        code, good = np.full(m, n, np.int64), np.ones(m, bool)
        for k in range(n):
            code = code * self.base + ids[k : k + m]
            good &= ids[k : k + m] >= 0
        at = np.flatnonzero(good)
        return code[at], at

    def encode(self, text: str) -> np.ndarray:
        get = self.vocab.get
        return np.array([get(w, -1) for w in WORD.findall(text.lower())], np.int64)

    def hits(self, ids: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(seed, position) of every occurrence of one of ``seeds`` in a text."""
        codes, at = [], []
        for n in sorted(set(self.n)):
            c, p = self.grams(ids, n)
            if len(c) and len(seeds):
                k = np.minimum(np.searchsorted(seeds, c), len(seeds) - 1)
                ok = seeds[k] == c
                codes.append(c[ok])
                at.append(p[ok])
        return (np.concatenate(codes), np.concatenate(at)) if codes else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def keep_rare(self, frequency: dict[int, int]) -> None:
        """Choose each item's rarest seeds, as many as the bound asks for, and file the items under them."""
        self.by_seed: dict[int, list[tuple[int, int]]] = {}
        for i, (it, (codes, at)) in enumerate(zip(self.items, self.seeds_of, strict=True)):
            need = int(1.5 * (1 - self.similarity) * len(it.ids) + 1e-9) + 1
            order = sorted(range(len(codes)), key=lambda k: (frequency.get(int(codes[k]), 0), int(codes[k]), k))
            for k in order[:need]:
                self.by_seed.setdefault(int(codes[k]), []).append((i, int(at[k])))
        self.looked_up = np.array(sorted(self.by_seed), np.int64)


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int, int]:
    """(score, matches, start, end) of the best local alignment of item ``a`` in ``b``; of equal ones the first to end.

    Row by row over the item: the horizontal gap of a row is a running maximum,
    since a gap of any length costs its length.
    """
    m = len(b)
    if not len(a) or not m:
        return 0, 0, 0, 0
    rows = np.zeros((len(a) + 1, m + 1), np.int32)
    ramp = np.arange(m + 1, dtype=np.int32)
    for i, w in enumerate(a):
        prev = rows[i]
        row = np.maximum(prev - 1, 0)
        row[1:] = np.maximum(row[1:], prev[:-1] + np.where(b == w, 1, -1))
        np.maximum.accumulate(row + ramp, out=row)
        rows[i + 1] = np.maximum(row - ramp, 0)
    i, j = np.unravel_index(int(rows.argmax()), rows.shape)
    score, end, matches = int(rows[i, j]), int(j), 0
    while i > 0 and j > 0 and rows[i, j] > 0:
        if rows[i, j] == rows[i - 1, j - 1] + (1 if b[j - 1] == a[i - 1] else -1):
            matches += int(b[j - 1] == a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i, j] == rows[i - 1, j] - 1:
            i -= 1
        else:
            j -= 1
    return score, matches, int(j), end


def windows(spots: list[int], length: int, n_words: int, similarity: float) -> list[tuple[int, int]]:
    """Merged stretches of a text that hold any alignment with an item begun at one of ``spots``."""
    slack = int((1 - similarity) * length) + 1
    out: list[tuple[int, int]] = []
    for s in sorted(spots):
        lo, hi = max(0, s - slack), min(n_words, s + length + slack)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def text_leaks(index: Index, text: str) -> list[tuple[int | None, float, int, int, int, int]]:
    """(item_id, similarity, matches, item words, first word, end word) of each item's best alignment in one text."""
    ids = index.encode(text)
    codes, at = index.hits(ids, index.looked_up)
    spots: dict[int, list[int]] = {}
    for c, p in zip(codes.tolist(), at.tolist(), strict=True):
        for i, q in index.by_seed[c]:
            spots.setdefault(i, []).append(p - q)
    out = []
    for i, ss in spots.items():
        a = index.items[i].ids
        best = None
        own = np.unique(a)
        for lo, hi in windows(ss, len(a), len(ids), index.similarity):
            b = ids[lo:hi]
            if np.isin(b, own).sum() < index.similarity * len(a):
                continue  # fewer of the item's words than the score needs
            score, matches, s, e = smith_waterman(a, b)
            if score >= index.similarity * len(a) - 1e-9 and (best is None or score > best[1]):
                best = (index.items[i].item_id, score, matches, len(a), lo + s, lo + e)
        if best:
            out.append((best[0], best[1] / len(a), *best[2:]))
    return out


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> Iterator[list[tuple]]:
    rows: list[tuple] = []
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        rows.append((r[0], r[1]))
        if len(rows) == size:
            yield rows
            rows = []
    if rows:
        yield rows


def filed_blocks(texts: DataFrame, benchmark: DataFrame, limits: Limits, item_id: str = "item_id", item_text: str = "text") -> Iterator:
    """Broadcast indexes, one for each block of items, with every item filed under its rarest seeds in ``texts`` (a column raw of bytes)."""
    context = texts.sparkSession.sparkContext
    for rows in _blocks(benchmark, item_id, item_text, limits.block_items):
        index = Index(rows, limits.similarity)
        if not index.items:
            continue
        shared = context.broadcast(index)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            total = np.zeros(len(index.seeds), np.int64)
            for b in batches:
                for raw in b.column(0):
                    codes, _ = index.hits(index.encode(raw.as_py().decode("utf-8", "replace")), index.seeds)
                    total[np.searchsorted(index.seeds, np.unique(codes))] += 1
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(index.seeds[at]), pa.array(total[at])], names=["seed", "n"])

        counted = texts.select("raw").mapInArrow(count, "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
        index.keep_rare({r["seed"]: r["n"] for r in counted.collect()})
        yield context.broadcast(index)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows that align with no benchmark item, with all their columns."""
    at = docs.columns.index(text_col)
    out = docs
    for filed in filed_blocks(docs.select(utf8(text_col).alias("raw")), benchmark, limits, item_id, item_text):

        def clean(batches: Iterator[pa.RecordBatch], filed=filed) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not text_leaks(filed.value, x or "") for x in b.column(at).to_pylist()], pa.bool_()))

        out = out.mapInArrow(clean, docs.schema)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item that aligns with it: doc_id, item_id, similarity, matches, item_words, first_word, end_word.

    The benchmark is taken in blocks of a fixed number of items, each a pass over the
    corpus for seed frequencies and one for alignments; nothing is shuffled but the seed counts, of which there are
    no more than a block has seeds.  Null or wordless texts and items match
    nothing.  Null ids are kept; of repeated rows each gives its rows; an item
    shorter than three words is one seed, and matches as a whole only.  An empty table gives no rows; other columns are not read.
    """
    schema = T.StructType(
        [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType())]
        + [T.StructField(n, T.IntegerType()) for n in ("matches", "item_words", "first_word", "end_word")]
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw"))
    out = None
    for filed in filed_blocks(texts, benchmark, limits, item_id, item_text):

        def align(batches: Iterator[pa.RecordBatch], shared=filed) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                found = [(k, *x) for k, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True) for x in text_leaks(index, raw.as_py().decode("utf-8", "replace"))]
                cols = list(zip(*found, strict=True)) if found else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (b.schema.field(0).type, pa.int64(), pa.float64(), *[pa.int32()] * 4), strict=True)], names=schema.fieldNames())

        leaks = texts.mapInArrow(align, schema)
        out = leaks if out is None else out.unionByName(leaks)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)
