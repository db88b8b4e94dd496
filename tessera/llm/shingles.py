"""Near-duplicates by the Jaccard similarity of word shingles, found by prefix filtering and verified exactly.

Two sets of sizes n and k with a similarity of 4/5 or more share at least 4/5 of the larger, so
under any one order of all shingles the first n - ceil(4n / 5) + 1 of each have one in common.  They share 4/9 of
n + k, so after the first common shingle each has that many left (the positional filter): in the smaller set it is among the first
n / 9 + 1.  The order puts frequent shingles last: those of a sample, and then those that come first in more than
``HOT`` of all sets by the sample's order.  The order decides how many candidates there are, not which pairs are found.

Candidates meet by odd sketches first: the bits that differ are never more than the shingles that differ,
of which similar sets have at most a ninth of n + k.  Only what passes is compared by whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import fresh, pieces, stage, stage_measured
from .components import components
from .textstats import BASE, PIECE, SPACE, Batch, mix

WIDTH = 5
#: Key groups up to this size are joined with themselves; in larger ones all are compared with a pivot first, so that a cluster
#: of near copies costs a pair for each of its members and not one for each two.
GROUP = 2
PIVOTS = 2
#: Rows of texts, or of pairs of sets, that a worker holds at once.
ROWS = 1_000
#: Sets whose shingles set the first order, and the most shingles that count as frequent, in the sample and in all sets.
SAMPLE, FREQUENT = 5_000, 200_000
#: Rows of a key beyond which the second order puts it last.
HOT = 4
#: The least number of bits of a sketch; a larger set has a bit or more for each shingle.
SKETCH = 512


def word_hashes(raws: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the words of each text; long texts are hashed in parts cut at white space."""
    out: list[np.ndarray] = []
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raws])]).astype(np.int64)
    for lo, hi in pieces(offs, PIECE):
        if hi - lo > 1 or len(raws[lo]) <= PIECE:
            x = Batch(np.frombuffer(b"".join(raws[lo:hi]), np.uint8), offs[lo : hi + 1] - offs[lo])
            out += np.split(x.words(), x.first[1:-1])
            continue
        data, at, parts = np.frombuffer(raws[lo], np.uint8), 0, []
        while at < len(data):
            end = min(at + PIECE, len(data))
            if end < len(data):
                gaps = np.flatnonzero(SPACE[data[at:end]])
                later = () if len(gaps) else np.flatnonzero(SPACE[data[end:]])[:1]  # a word longer than a part
                end = at + int(gaps[-1]) + 1 if len(gaps) else end + int(later[0]) + 1 if len(later) else len(data)
            parts.append(Batch(data[at:end], np.array([0, end - at])).words())
            at = end
        out.append(np.concatenate(parts))
    return out


class Order(NamedTuple):
    """Sorted hashes of the frequent shingles, which come last, and how often each was met."""

    shingles: np.ndarray
    counts: np.ndarray

    def ranks(self, found: np.ndarray) -> np.ndarray:
        if not len(self.shingles):
            return np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.shingles, found), len(self.shingles) - 1)
        return np.where(self.shingles[at] == found, self.counts[at], 0)


def shingle_sets(raws: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's ``width``-word shingles; a shorter text is one shingle, one without words has none."""
    out = []
    for h in word_hashes([r.lower() for r in raws]):
        n = max(1, len(h) - width + 1)
        w = np.full(n if len(h) else 0, min(len(h), width), np.uint64)
        for k in range(min(width, len(h))):
            w = mix(w * BASE + h[k : k + n])
        out.append(np.unique(w.astype(np.int64)))
    return out


def prefix(found: np.ndarray, order: Order) -> np.ndarray:
    """The set's first shingles by the order."""
    n = len(found)
    ranks = order.ranks(found)
    return (found[np.argsort(ranks, kind="stable")] if ranks.any() else found)[: n - (4 * n + 4) // 5 + 1]


def signature(found: np.ndarray) -> int:
    return simhash.signed(xxhash.xxh3_64_intdigest(found.tobytes(), 9)) if len(found) else 0


def sketch(found: np.ndarray) -> bytes:
    """The odd sketch: bit i says whether an odd number of shingles fall on it; a power of two of bits."""
    bits = max(SKETCH, 1 << max(len(found) - 1, 0).bit_length())
    return np.packbits(np.bincount(found & (bits - 1), minlength=bits) & 1).tobytes()


def folded(odd: bytes) -> list[int]:
    """The sketch folded to ``SKETCH`` bits, as longs."""
    return np.bitwise_xor.reduce(np.frombuffer(odd, np.int64).reshape(-1, SKETCH // 64), axis=0).tolist()


def may_be_similar(x: bytes, n: int, y: bytes, k: int) -> bool:
    """False only if two sets of ``n`` and ``k`` shingles with these sketches have a similarity below 4/5."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    size = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (a, b))  # a longer sketch folds onto a shorter
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n + k


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sets is 4/5 or more."""
    return 9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, len(b), ROWS):
            yield b.slice(at, ROWS)


def _raws(col: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in col.to_pylist()]


def _new(b: pa.RecordBatch, seen: set[int]) -> tuple[list[int], list[np.ndarray]]:
    """Signatures and shingle sets of a batch, without those seen before."""
    sigs = b.column(0).to_pylist()
    new = [i for i, s in enumerate(sigs) if s not in seen and not seen.add(s)]
    return [sigs[i] for i in new], shingle_sets(_raws(b.column(1).take(pa.array(new, pa.int64()))))


def _sample_order(rows: DataFrame, text: str, sig: str, n: int) -> Order:
    """The order by the shingles that are found in at least three sampled sets."""
    some = rows.where(F.pmod(F.xxhash64(sig), F.lit(max(1, n // SAMPLE))) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _slices(batches):
            for found in _new(b, seen)[1]:
                yield pa.RecordBatch.from_arrays([pa.array(found)], names=["key"])

    counts = some.select(sig, text).mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("met")).where("met > 2")
    got = counts.orderBy(F.desc("met"), "key").limit(FREQUENT).toArrow().sort_by("key")
    return Order(got["key"].to_numpy(), got["met"].to_numpy() * max(1, n // SAMPLE))


def _whole_order(keys: DataFrame, order: Order) -> Order:
    """``order`` with the counts of the keys that more than ``HOT`` rows of different sets gave by it."""
    met = keys.groupBy("key").agg(F.count("*").alias("met"), F.min("sig").alias("a"), F.max("sig").alias("b")).where((F.col("met") > HOT) & (F.col("a") != F.col("b")))
    got = met.select("key", "met").orderBy(F.desc("met"), "key").limit(FREQUENT).toArrow()
    found, counts = (np.concatenate([x, got[c].to_numpy()]) for x, c in zip(order, ("key", "met"), strict=True))
    by = np.lexsort((counts, found))
    found, counts = found[by], counts[by]
    last = np.append(found[1:] != found[:-1], True)[: len(found)]  # of two counts the larger
    return Order(found[last], counts[last])


def _keys(rows: DataFrame, text: str, sig: str, order: Order) -> DataFrame:
    """key, sig, n, pos: a row for each shingle of each set's prefix, with its place there; a task gives a set once."""
    shared = rows.sparkSession.sparkContext.broadcast(order)  # at most twice FREQUENT shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in _slices(batches):
            sigs, found = _new(b, seen)
            keys = [prefix(f, shared.value) for f in found]
            if keys:
                lens = [len(k) for k in keys]
                cols = [np.concatenate(keys), np.repeat(np.array(sigs, np.int64), lens), np.repeat([len(f) for f in found], lens).astype(np.int32), np.concatenate([np.arange(n, dtype=np.int32) for n in lens])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "sig", "n", "pos"])

    return rows.select(sig, text).mapInArrow(run, "key long, sig long, n int, pos int")


def _close(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) of ``pairs`` whose sketches allow a similarity of 4/5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [may_be_similar(*r) for r in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    of = lambda c, x, n: sets.select(F.col("sig").alias(c), F.col("sketch").alias(x), F.col("n").alias(n))
    both = pairs.distinct().join(of("u", "x", "n"), "u").join(of("v", "y", "k"), "v")
    return both.select("u", "v", "x", "n", "y", "k").mapInArrow(run, "u long, v long")


def _folds(sets: DataFrame) -> DataFrame:
    """sig and its folded sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(map(folded, b.column(1).to_pylist())), pa.list_(pa.int64()))], names=["sig", "folded"])

    return sets.mapInArrow(run, "sig long, folded array<long>")


def _verified(pairs: DataFrame, rows: DataFrame, text: str, sig: str, sets: DataFrame, file: str, row: str) -> DataFrame | None:
    """The (u, v) of ``pairs`` whose sets are similar; None if no pair may be."""
    pairs, seen = stage_measured(_close(pairs, sets), "pairs", F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return None
    met = pairs.select(F.col("u").alias("sig")).union(pairs.select(F.col("v").alias("sig"))).distinct()
    at = sets.join(met, "sig").select(F.col("file").alias(file), F.col("row").alias(row))

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f.tobytes() for f in shingle_sets(_raws(b.column(1)))], pa.binary())], names=["sig", "bag"])

    bags = stage(rows.join(at, [file, row], "left_semi").select(F.col(sig).alias("sig"), F.col(text).alias("text")).mapInArrow(bag, "sig long, bag binary"), "bags")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(bags.select(F.col("sig").alias("u"), F.col("bag").alias("x")), "u").join(bags.select(F.col("sig").alias("v"), F.col("bag").alias("y")), "v")
    return stage(both.select("u", "v", "x", "y").mapInArrow(run, "u long, v long"), "similar")


def links(rows: DataFrame, text: str, sig: str, sets: DataFrame, file: str, row: str, known: DataFrame, group: int = GROUP) -> DataFrame:
    """(node, root) of the components that similar pairs and the edges ``known`` make of set signatures; those that are their own root are left out.

    ``sets``: sig, n, sketch and the place of one row of every distinct set.
    A pivot is compared with all members of its group that are not yet in its component and then
    leaves the group; a group within one component is done.  What is left after some
    rounds is compared, begins of smaller sets with all others, where the components differ.
    """
    order = _sample_order(rows, text, sig, sets.count())
    keys = stage(_keys(rows, text, sig, _whole_order(_keys(rows, text, sig, order), order)), "keys")
    begins = 9 * F.col("pos") <= F.col("n")  # the only places where a smaller set's first common shingle can be
    shared = keys.groupBy("key").agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.max(begins).alias("c")).where("a != b and c").select("key")
    held = stage(keys.join(stage(shared, "shared"), "key").distinct(), "held")
    sizes = held.groupBy("key").agg(F.count("*").alias("size"))
    sized = held.join(sizes, "key")
    other = lambda df: df.select("key", F.col("sig").alias("v"), F.col("n").alias("m"), F.col("pos").alias("at"), *([F.col("root").alias("other")] if "root" in df.columns else []))
    # size and positional filters; they imply that the smaller set's place is a begin
    near = (5 * F.col("n") >= 4 * F.col("m")) & (5 * F.col("m") >= 4 * F.col("n")) & (9 * F.least(F.col("n") - F.col("pos"), F.col("m") - F.col("at")) >= 4 * (F.col("n") + F.col("m")))
    once = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("sig") > F.col("v")))
    ends = (F.greatest("sig", "v").alias("u"), F.least("sig", "v").alias("v"))
    check = lambda found: _verified(found, rows, text, sig, sets, file, row)
    small = sized.where(F.col("size") <= group).drop("size")
    new = check(small.where(begins).join(other(small), "key").where(once & near).select(*ends))
    joined = lambda edges, new: components(edges if new is None else edges.union(new))
    count = F.count(F.lit(1)).alias("n")
    left, seen = stage_measured(sized.where(F.col("size") > group).drop("size"), "left", count)
    roots = joined(known, new)
    for k in range(PIVOTS + 1):
        if not seen["n"]:
            break
        placed = left.drop("root").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
        split = placed.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
        left, seen = stage_measured(placed.join(split, "key"), "left", count)
        if not seen["n"]:
            break
        if k < PIVOTS:
            # the same order everywhere, so that groups of one cluster take one pivot
            pivots = left.groupBy("key").agg(F.min_by(F.struct("sig", "n", "pos", "root"), F.struct(F.xxhash64("sig"), "sig")).alias("p")).select("key", "p.*")
            met, left = left.join(other(pivots), "key"), left.join(pivots.select("key", "sig"), ["key", "sig"], "left_anti")
        else:
            # what is alike, but not enough, would meet in pairs: the folded sketches rule most out inside the join
            folds = stage(_folds(sets.select("sig", "sketch").join(left.select("sig").distinct(), "sig")), "folds")
            met = left.join(folds, "sig").where(begins).join(other(left).join(folds.select(F.col("sig").alias("v"), F.col("folded").alias("fold")), "v"), "key")
            differ = sum((F.bit_count(F.col("folded")[i].bitwiseXOR(F.col("fold")[i])) for i in range(SKETCH // 64)), F.lit(0))
            met = met.where(once & (9 * differ <= F.col("n") + F.col("m")))
        new = check(met.where((F.col("root") != F.col("other")) & near).select(*ends))
        if new is not None:
            roots = joined(roots.select(F.col("node").alias("u"), F.col("root").alias("v")), new)
    return roots


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """One row of each group, with all its columns: that of the smallest id (a null id comes last; of repeated ids one row).

    A group is what links of two kinds connect: five-word shingles with a similarity of 4/5 or more, and
    op10's fingerprints within two bits.  Texts without words are one group.
    """
    at = df.columns.index(text_col)
    fp, sig, size, odd, file, row = fresh(df.columns, "__fp", "__sig", "__n", "__sketch", "__file", "__row")
    schema = T.StructType([*df.schema.fields, T.StructField(fp, T.LongType()), T.StructField(sig, T.LongType()), T.StructField(size, T.LongType()), T.StructField(odd, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            raws = _raws(b.column(at))
            fps = np.array([simhash.fingerprint(raw) for raw in raws], np.uint64).astype(np.int64)
            found = shingle_sets(raws)
            cols = [pa.array(fps), pa.array([signature(f) for f in found], pa.int64()), pa.array([len(f) for f in found], pa.int64()), pa.array([sketch(f) for f in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=schema.fieldNames())

    rows = stage(df.mapInArrow(run, schema), "documents").withColumn(file, F.col("_metadata.file_name")).withColumn(row, F.col("_metadata.row_index"))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))
    both = stage(rows.groupBy(F.col(fp).alias("fp"), F.col(sig).alias("sig")).agg(F.min(order).alias("least")), "both")
    places = stage(both.groupBy("sig").agg(F.min("least").alias("least")), "places")
    of = rows.select(F.col(file).alias("file"), F.col(row).alias("row"), F.col(sig).alias("sig"), F.col(size).alias("n"), F.col(odd).alias("sketch"))
    sets = stage(of.join(places.select("sig", "least.file", "least.row"), ["sig", "file", "row"], "left_semi"), "sets")
    fps = stage(both.groupBy("fp").agg(F.min("sig").alias("first")), "fps")
    same = both.join(fps, "fp").select(F.col("sig").alias("u"), F.col("first").alias("v"))
    near = simhash.links(fps.select("fp")).join(fps.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(fps.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v")
    known = stage(same.union(near.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))).where("u != v").distinct(), "known")
    roots = links(rows, text_col, sig, sets, file, row, known, group)
    placed = places.join(roots, places["sig"] == roots["node"], "left").select("least", F.coalesce("root", "sig").alias("root"))
    chosen = stage(placed.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.file").alias(file), F.col("least.row").alias(row)), "chosen")
    # the rows that go are fewer than those that stay: texts move only if even those are too many to broadcast
    gone = stage(rows.select(file, row).join(chosen, [file, row], "left_anti"), "gone")
    return rows.join(gone, [file, row], "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
