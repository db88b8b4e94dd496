"""Exact-substring dedup by prefix-free parsing.

Triggers cut every text into phrases: a position is a trigger if the rolling
hash of the ``K`` bytes there is the least in some window of ``span - K + 1``
positions.  Triggers depend on the bytes alone, and every string of ``span`` bytes holds one,
its *anchor*: the least of its window.  So equal strings have equal anchors at equal
distances, and the strings of all texts fall into classes by the K bytes at their anchors.

A class is a part of the corpus' suffix order.  In it a string is a suffix of a
phrase (the bytes before the anchor) followed by a suffix of the parse (the
bytes from the anchor on).  The suffix array of the distinct phrases and that
of the distinct parse suffixes, with their common-prefix lengths, are combined into
the class's corpus order, where equal strings stand side by side.  Phrases and parse suffixes that
repeat as a whole are counted once, with their number: only distinct ones are ever sorted.

A class with too many for one task is split by more of its bytes.  Strings at a distance of a to b from their anchor
all hold the a bytes before it and the span - b bytes from it on; for each of a few such ranges these bytes
make the smaller classes.  What is still too large has hardly any other byte than those, and there each string is a class
of its own: its strings are counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffer_of, pieces, stage, utf8
from .textstats import BYTE_VALUE, PIECE, mix, powers

SPAN = 400
K = 100
#: Distinct contexts of one class that one task sorts; larger classes are split by ranges of distances, so many.
CLASS_ROWS = 1024
RANGES = 8


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * powers(len(data))[0], out=out[1:])
    return out


def string_hashes(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of the byte strings [lo, hi), from the prefix hashes."""
    return mix((prefix[hi] - prefix[lo]) * powers(len(prefix))[1][lo])


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` consecutive values: block-wise running minima from both sides."""
    n = len(a)
    b = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    b[:n] = a
    b = b.reshape(-1, w)
    left = np.minimum.accumulate(b, axis=1).ravel()
    right = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: np.ndarray, offs: np.ndarray, span: int = SPAN, k: int = K) -> dict[str, np.ndarray]:
    """The anchors of concatenated texts, each with the run of string starts it stands for.

    doc; lo: first start, in its text; left: anchor minus lo; run: last start minus lo;
    class: hash of the k bytes at the anchor; ctx: hash of all bytes of the run's strings.
    """
    n = len(data)
    empty = {c: np.zeros(0, np.int64) for c in ("doc", "lo", "left", "run", "class", "ctx")}
    if n < span:
        return empty
    prefix = prefix_hashes(data)
    at = np.arange(n - k + 1)
    h = string_hashes(prefix, at, at + k)
    bits = np.uint64(max(23, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_min((h & ~low) | at.astype(np.uint64), span - k + 1)  # of equal hashes the leftmost
    step = np.zeros(n - span + 2, np.int32)
    size = np.diff(offs)
    long = np.flatnonzero(size >= span)
    np.add.at(step, offs[long], 1)
    np.add.at(step, offs[long + 1] - span + 1, -1)
    starts = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    if not len(starts):
        return empty
    anchor = (least[starts] & low).astype(np.int64)
    doc = np.searchsorted(offs, starts, "right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    lo, hi, t, d = starts[first], starts[last], anchor[first], doc[first]
    ctx = string_hashes(prefix, lo, hi + span) ^ mix(((t - lo) * 4096 + (hi - lo)).astype(np.uint64))
    return {"doc": d, "lo": lo - offs[d], "left": t - lo, "run": hi - lo, "class": h[t].astype(np.int64), "ctx": ctx.astype(np.int64)}


def _common(rows: list[bytes], width: int) -> np.ndarray:
    """Length of the common prefix of each row with the row before it."""
    m = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    differ = m[1:] != m[:-1]
    size = np.array([len(r) for r in rows])
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(size[1:], size[:-1]))


def _order(keys: list[tuple[int, bytes]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of (class, bytes) keys and the common length with the predecessor; -1 across classes."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    lcp = np.full(len(keys), -1)
    if len(keys) > 1:
        lcp[1:] = _common([keys[i][1] for i in order], width)
        lcp[1:][np.array([keys[a][0] != keys[b][0] for a, b in zip(order, order[1:])])] = -1
    return np.array(order), lcp


def unique_distances(classes: list[int], counts: list[int], lefts: list[int], runs: list[int], texts: list[bytes], span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, a, b): the distances a .. b from the anchor at which the strings of a row of count 1 are nowhere else in its class.

    A row is a distinct context: the bytes of all strings of a run.  For a distance d two rows have the
    same string if their phrases share the last d bytes and their parse suffixes the first span - d.
    Both are runs in the two suffix orders, so all distances are settled by counting equal pairs of run numbers.
    """
    n, width = len(texts), span - k + 1
    phrase = [(c, x[:p][::-1]) for c, x, p in zip(classes, texts, lefts, strict=True)]
    parse = [(c, x[p:]) for c, x, p in zip(classes, texts, lefts, strict=True)]
    d = np.arange(width)
    ids = []
    for keys, need, longest in ((phrase, d, width), (parse, span - d, span)):
        order, lcp = _order(keys, longest)
        run = np.empty((n, width), np.int64)
        run[order] = np.cumsum(lcp[:, None] < need, axis=0)
        ids.append(run)
    left, last = np.array(lefts), np.array(runs)
    valid = (d <= left[:, None]) & (d >= (left - last)[:, None])
    key = ((ids[0] * (n + 2) + ids[1]) * width + d)[valid]
    # a row of count above 1 has its strings elsewhere by itself; it still stands for the others to meet
    _, inverse, number = np.unique(key, return_inverse=True, return_counts=True)
    single = np.zeros((n, width + 2), bool)
    single[:, 1:-1][valid] = number[inverse] == 1
    single[np.array(counts) > 1] = False
    edge = np.diff(single.astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)
    return row, a, b - 1


def covered(found: list[dict], size: int, span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the repeated strings of a text's anchors."""
    parts = []
    for r in found:
        lo, hi, t = r["lo"], r["lo"] + r["run"], r["lo"] + r["left"]
        for u in sorted(r["uniq"] or (), key=lambda u: -u["a"]):  # larger distances start earlier
            if t - u["b"] > lo:
                parts.append((lo, t - u["b"] - 1 + span))
            lo = t - u["a"] + 1
        if lo <= hi:
            parts.append((lo, hi + span))
    out: list[tuple[int, int]] = []
    for a, b in sorted(parts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    """Bytes and the text's key: equal texts have one key, and one result."""
    raw = utf8(text_col)
    return df.withColumn("raw", raw).withColumn("k1", F.xxhash64("raw")).withColumn("k2", (F.crc32("raw") * 4096 + F.length("raw") % 4096))


def _find_anchors(texts: DataFrame, span: int, k: int) -> DataFrame:
    names = ("class", "ctx", "k1", "k2", "lo", "left", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            data, offs = buffer_of(b.column(2))
            for lo, hi in pieces(offs, PIECE):
                x = anchors(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo], span, k)
                d = x["doc"] + lo
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (x["class"], x["ctx"], k1[d], k2[d], x["lo"], x["left"].astype(np.int32), x["run"].astype(np.int32))], names=list(names))

    return texts.where(F.length("raw") >= span).select("k1", "k2", "raw").mapInArrow(run, "class long, ctx long, k1 long, k2 long, lo long, left int, run int")


def _contexts(texts: DataFrame, wanted: DataFrame, span: int) -> DataFrame:
    """The bytes of the wanted contexts, cut from one text of their key (a few, if copies meet in several tasks)."""
    by_text = wanted.groupBy("k1", "k2").agg(F.collect_list(F.struct("class", "ctx", "n", "contexts", "lo", "left", "run")).alias("found"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for b in batches:
            out = []
            for k1, k2, raw, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                if (k1, k2) in seen:
                    continue
                seen.add((k1, k2))
                raw = raw.as_py()
                out += [(r["class"], r["ctx"], r["n"], r["contexts"], r["left"], r["run"], raw[r["lo"] : r["lo"] + r["run"] + span]) for r in found.as_py()]
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["class", "ctx", "n", "contexts", "left", "run", "bytes"])

    return texts.select("k1", "k2", "raw").join(by_text, ["k1", "k2"]).select("k1", "k2", "raw", "found").mapInArrow(run, "class long, ctx long, n long, contexts long, left int, run int, bytes binary")


def _split(contexts: DataFrame, span: int, k: int) -> DataFrame:
    """Contexts of large classes, cut to the strings of each range of distances, in the classes of these ranges (column key)."""
    width = span - k + 1
    cuts = np.unique(np.linspace(0, width, RANGES + 1).astype(int)).tolist()
    schema = "key long, class long, ctx long, n long, left int, run int, bytes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for cls, ctx, n, left, last, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for lo, hi in zip(cuts, cuts[1:]):
                    far, close = min(hi - 1, left), max(lo, left - last)
                    if far >= close:
                        core = raw[left - lo : left + span - (hi - 1)]
                        key = xxhash.xxh64_intdigest(core, cls & 0xFFFFFFFF) ^ (lo + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)
                        out.append((key - (key >> 63 << 64), cls, ctx, n, far, far - close, raw[left - far : left - close + span]))
            cols = list(zip(*out, strict=True)) if out else [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "class", "ctx", "n", "left", "run", "bytes"])

    big = contexts.where(F.col("contexts") > CLASS_ROWS).dropDuplicates(["class", "ctx"])
    parts = stage(big.select("class", "ctx", "n", "left", "run", "bytes").mapInArrow(run, schema), "parts")
    return parts.join(parts.groupBy("key").agg(F.count("*").alias("contexts")).where("contexts > 1"), "key", "left")


def _settle_sorted(contexts: DataFrame, span: int, k: int) -> DataFrame:
    """Unique distances of contexts in classes (column key) that one task can sort, many classes at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], tuple] = {}

        def settle() -> pa.RecordBatch:
            rows = list(held.values())
            row, a, b = unique_distances([r[0] for r in rows], [r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], [r[6] for r in rows], span, k)
            return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in row], pa.int64()), pa.array([rows[i][2] for i in row], pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], names=["class", "ctx", "a", "b"])

        last = None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[0] != last and len(held) >= max(1, CLASS_ROWS):
                    yield settle()
                    held = {}
                last = r[0]
                held[r[:3]] = r
        if held:
            yield settle()

    some = contexts.select("key", "class", "ctx", "n", "left", "run", "bytes")
    return some.repartition("key").sortWithinPartitions("key").mapInArrow(run, "class long, ctx long, a int, b int")


def _settle_counted(contexts: DataFrame, span: int) -> DataFrame:
    """The same for classes of whole strings: those that are there once are unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, ctx, n, left, last, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.arange(last + 1)
                h = string_hashes(prefix_hashes(np.frombuffer(raw, np.uint8)), at, at + span)
                size = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(size, v, t)) for v, t in ((cls, np.int64), (ctx, np.int64), (n, np.int64))] + [pa.array((left - at).astype(np.int32)), pa.array(h.astype(np.int64))], names=["class", "ctx", "n", "d", "h"])

    strings = contexts.select("class", "ctx", "n", "left", "run", "bytes").mapInArrow(run, "class long, ctx long, n long, d int, h long")
    once = strings.groupBy("class", "d", "h").agg(F.count("*").alias("m"), F.max("n").alias("n"), F.min("ctx").alias("ctx")).where("m = 1 and n = 1")
    return once.select("class", "ctx", F.col("d").alias("a"), F.col("d").alias("b"))


def remove_repeats(df: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Drop every byte covered by a ``span``-byte string that starts anywhere else too: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept bytes.

    A null text is empty; texts shorter than ``span`` bytes stay as they are.  Matches never cross texts.
    Equal texts of ``span`` bytes or more are removed whole.  Ids may be null or repeated (each row is a text of its own);
    an empty table gives no rows; other columns are not read.
    """
    docs = _texts(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    found = stage(_find_anchors(docs, span, k), "anchors")
    shared = found.groupBy("class").agg(F.count("*").alias("n"), F.min("ctx").alias("c0"), F.max("ctx").alias("c1")).where("n > 1").select("class", (F.col("c0") != F.col("c1")).alias("mixed"))
    shared = stage(shared, "classes")  # apart from its own shuffle, the join can split a class that has very many rows
    # copies of one text have the same rows: they are counted before they are shuffled
    # (as one struct, so that the counts are not tied to the join's tasks, of which a large class needs several)
    same = F.struct("class", "ctx", "mixed", "k1", "k2", "lo", "left", "run").alias("same")
    found = stage(found.join(shared, "class").groupBy(same).agg(F.count("*").alias("m")).select("same.*", "m"), "shared")
    distinct = found.where("mixed").groupBy("class", "ctx").agg(F.sum("m").alias("n"), F.min(F.struct("k1", "k2", "lo", "left", "run")).alias("at"))
    sizes = found.where("mixed").select("class", "ctx").distinct().groupBy("class").agg(F.count("*").alias("contexts"))
    wanted = distinct.join(sizes, "class").select("class", "ctx", "n", "contexts", "at.*")
    contexts = stage(_contexts(docs, wanted, span), "contexts")
    parts = _split(contexts, span, k)
    whole = contexts.where(F.col("contexts") <= CLASS_ROWS).withColumn("key", F.col("class")).select(parts.columns)
    small = F.coalesce("contexts", F.lit(1)) <= CLASS_ROWS
    unique = _settle_sorted(whole.union(parts.where(small)), span, k).union(_settle_counted(parts.where(~small), span))
    unique = stage(unique.groupBy("class", "ctx").agg(F.collect_set(F.struct("a", "b")).alias("uniq")), "unique")
    spans = found.join(unique, ["class", "ctx"], "left").groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", "left", "run", "uniq")).alias("found"))
    fields = "doc_id " + df.schema[id_col].dataType.simpleString() + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, removed, number, sha, kept = [], [], [], [], []
            for raw, some in zip(b.column(1), b.column(2), strict=True):
                raw = raw.as_py()
                runs = covered(some.as_py() or (), len(raw), span) if some.is_valid else []
                cut, at = [], 0
                for lo, hi in runs:
                    cut.append(raw[at:lo])
                    at = hi
                rest = b"".join([*cut, raw[at:]])
                size.append(len(raw))
                removed.append(len(raw) - len(rest))
                number.append(len(runs))
                sha.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            cols = [b.column(0), *(pa.array(c, pa.int64()) for c in (size, removed, number)), pa.array(sha, pa.string())] + ([pa.array(kept, pa.binary())] if keep_text else [])
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_text)

    return docs.select("doc_id", "raw", "k1", "k2").join(spans, ["k1", "k2"], "left").select("doc_id", "raw", "found").mapInArrow(run, fields)
