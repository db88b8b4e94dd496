"""SimHash near-duplicates with pigeonring filtering.

The 64 bits are cut into ``m`` ring segments.  If two fingerprints differ in
at most ``t`` bits, some segment starts a chain whose first l segments differ in at
most floor(l * t / m) bits together, for every l.  The chain's leading run with budget zero is an
equality, hence a join key; the later budgets prune before the full Hamming check.  Where too many
fingerprints share a key, the later budgets make longer keys of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, stage, stage_measured, utf8
from .components import components

SEGMENTS = 7
DISTANCE = 2
#: Key groups up to this size are joined with themselves; larger ones get longer keys first.
GROUP = 32
_ROWS = 1 << 15


def fingerprint(raw: bytes, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the ``width``-word shingles' XXH64, repeats included; 0 without words."""
    words = raw.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    if len(words) <= width:
        digests = [xxhash.xxh64_digest(text, 42)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        lo = np.concatenate([[0], ends[: len(words) - width]]).tolist()
        hi = (ends[width - 1 :] - 1).tolist()
        of = xxhash.xxh64_digest
        digests = [of(text[a:b], 42) for a, b in zip(lo, hi, strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(digests), _ROWS):
        part = digests[k : k + _ROWS]
        total += np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(len(part), 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(digests)).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long, one row for each input row."""
    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint(raw.as_py(), width) for raw in b.column(1)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "fp"])

    return df.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(run, schema)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def chain_masks(m: int, t: int) -> list[list[int]]:
    """For each start, the masks of its first 1 .. m segments."""
    cuts = [64 * k // m for k in range(m + 1)]
    seg = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(m)]
    out = []
    for i in range(m):
        masks, at = [], 0
        for k in range(m):
            at |= seg[(i + k) % m]
            masks.append(at)
        out.append(masks)
    return out


def longer_keys(m: int = SEGMENTS) -> list[list[list[int]]]:
    """Masks of join keys by level; a level lists, for each mask of the one before, the masks that split its groups.

    For seven segments and two bits.  Three equal segments begin a chain.  Of the next three two are equal,
    for they differ in at most one bit together: three masks of five segments.  Of the two that are left either the
    first is equal, or both differ in one bit at most, so that a half of each is equal: five masks, whose groups cannot
    have more than 1,024 members, as at most ten bits are free.
    """
    cuts = [64 * k // m for k in range(m + 1)]
    bits = lambda a, b: ((1 << b) - 1) ^ ((1 << a) - 1)
    seg = [bits(cuts[k], cuts[k + 1]) for k in range(m)]
    halves = [(bits(a, (a + b) // 2), bits((a + b) // 2, b)) for a, b in zip(cuts, cuts[1:])]
    starts, some, most = [], [], []
    for i in range(m):
        k = [(i + j) % m for j in range(m)]
        starts.append(seg[k[0]] | seg[k[1]] | seg[k[2]])
        some.append([])
        for e in (3, 4, 5):
            base = starts[i]
            for j in {3, 4, 5} - {e}:
                base |= seg[k[j]]
            some[i].append(base)
            most.append([base | seg[k[e]], *(base | x | y for x in halves[k[e]] for y in halves[k[6]])])
    return [[starts], some, most]


def links(fps: DataFrame, group: int = GROUP) -> DataFrame:
    """Edges (u > v): all pairs within two bits.

    ``fps``: distinct longs in a column fp.  Groups of a key up to ``group`` members are joined: at most
    ``group`` / 2 pairs for each row.  Members of a larger group go on with the longer keys of
    :func:`longer_keys`; groups of the longest are joined whole, being bounded by their free bits.
    """
    chains = chain_masks(SEGMENTS, DISTANCE)
    levels = longer_keys()
    x = F.col("u").bitwiseXOR(F.col("v"))
    budget = F.lit(True)
    for ln in range(4, SEGMENTS):  # three segments are equal
        at = F.element_at(F.array(*(F.lit(signed(ms[ln - 1])) for ms in chains)), F.col("i") + 1)
        budget = budget & (F.bit_count(x.bitwiseAND(at)) <= ln * DISTANCE // SEGMENTS)
    found, rows = None, fps.select("fp", F.lit(0).alias("of"))
    for depth, masks in enumerate(levels):
        width = len(masks[0])
        keys = F.array(*(F.col("fp").bitwiseAND(F.element_at(F.array(*(F.lit(signed(ms[h])) for ms in masks)), F.col("of") + 1)) for h in range(width)))
        keyed = rows.select("fp", "of", F.posexplode(keys).alias("h", "key")).select("fp", (F.col("of") * width + F.col("h")).alias("i"), "key")
        sized = keyed.join(keyed.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1"), ["i", "key"])
        last = depth == len(levels) - 1
        small = sized if last else sized.where(F.col("n") <= group)
        a, b = small.select("i", "key", F.col("fp").alias("v")), small.select("i", "key", F.col("fp").alias("u"))
        pairs = a.join(b, ["i", "key"]).where((F.col("u") > F.col("v")) & (F.lit(True) if depth else budget) & (F.bit_count(x) <= DISTANCE)).select("u", "v")
        found = pairs if found is None else found.union(pairs)
        if not last:
            rows, seen = stage_measured(sized.where(F.col("n") > group).select("fp", F.col("i").alias("of")), "hot", F.count(F.lit(1)).alias("n"))
            if not seen["n"]:
                break
    return found.distinct()


def _lowest(fps: DataFrame) -> DataFrame:
    """fp, root: the component of every distinct fingerprint."""
    roots = components(links(fps.select("fp")))
    return fps.select("fp").join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest id reachable over links of at most two bits.

    A text without words (null, empty, white space) has fingerprint zero and links
    like any other.  Null ids get a component from the other members' ids (null if
    none has one); repeated rows share a component; an empty table gives no
    rows; other columns are not read.
    """
    docs = stage(fingerprints(df, id_col, text_col, width), "fingerprints")
    fps = stage(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    placed = fps.join(_lowest(fps), "fp")
    lowest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    of = placed.select("fp", "root").join(lowest, "root").select("fp", "component_id")
    return docs.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row of each near-duplicate group, with all its columns: that of the smallest id (a null id comes last; of repeated ids one row).

    Rows are told apart by file and row number of a staged copy; the last join takes away
    the rows that go, so that texts move only if even those are too many to broadcast.
    """
    at = df.columns.index(text_col)
    fp, file, row = fresh(df.columns, "__fp", "__file", "__row")
    schema = T.StructType([*df.schema.fields, T.StructField(fp, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.array([fingerprint((t.as_py() or "").encode(), width) for t in b.column(at)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got)], names=schema.fieldNames())

    rows = stage(df.mapInArrow(run, schema), "documents").withColumn(file, F.col("_metadata.file_name")).withColumn(row, F.col("_metadata.row_index"))
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col(file).alias("file"), F.col(row).alias("row"))
    fps = stage(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(order).alias("least")), "fps")
    chosen = fps.join(_lowest(fps), "fp").groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.file").alias(file), F.col("least.row").alias(row))
    gone = stage(rows.select(file, row).join(chosen, [file, row], "left_anti"), "gone")
    return rows.join(gone, [file, row], "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))
