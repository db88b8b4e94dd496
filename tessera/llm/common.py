"""Helpers shared by the training-data operators.

Texts travel to Python workers as UTF-8 bytes in Arrow batches.  Anything an
operator reads twice is written once as Parquet below ``spark.checkpoint.dir``
(:func:`stage`), which every executor sees, so a lost executor costs only its
own tasks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import own_folder


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset a temporary one, in a local session only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessera.shared.dir", None)
    if not found:
        found = own_folder(spark)
        spark.conf.set("tessera.shared.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; cuts lineage and recomputation.

    The folder goes when the driver's JVM ends in order.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def stage_measured(df: DataFrame, label: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """:func:`stage`, and aggregates of the rows written."""
    df = stage(df, label)
    return df, df.agg(*metrics).first().asDict()


def utf8(col: Column | str) -> Column:
    """The text's UTF-8 bytes; a null text is empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col.cast("binary"), F.lit(b"").cast("binary"))


def fresh(names: list[str], *bases: str) -> list[str]:
    """Column names like ``bases`` that a frame with ``names`` does not have."""
    taken, out = {n.lower() for n in names}, []
    for b in bases:
        while b.lower() in taken:
            b += "_"
        taken.add(b.lower())
        out.append(b)
    return out


def buffer_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary array without copying; row i is ``bytes[offsets[i]:offsets[i + 1]]``."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]] if len(offs) else data[:0], offs - (offs[0] if len(offs) else 0)


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes each (a longer row stands alone), to bound numpy temporaries."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        out.append((lo, min(hi, n)))
        lo = min(hi, n)
    return out


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small bounded list as a DataFrame, without Python on the executors."""
    import json

    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).fieldNames()
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{', '.join(f'{n}: {t}' for n, t in (x.split(' ', 1) for x in schema.split(', ')))}>>")).alias("r")).select("r.*")
