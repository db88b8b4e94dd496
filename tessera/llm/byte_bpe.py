"""Byte-level BPE with the tiktoken library: local rank file, safe pre-splitting of long texts, raw-byte decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import utf8

LONG = 1 << 16
#: A space after a letter or digit: no match of the split pattern holds it but as its first character.
SAFE = re.compile(r"(?<=[A-Za-z0-9]) ")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once in each worker process."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, most: int = LONG) -> Iterator[str]:
    """Cut a long text before spaces that must begin a match, so that the parts' ids concatenate to the text's."""
    lo = 0
    while len(text) - lo > most:
        m = SAFE.search(text, lo + most)
        if m is None:
            break
        yield text[lo : m.start()]
        lo = m.start()
    yield text[lo:]


def encode(enc, text: str) -> np.ndarray:
    """Ids as little-endian unsigned 32-bit integers."""
    parts = [enc.encode_to_numpy(p, disallowed_special=()) for p in safe_parts(text)]
    return (parts[0] if len(parts) == 1 else np.concatenate(parts)).astype("<u4", copy=False)


def encode_documents(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text: id, ids (array<int>, if kept), n_tokens, ids_sha256, decoded_sha256, same.

    ``same`` tells whether the decoded bytes equal the text's.  A null text is
    empty and has no ids.  Repeated and null ids are kept as they come; an empty
    table gives no rows; other columns are not read.  One pass without a shuffle.
    """
    key = df.schema[id_col].dataType
    fields = [T.StructField("doc_id", key)] + ([T.StructField("ids", T.ArrayType(T.IntegerType()))] if keep_ids else [])
    fields += [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("same", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            n, ids_sha, dec_sha, same, kept = [], [], [], [], []
            for raw in batch.column(1):
                raw = raw.as_py()
                ids = encode(enc, raw.decode("utf-8", "replace"))
                back = enc.decode_bytes(ids.tolist())
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                dec_sha.append(hashlib.sha256(back).hexdigest())
                same.append(back == raw)
                if keep_ids:
                    kept.append(ids.astype(np.int32))
            cols = [batch.column(0)] + ([pa.array(kept, pa.list_(pa.int32()))] if keep_ids else [])
            cols += [pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return df.select(F.col(id_col).alias("doc_id"), utf8(text_col).alias("raw")).mapInArrow(run, T.StructType(fields))
