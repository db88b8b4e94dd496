"""Text helpers with no built-in counterpart: Unicode NFC and sequence similarity, in Arrow batches."""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def nfc(col: Column) -> Column:
    """NFC form; plain ASCII values never reach Python."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    return F.when(F.octet_length(col) == F.char_length(col), col).otherwise(run(col))


def similarity(a: Column, b: Column) -> Column:
    """Matching-block ratio of two strings, 0 to 1."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, q, p).ratio() if p is not None and q is not None else None for p, q in zip(x, y)], dtype="float64")

    return run(a, b)
