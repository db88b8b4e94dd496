"""Calendar parts with explicit unknowns, and date windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = -1
PARTS = {"year": F.year, "month": F.month}


def as_date(df: DataFrame, name: str) -> Column:
    """A column as a date; text that is not a date is null instead of an error."""
    return F.expr(f"try_to_date(`{name}`)") if isinstance(df.schema[name].dataType, T.StringType) else F.to_date(F.col(name))


def date_parts(df: DataFrame, dates: str | Sequence[str] | None, grain: Sequence[str], flags: bool = True) -> DataFrame:
    """Add the ``year`` / ``month`` that the grain names and the frame lacks, from the first known date.

    Unknown parts are -1, so that joins keep them; ``<part>_is_unknown`` says so.
    """
    wanted = [p for p in PARTS if p in grain and p not in df.columns]
    if not wanted:
        return df
    if not dates:
        raise ValueError(f"{wanted} need a date column to come from")
    names = [dates] if isinstance(dates, str) else list(dates)
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"no date column {missing}")
    first = F.coalesce(*(as_date(df, n) for n in names))
    cols = {p: F.coalesce(PARTS[p](first), F.lit(UNKNOWN)).cast("int") for p in wanted}
    if flags:
        cols |= {f"{p}_is_unknown": first.isNull() for p in wanted}
    return df.withColumns(cols)


def mark_unknown(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace null calendar parts by -1."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(UNKNOWN)).cast("int") for c in columns if c in PARTS and c in df.columns})


def window_filter(date: Column, start: object = None, stop: object = None, reference: Column | None = None) -> Column | None:
    """Inclusive window: whole numbers are days from ``reference``, anything else is a bound by itself; None without bounds."""
    out = None
    for bound, lower in ((start, True), (stop, False)):
        if bound is None:
            continue
        if isinstance(bound, int) and not isinstance(bound, bool):
            if reference is None:
                raise ValueError("a window in days needs a reference date")
            at = F.date_add(reference, bound)
            cond = (F.to_date(date) >= at) if lower else (F.to_date(date) <= at)
        else:
            cond = (date >= F.lit(bound)) if lower else (date <= F.lit(bound))
        out = cond if out is None else out & cond
    return out
