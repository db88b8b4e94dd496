"""Entity extraction: records of a source for the entities of an index."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import window_filter


def resolve_collisions(source: DataFrame, index: DataFrame, keys: Sequence[str], policy: str = "exclude", master: Sequence[str] = ()) -> DataFrame:
    """The source without columns that the index has too, but for keys and ``master`` columns; policy ``raise`` refuses clashes."""
    clash = [c for c in source.columns if c in index.columns and c not in keys]
    if policy == "raise":
        if clash:
            raise ValueError(f"both sides have {clash}")
    elif policy != "exclude":
        raise ValueError(f"unknown collision policy {policy!r}")
    return source.drop(*(c for c in clash if c not in master))


def extract(
    source: DataFrame,
    index: DataFrame,
    keys: Sequence[str],
    *,
    date: str | None = None,
    reference: str | None = None,
    start: object = None,
    stop: object = None,
    how: str = "inner",
    broadcast: bool | None = None,
    cohort: DataFrame | None = None,
    cohort_keys: Sequence[str] | None = None,
    cohort_columns: Sequence[str] = (),
    collisions: str = "exclude",
    keep_unmatched: bool = True,
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """Records of ``source`` whose keys are in ``index``, inside an optional window, of an optional cohort.

    The source stands on the left.  Of clashing columns the index side's stays.  Bounds
    that are whole numbers count days from ``reference``, a column of the index; any other bound is absolute and
    needs no reference; one bound alone is fine.  In a left join, rows without an index side stay if
    ``keep_unmatched``.  ``broadcast`` None leaves the join to the optimiser.
    """
    if not isinstance(index, DataFrame):
        raise ValueError("the element list must be a DataFrame")
    source = resolve_collisions(source, index, keys, collisions)
    if cohort is not None:
        on = list(cohort_keys or keys)
        if cohort_columns:
            extra = [c for c in cohort_columns if c not in on]
            source = source.drop(*extra).join(cohort.select(*on, *extra).distinct(), on)
        else:
            source = source.join(cohort.select(*on), on, "left_semi")
    side = index.distinct()
    out = source.join(F.broadcast(side) if broadcast else side, list(keys), how)
    if start is not None or stop is not None:
        if date is None:
            raise ValueError("a window needs the source's date column")
        cond = window_filter(F.col(date), start, stop, F.col(reference) if reference else None)
        if how in ("left", "leftouter", "left_outer") and keep_unmatched and reference:
            cond = F.col(reference).isNull() | cond
        out = out.where(cond)
    return out.select(*fields) if fields else out


def attach(spine: DataFrame, features: Mapping[str, DataFrame] | Sequence[DataFrame], keys: Sequence[str], collisions: str = "raise") -> DataFrame:
    """Left-join feature tables onto a spine, one after another, on the same keys."""
    for f in features.values() if isinstance(features, Mapping) else features:
        clash = [c for c in f.columns if c in spine.columns and c not in keys]
        if clash and collisions == "raise":
            raise ValueError(f"both sides have {clash}")
        spine = spine.join(f.drop(*clash), list(keys), "left")
    return spine


def overlap(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities of both tables, with the left's columns and those that only the right has."""
    return extract(left, right.select(*keys, *(c for c in right.columns if c not in left.columns)), keys)


def with_level(df: DataFrame, level: str, value: object, index: Sequence[str]) -> DataFrame:
    """Distinct index of the rows at one level."""
    return df.where(F.col(level) == F.lit(value)).select(*index).distinct()


def sample_of_tenant(df: DataFrame, tenant: object, n: int, sort: Sequence[str] = (), ascending: bool = True, column: str = "tenant") -> DataFrame:
    """The first rows of one tenant; sorted if all sort columns are there."""
    some = df.where(F.col(column) == F.lit(tenant).cast(df.schema[column].dataType))
    return (some.orderBy(*sort, ascending=ascending) if sort and all(c in df.columns for c in sort) else some).limit(n)


def rows_of_top(df: DataFrame, sort: str, entity: str) -> DataFrame:
    """All rows of the entity that has the row of the largest sort value (ties: the smallest entity)."""
    top = df.where(F.col(sort).isNotNull()).orderBy(F.desc(sort), F.asc(entity)).limit(1).select(entity)
    return df.join(F.broadcast(top), entity, "left_semi")
