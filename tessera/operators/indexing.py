"""Index tables: one row for each entity, or for each course of an entity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import date_parts, window_filter


def _named(name: str, code: str) -> str:
    return f"{name}_{code}" if code else name


def index_table(
    df: DataFrame,
    index: Sequence[str] | str,
    date: str,
    code: str,
    *,
    stop: str | None = None,
    retained: Sequence[str] = (),
    sort_fields: Sequence[str] = (),
    start: object = None,
    end: object = None,
    max_gap: int | None = None,
    last_mode: str = "latest_start",
    distinct_days: str = "exact",
    first_label: str = "index_",
    last_label: str = "last_",
) -> DataFrame:
    """First and last dates, entries and distinct dates of every entity; with ``max_gap`` of every course.

    ``last_`` is the stop of the latest-starting row, or with ``last_mode='max'`` the
    largest stop; a stop before its start, or none, counts as the start.  Retained
    columns come from the earliest row; ties go by ``sort_fields``, then by a hash of the retained columns.  Courses
    are split where the next start is more than ``max_gap`` days after a stop; the latest course is 0, and a
    row that stops at the entity's ``last_`` ends none.  Without courses this is one
    aggregation and no window.  ``distinct_days='set'`` counts dates in a set, for one
    exchange where an entity has few.
    """
    keys = [index] if isinstance(index, str) else list(index)
    df = date_parts(df, date, keys, flags=False)
    if start is not None or end is not None:
        df = df.where(F.col(date).isNotNull() & window_filter(F.col(date), start, end))
    retained = [c for c in retained if c in df.columns and c not in keys]
    begun = F.col(date)
    ended = F.greatest(F.coalesce(F.col(stop), begun), begun) if stop else begun
    tie = [F.col(c) for c in sort_fields] + ([F.xxhash64(*retained)] if retained else [])
    first, last, entries, days = first_label + code, last_label + code, _named("entries", code), _named("encounter_days", code)
    if max_gap is None:
        kept = [F.min_by(F.struct(*retained), F.struct(begun.isNull(), begun, *tie)).alias("__kept")] if retained else []
        out = df.groupBy(*keys).agg(
            F.min(begun).alias(first), _last(begun, ended, last_mode).alias(last), F.count("*").alias(entries),
            (F.size(F.collect_set(begun)) if distinct_days == "set" else F.count_distinct(begun)).cast("long").alias(days), *kept,
        )
        return out.select(*keys, *(F.col(f"__kept.{c}").alias(c) for c in retained), first, last, entries, days)
    return _courses(df, keys, begun, ended, tie, retained, max_gap, last_mode, code, first_label, last_label, (first, last, entries, days))


def _last(begun: Column, ended: Column, mode: str) -> Column:
    if mode == "max":
        return F.max(ended)
    if mode != "latest_start":
        raise ValueError(f"unknown last_mode {mode!r}")
    return F.max_by(ended, F.when(begun.isNotNull() & ended.isNotNull(), F.struct(begun, ended)))


def _courses(df, keys, begun, ended, tie, retained, max_gap, last_mode, code, first_label, last_label, names) -> DataFrame:
    """One window over an entity's rows in descending order numbers the courses; a second aggregation sums them up."""
    first, last, entries, days = names
    course, gap, course_days = _named("course_of_therapy", code), _named("max_gap", code), _named("encounter_days_for_course", code)
    begin_course, end_course = f"{first_label}therapy_{code}", f"{last_label}therapy_{code}"
    rows = df.select(*keys, begun.alias("__begun"), ended.alias("__ended"), F.struct(*(F.col(c) for c in retained), F.lit(0).alias("__none")).alias("__kept"), F.struct(*tie, F.lit(0).alias("__none")).alias("__tie"))
    # one row for each date of an entity: the one that stops last, then by the tie-break
    daily = rows.groupBy(*keys, "__begun").agg(F.max("__ended").alias("__ended"), F.count("*").alias("__n"), F.min_by("__kept", "__tie").alias("__kept"))
    whole = Window.partitionBy(*keys)
    back = whole.orderBy(F.desc_nulls_first("__begun"))
    daily = daily.withColumns(
        {
            first: F.min("__begun").over(whole), last: _last(F.col("__begun"), F.col("__ended"), last_mode).over(whole), entries: F.sum("__n").over(whole),
            days: F.count("__begun").over(whole), "__next": F.datediff(F.lag("__begun").over(back), F.col("__ended")),
        }
    )
    ends = ~(F.coalesce(F.col("__next") <= max_gap, F.lit(False)) | F.coalesce(F.col("__ended") == F.col(last), F.lit(False)))
    daily = daily.withColumn("__ends", ends).withColumn(course, F.sum(F.col("__ends").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    out = daily.groupBy(*keys, course).agg(
        *(F.any_value(c).alias(c) for c in (first, last, entries, days)),
        F.min("__begun").alias(begin_course), _last(F.col("__begun"), F.col("__ended"), last_mode).alias(end_course),
        F.count("__begun").alias(course_days), F.max(F.when(~F.col("__ends"), F.col("__next"))).alias(gap), F.min_by("__kept", F.struct(F.col("__begun").isNull(), "__begun")).alias("__kept"),
    )
    return out.select(*keys, *(F.col(f"__kept.{c}").alias(c) for c in retained), first, last, entries, days, course, begin_course, end_course, course_days, gap)


def usage(df: DataFrame, fields: Sequence[str], dates: Sequence[str], start: object = None, end: object = None, count_name: str = "count", first_name: str = "first_date", last_name: str = "last_date") -> DataFrame:
    """Number, first and last of the coalesced dates in an inclusive window, for each combination of ``fields``."""
    at = F.coalesce(*(F.col(d) for d in dates))
    cond = window_filter(at, start, end)
    known = df.where(at.isNotNull() & cond) if cond is not None else df
    return known.groupBy(*fields).agg(F.count("*").alias(count_name), F.min(at).alias(first_name), F.max(at).alias(last_name))
