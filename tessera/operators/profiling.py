"""Attrition, samples, top entities and counts over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Named lists of dates to mark, and period names.
SURGES = {
    "COVID-19": ("2020-03-01", "2020-07-01", "2020-11-01", "2021-01-01", "2021-12-01", "2022-08-01"),
    "COVID-19 Vaccine": ("2020-12-14", "2021-04-19", "2021-08-13", "2021-09-20", "2021-11-19", "2022-03-29", "2022-09-02"),
}
GRAINS = ("year", "quarter", "month", "week", "day", "hour")


def attrition(df: DataFrame, person: str = "personid", dates: Sequence[str] = ()) -> DataFrame:
    """Rows, distinct persons, and the first and last of all dates: one aggregation."""
    aggs = [F.count("*").alias("n_rows"), F.count_distinct(person).alias("n_persons")]
    if dates:
        cols = [F.col(d) for d in dates]
        lo, hi = (F.least(*cols), F.greatest(*cols)) if len(cols) > 1 else (cols[0], cols[0])
        aggs += [F.min(lo).alias("first_date"), F.max(hi).alias("last_date")]
    return df.agg(*aggs)


def count_people(df: DataFrame, person: str = "personid", name: str = "n_persons") -> DataFrame:
    return df.agg(F.count_distinct(person).alias(name))


def sample(df: DataFrame, n: int = 10, sort: Sequence[str] = (), ascending: bool = True) -> DataFrame:
    """The first rows, sorted if all sort columns are there."""
    return (df.orderBy(*sort, ascending=ascending) if sort and all(c in df.columns for c in sort) else df).limit(n)


def top_entities(df: DataFrame, entity: str, n: int, date: str | None = None, after: object = None, until: object = None) -> DataFrame:
    """Rows in (after, until] of the ``n`` entities most frequent there; ties by entity."""
    rows = df
    if date and after is not None:
        rows = rows.where(F.col(date) > F.lit(after))
    if date and until is not None:
        rows = rows.where(F.col(date) <= F.lit(until))
    top = rows.groupBy(entity).agg(F.count("*").alias("__n")).orderBy(F.desc("__n"), entity).limit(n).select(entity)
    return rows.join(F.broadcast(top), entity, "left_semi")


def time_counts(df: DataFrame, date: str, grain: str = "month", groups: Sequence[str] = (), start: object = None, end: object = None, proportion: bool = False, distinct: str | None = None) -> DataFrame:
    """Rows (or distinct values) for each period and group, on request as the share of the period."""
    if grain not in GRAINS:
        raise ValueError(f"grain {grain!r} is none of {GRAINS}")
    rows = df.where(F.col(date).isNotNull())
    rows = rows.where(F.col(date) >= F.lit(start)) if start is not None else rows
    rows = rows.where(F.col(date) <= F.lit(end)) if end is not None else rows
    out = rows.groupBy(F.date_trunc(grain, date).alias("period"), *groups).agg((F.count_distinct(distinct) if distinct else F.count("*")).alias("count"))
    return out.withColumn("proportion", F.col("count") / F.sum("count").over(Window.partitionBy("period"))) if proportion else out
