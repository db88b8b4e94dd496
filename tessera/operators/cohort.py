"""Cohort recipes: inclusion, exclusion, observation, exposure, follow-up and baseline, each one small plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import window_filter


def min_occurrences(df: DataFrame, keys: Sequence[str], date: str, least: int, within_days: int | None = None) -> DataFrame:
    """Entities with at least ``least`` records, on request within so many days of each other."""
    if within_days is None:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least).select(*keys)
    later = F.lead(date, least - 1).over(Window.partitionBy(*keys).orderBy(date))
    return df.withColumn("__days", F.datediff(later, F.col(date))).where(F.col("__days") <= within_days).select(*keys).distinct()


def exclude(index: DataFrame, events: DataFrame, keys: Sequence[str], index_date: str, event_date: str, before: int | None = None, after: int | None = 0, any_time: bool = False) -> DataFrame:
    """The index without entities that have an event in [index - before, index + after]; a null bound is open."""
    e = events.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col(event_date).alias("__at"))
    cond = [F.col(k) == F.col(f"__{k}") for k in keys]
    if not any_time:
        gap = F.datediff(F.col("__at"), F.col(index_date))
        cond += ([gap >= -before] if before is not None else []) + ([gap <= after] if after is not None else [])
    return index.join(e, cond, "left_anti")


def age_limits(df: DataFrame, birth: str, at: str, least: int | None = None, most: int | None = None) -> DataFrame:
    from ..functions.demographics import age_at

    age = age_at(F.col(birth), F.col(at))
    cond = [age >= least] * (least is not None) + [age <= most] * (most is not None)
    for c in cond:
        df = df.where(c)
    return df


def observed(index: DataFrame, span: DataFrame, keys: Sequence[str], index_date: str, first: str, last: str, baseline_days: int = 0, follow_days: int = 0) -> DataFrame:
    """Index rows observed so many days before and after the index date, by the first and last encounter."""
    rows = index.join(span.select(*keys, first, last), list(keys))
    return rows.where((F.datediff(F.col(index_date), F.col(first)) >= baseline_days) & (F.datediff(F.col(last), F.col(index_date)) >= follow_days))


def both_criteria(first: DataFrame, second: DataFrame, keys: Sequence[str], order: Column | None = None, demographics: DataFrame | None = None) -> DataFrame:
    """Entities of two index tables, under a condition on their dates, with demographics where known."""
    out = first.join(second, list(keys))
    out = out.where(order) if order is not None else out
    return out.join(demographics, list(keys), "left") if demographics is not None else out


def around_index(events: DataFrame, index: DataFrame, keys: Sequence[str], date: str, index_date: str, before: int, after: int) -> DataFrame:
    """Events from ``before`` days before the index to ``after`` days after it."""
    return events.join(index.select(*keys, index_date), list(keys)).where(window_filter(F.col(date), -before, after, F.col(index_date)))


def high_users(usage: DataFrame, count: str, threshold: int) -> DataFrame:
    return usage.where(F.col(count) >= threshold)


def exposure_summary(df: DataFrame, keys: Sequence[str], date: str, max_gap: int, stop: str | None = None, code: str = "exposure") -> DataFrame:
    """First, last and total exposure, number of courses, and the longest break between them."""
    from .indexing import index_table

    c = index_table(df, keys, date, code, stop=stop, max_gap=max_gap)
    order = Window.partitionBy(*keys).orderBy(f"index_therapy_{code}")
    c = c.withColumn("__break", F.datediff(F.lead(f"index_therapy_{code}").over(order), F.col(f"last_therapy_{code}")))
    return c.groupBy(*keys).agg(
        F.min(f"index_{code}").alias("first_exposure"), F.max(f"last_{code}").alias("last_exposure"), F.max(f"entries_{code}").alias("total_exposures"), F.count("*").alias("n_courses"), F.max("__break").alias("longest_break"), F.lit(1).alias("ever_exposed")
    )


def days_covered(df: DataFrame, keys: Sequence[str], start: str, stop: str, index: DataFrame, index_date: str, days: int = 365) -> DataFrame:
    """Proportion of the days after the index that any interval covers.

    Intervals are clipped and merged by a running maximum, so no row is made for a day.
    """
    first, last = F.to_date(index_date), F.date_add(F.to_date(index_date), days - 1)
    rows = df.join(index.select(*keys, index_date), list(keys)).select(*keys, F.greatest(F.to_date(start), first).alias("a"), F.least(F.to_date(stop), last).alias("b")).where("a <= b")
    order = Window.partitionBy(*keys).orderBy("a", "b")
    reached = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.col("a"), F.coalesce(F.date_add(reached, 1), F.col("a")))
    out = rows.withColumn("__n", F.greatest(F.datediff(F.col("b"), fresh) + 1, F.lit(0)))
    covered = out.groupBy(*keys).agg(F.sum("__n").alias("covered_days"))
    return index.select(*keys).distinct().join(covered, list(keys), "left").select(*keys, F.coalesce("covered_days", F.lit(0)).cast("long").alias("covered_days"), (F.coalesce("covered_days", F.lit(0)) / F.lit(days)).alias("pdc"))


def controlled_at(values: DataFrame, index: DataFrame, keys: Sequence[str], value: str, date: str, index_date: str, threshold: float, first_day: int = 335, last_day: int = 395) -> DataFrame:
    """The last value in a window after the index, and whether it is below the threshold."""
    rows = values.join(index.select(*keys, index_date), list(keys)).where(window_filter(F.col(date), first_day, last_day, F.col(index_date)))
    out = rows.groupBy(*keys).agg(F.max_by(value, F.struct(date, value)).alias("target_value"))
    return out.withColumn("controlled", F.col("target_value") < threshold)


def time_to_event(index: DataFrame, events: DataFrame, keys: Sequence[str], index_date: str, event_date: str, censor: Sequence[str]) -> DataFrame:
    """Days from the index to the first later event, or else to the earliest censoring date."""
    e = events.select(*keys, F.col(event_date).alias("__at")).join(index.select(*keys, index_date), list(keys)).where(F.col("__at") > F.col(index_date))
    first = e.groupBy(*keys).agg(F.min("__at").alias("event_at"))
    out = index.join(first, list(keys), "left")
    limit = F.least(*(F.col(c) for c in censor)) if len(censor) > 1 else F.col(censor[0])
    has = F.col("event_at").isNotNull() & (limit.isNull() | (F.col("event_at") <= limit))
    return out.withColumn("event", has.cast("int")).withColumn("time_days", F.datediff(F.when(has, F.col("event_at")).otherwise(limit), F.col(index_date)))


def baseline_value(values: DataFrame, index: DataFrame, keys: Sequence[str], test: str, value: str, date: str, index_date: str, days: int, how: str = "closest_to_index") -> DataFrame:
    """Per entity and test the closest, first, last or mean value of the look-back window, in one aggregation."""
    rows = values.join(index.select(*keys, index_date), list(keys)).where(window_filter(F.col(date), -days, 0, F.col(index_date)))
    at = F.struct(date, value)
    pick = {"closest_to_index": F.max_by(value, at), "last": F.max_by(value, at), "first": F.min_by(value, at), "mean": F.avg(value)}
    return rows.groupBy(*keys, test).agg(pick[how].alias("baseline_value"), F.count("*").alias("baseline_n"))


def comorbidity_flags(events: DataFrame, index: DataFrame, keys: Sequence[str], code: str, date: str, index_date: str, patterns: Mapping[str, str], days: int | None = None, kind: str = "prefix") -> DataFrame:
    """0/1 for each condition whose codes occur in the look-back; every index entity has a row."""
    from .codes import matches

    rows = index.select(*keys, index_date).join(events.select(*keys, code, date), list(keys), "left")
    gap = F.datediff(F.col(index_date), F.col(date))
    inside = (gap >= 0) & (gap <= days) if days is not None else gap >= 0
    return rows.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(inside & matches(F.col(code), F.lit(p), kind), 1)), F.lit(0)).alias(n) for n, p in patterns.items()))


def encounter_counts(events: DataFrame, index: DataFrame, keys: Sequence[str], kind: str, date: str, index_date: str, kinds: Sequence[str], days: int) -> DataFrame:
    """Look-back counts by type; every index entity has a row."""
    rows = index.select(*keys, index_date).join(events.select(*keys, kind, date), list(keys), "left")
    inside = F.datediff(F.col(index_date), F.col(date)).between(0, days)
    return rows.groupBy(*keys).agg(*(F.count(F.when(inside & (F.col(kind) == k), 1)).alias(f"n_{k}") for k in kinds))


def attrition_table(steps: Sequence[tuple[str, DataFrame]], key: str) -> DataFrame:
    """step, name, n, excluded, percent remaining: one aggregate for each step, then a lag over that handful of rows."""
    parts = [df.agg(F.count_distinct(key).alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("name"), "n") for i, (name, df) in enumerate(steps)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    order = Window.orderBy("step")
    first = F.first("n").over(order)
    return out.select("step", "name", "n", F.coalesce(F.lag("n").over(order) - F.col("n"), F.lit(0)).alias("excluded"), F.round(100.0 * F.col("n") / first, 2).alias("percent_remaining"))


def analytic_dataset(index: DataFrame, keys: Sequence[str], first: str, last: str, parts: Sequence[DataFrame] = ()) -> DataFrame:
    """The index with follow-up days and its left-joined parts."""
    out = index.withColumn("followup_days", F.datediff(F.col(last), F.col(first)))
    for p in parts:
        out = out.join(p, list(keys), "left")
    return out
