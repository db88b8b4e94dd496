"""Long measurements to one row for each entity: lab distillation, baseline flags, measurement features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import as_date


def distill(
    df: DataFrame,
    value: str,
    date: str,
    index: Sequence[str],
    code: str = "lab",
    *,
    test: str | None = None,
    tests: Sequence[str] | None = None,
    reference: str | None = None,
    invalid: str | None = None,
    unit: str | None = None,
    post_days: int | None = None,
    median: str = "approx",
    mixed_units: str = "count",
) -> DataFrame:
    """One row for each entity from one aggregation: counts, extremes, median, dates, first and last value, and pre/post peaks.

    Values that are no numbers and dates that are none drop their row; an unknown
    ``invalid`` flag counts as valid.  Pre is before the reference day, post from it on (up to ``post_days``).
    With ``unit``: the smallest unit and ``<code>_unit_n``; ``mixed_units='raise'`` fails an entity with several.
    ``median``: ``approx`` returns an observed value, ``exact`` interpolates.
    """
    v, d = F.expr(f"try_cast(`{value}` as double)"), as_date(df, date)
    rows = df.where(~F.coalesce(F.col(invalid), F.lit(False))) if invalid else df
    if tests is not None:
        rows = rows.where(F.col(test).isin(list(tests)))
    rows = rows.withColumn("__v", v).withColumn("__d", d).withColumn("__at", F.col(date)).where("__v is not null and __d is not null")
    at = F.struct("__at", "__v")
    aggs: dict[str, Column] = {
        "n": F.count("__v"), "min": F.min("__v"), "max": F.max("__v"),
        "median": F.percentile("__v", F.lit(0.5)) if median == "exact" else F.percentile_approx("__v", 0.5),
        "peak": F.max("__v"), "first_date": F.min("__d"), "last_date": F.max("__d"), "first_value": F.min_by("__v", at), "last_value": F.max_by("__v", at),
    }
    if unit:
        if mixed_units == "raise":
            several = F.min(unit) != F.max(unit)
            aggs["unit"] = F.when(several, F.raise_error(F.lit(f"more than one {unit} for an entity")).cast("string")).otherwise(F.min(unit))
        else:
            aggs["unit"] = F.min(unit)
        aggs["unit_n"] = F.count_distinct(unit)
    if reference:
        ref = as_date(df, reference)
        pre, post = F.col("__d") < ref, F.col("__d") >= ref
        if post_days is not None:
            post = post & (F.datediff(F.col("__d"), ref) <= post_days)
        aggs |= {
            "pre_peak": F.max(F.when(pre, F.col("__v"))), "post_peak": F.max(F.when(post, F.col("__v"))), "pre_n": F.count(F.when(pre, True)), "post_n": F.count(F.when(post, True)),
            "post_first_date": F.min(F.when(post, F.col("__d"))), "post_last_date": F.max(F.when(post, F.col("__d"))),
        }
    out = rows.groupBy(*index).agg(*(c.alias(f"{code}_{n}") for n, c in aggs.items()))
    return out.withColumn(f"{code}_post_delta", F.col(f"{code}_post_peak") - F.col(f"{code}_pre_peak")) if reference else out


def baseline_flags(source: DataFrame, patients: DataFrame, date: str, ids: Sequence[str], values: Sequence[str] = (), codes: Sequence[str] = (), start: str = "followdate", birth_year: str | None = "yearofbirth", days: int = 365, patient_columns: Sequence[str] = (), only_baseline: bool = False, label: str | None = None) -> DataFrame:
    """Records with ``followed_from_birth`` (a year or less after birth) and ``baseline_period`` (0 to ``days`` days before the start)."""
    mine = list(dict.fromkeys([*ids, start, *([birth_year] if birth_year else []), *patient_columns]))
    rows = source.select(*dict.fromkeys([*ids, date, *values, *codes])).join(patients.select(*mine), list(ids))
    before = F.datediff(F.col(start), F.col(date))
    out = rows.withColumn("baseline_period", before.between(0, days))
    if birth_year:
        out = out.withColumn("followed_from_birth", F.year(date) - F.col(birth_year) <= 1)
    if label:
        out = out.withColumn("baseline_source", F.lit(label))
    return out.where("baseline_period") if only_baseline else out


def features(df: DataFrame, codes: Sequence[str], value: str, date: str, ids: Sequence[str], display: str | None = None, unit: str | None = None, least: int = 1, skip_nulls: bool = True) -> DataFrame:
    """Statistics and trends of every entity and test; statistics and trends share one grouping, so units never fan out.

    One shuffle by the grouping serves the windows and the aggregation.  Same-day values follow each other by value.
    Changes are taken between values that are numbers; without ``skip_nulls`` a missing value comes last on its day and there is
    no change to or from it.
    Means and deviation are taken over the windows, in that order: a sum of doubles depends on it in its last digit, and
    an aggregation adds up parts.
    """
    if unit and unit not in df.columns:
        raise ValueError(f"no unit column {unit!r}")
    groups = list(dict.fromkeys([*ids, *codes, *([display] if display else []), *([unit] if unit else [])]))
    rows = df.withColumn("__v", F.expr(f"try_cast(`{value}` as double)"))
    by = [F.col(date).asc_nulls_last(), F.col("__v").asc_nulls_last()]
    order = Window.partitionBy(*groups).orderBy(*([F.col("__v").isNull()] if skip_nulls else []), *by)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.datediff(F.col(date), F.lag(date).over(order))
    rows = rows.withColumn("__c", F.when(F.col("__v").isNotNull() & (gap > 0), (F.col("__v") - F.lag("__v").over(order)) / gap))
    rows = rows.withColumns({"__mean": F.avg("__v").over(whole), "__dev": F.stddev("__v").over(whole), "__change": F.avg("__c").over(whole)})
    out = rows.groupBy(*groups).agg(
        F.count("*").alias("measurement_count"), F.count_distinct(date).alias("distinct_dates"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
        F.datediff(F.max(date), F.min(date)).alias("date_span"), F.max("__mean").alias("mean_value"), F.max("__dev").alias("stddev_value"), F.min("__v").alias("min_value"),
        F.max("__v").alias("max_value"), F.percentile("__v", F.lit(0.5)).alias("median_value"), F.max("__change").alias("avg_daily_change"), F.min("__c").alias("min_daily_change"), F.max("__c").alias("max_daily_change"),
    ).where(F.col("measurement_count") >= least)
    spread, size = F.col("max_value") - F.col("min_value"), F.abs("mean_value")
    change = F.col("avg_daily_change")
    trend = F.when(F.col("measurement_count") < 2, "insufficient_data").when(change.isNull(), "no_trend").when(change > 0.01, "increasing").when(change < -0.01, "decreasing").otherwise("stable")
    return out.withColumns(
        {
            "value_range": spread, "coefficient_variation": F.when(size != 0, F.col("stddev_value") / size), "normalized_range": F.when(size != 0, spread / size),
            "measurements_per_day": F.when(F.col("date_span") > 0, F.col("measurement_count") / F.col("date_span")).otherwise(F.lit(1.0)), "trend_direction": trend,
        }
    )
