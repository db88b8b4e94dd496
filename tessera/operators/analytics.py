"""Tabulations, summaries, pivots and observed-to-expected signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import gamma


def tabulate(df: DataFrame, groups: Sequence[str] = (), count_distinct: str | Sequence[str] | None = None, order_by: str | None = "count", limit: int | None = 50, dropna: bool = False) -> DataFrame:
    """Counts, and distinct counts as n_<column>, by group; by count descending, by group, or by a named column descending.

    Ties go by the groups.  Without groups the whole frame is one; distinct columns that it lacks are left out.
    """
    names = [count_distinct] if isinstance(count_distinct, str) else list(count_distinct or ())
    if dropna and groups:
        df = df.dropna(subset=list(groups))
    aggs = [F.count("*").alias("count"), *(F.count_distinct(c).alias(f"n_{c}") for c in names if c in df.columns)]
    if not groups:
        return df.agg(*aggs)
    out = df.groupBy(*groups).agg(*aggs)
    order = [F.asc(g) for g in groups]
    if order_by and order_by not in ("group", *groups):
        order = [F.desc(order_by), *order]
    if order_by:
        out = out.orderBy(*order)
    return out.limit(limit) if limit else out


def aggregate_fields(df: DataFrame, index: Sequence[str], values: Sequence[str], functions: Sequence[str], names: Sequence[str] | None = None) -> DataFrame:
    """Named aggregates and the distinct count of index[0], grouped by every other column.

    Values and functions of one length go in pairs; otherwise every value gets every function.
    """
    groups = [c for c in df.columns if c not in index and c not in values]
    pairs = list(zip(values, functions)) if len(values) == len(functions) else [(v, f) for v in values for f in functions]
    names = list(names) if names and len(names) == len(pairs) else [f"{v}_{f}" for v, f in pairs]
    aggs = [F.call_function(f, F.col(v)).alias(n) for (v, f), n in zip(pairs, names)]
    return df.groupBy(*groups).agg(*aggs, F.count_distinct(index[0]).alias(f"{index[0]}_distinct_count"))


def distinct_counts(df: DataFrame, index: Sequence[str], values: Sequence[str] = ()) -> DataFrame:
    """Distinct count of index[0] by every column that is neither index nor value."""
    groups = [c for c in df.columns if c not in index and c not in values]
    return df.groupBy(*groups).agg(F.count_distinct(index[0]).alias(f"{index[0]}_distinct_count"))


def distinct_by(df: DataFrame, field: str | Sequence[str], entity: str | Sequence[str], name: str = "count") -> DataFrame:
    """Distinct entities of each value of ``field``, the most first."""
    groups = [field] if isinstance(field, str) else list(field)
    cols = [entity] if isinstance(entity, str) else list(entity)
    return df.groupBy(*groups).agg(F.count_distinct(*cols).alias(name)).orderBy(F.desc(name), *groups)


def pivot_counts(df: DataFrame, ids: Sequence[str], names_from: str, index: Sequence[str], sort: str | None = None, limit: int | None = None, values: Sequence[str] | None = None) -> DataFrame:
    """Distinct index rows counted by id and pivoted by a column's values; an unknown sort column means the first.

    More values than ``spark.sql.pivotMaxValues`` are an error, as for any pivot.
    """
    rows = df.select(*dict.fromkeys([*ids, names_from, *index])).distinct()
    if values is None:
        most = int(df.sparkSession.conf.get("spark.sql.pivotMaxValues"))
        found = df.select(names_from).where(F.col(names_from).isNotNull()).distinct().limit(most + 1).collect()
        if len(found) > most:
            raise ValueError(f"{names_from} has more than {most} values")
        values = sorted(r[0] for r in found)
    out = rows.groupBy(*ids).pivot(names_from, list(values)).agg(F.count(F.lit(1))).fillna(0, [str(v) for v in values])
    by = sort if sort in out.columns else out.columns[0]
    out = out.orderBy(F.desc(f"`{by}`"), *ids) if sort else out
    return out.limit(limit) if limit else out


def unpivot_indicators(df: DataFrame, ids: Sequence[str], columns: Sequence[str], names_to: str = "name", values_to: str = "value") -> DataFrame:
    """Wide indicators to long rows, of those that are 1."""
    wide = df.select(*ids, *(F.col(c).cast("double").alias(c) for c in columns))
    return wide.unpivot(list(ids), list(columns), names_to, values_to).where(F.col(values_to) == 1)


def five_number_summary(df: DataFrame, index: Sequence[str], groups: Sequence[str], value: str) -> DataFrame:
    """Mean and exact linear quartiles over distinct rows, with distinct index counts; group keys as text."""
    rows = df.select(*dict.fromkeys([*index, *groups, value])).distinct()
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = rows.groupBy(*(F.col(g).cast("string").alias(g) for g in groups)).agg(
        *(F.count_distinct(c).alias(f"Unique_{c}") for c in index), F.avg(value).alias("average"), F.min(value).alias("min"), F.max(value).alias("max"), q.alias("__q")
    )
    return out.withColumns({n: F.col("__q")[i] for i, n in enumerate(("Q1", "median", "Q3"))}).drop("__q")


def log_counts(df: DataFrame, field: str) -> DataFrame:
    return df.groupBy(field).agg(F.count("*").alias("count")).withColumn("log_count", F.ln("count"))


def observed_expected(df: DataFrame, index: Sequence[str], groups: Sequence[str], outcomes: Sequence[str], alpha: float = 1, beta: float = 1, signals: bool = True) -> DataFrame:
    """Observed and expected distinct index counts of every group and outcome, ratios, and gamma posterior signals.

    Margins are null-safe, so that an unknown group or outcome keeps its row; the total is
    one broadcast row; quantiles run in Arrow batches over the contingency table, never on the driver.
    """
    n = lambda cols, name: df.groupBy(*cols).agg(F.count_distinct(*index).alias(name))
    cells = n([*groups, *outcomes], "observed_A")
    out = cells
    for cols, name in ((groups, "group_A_B"), (outcomes, "event_A_C")):
        side = n(cols, name).select(*(F.col(c).alias(f"__{c}") for c in cols), name)
        cond = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols]
        out = out.join(side, cond, "left").drop(*(f"__{c}" for c in cols))
    out = out.crossJoin(F.broadcast(df.agg(F.count_distinct(*index).alias("total_A_B_C_D"))))
    steps = {
        "observed_ratio": F.col("observed_A") / F.col("group_A_B"),
        "prevalence_ratio": F.col("event_A_C") / F.col("total_A_B_C_D"),
        "expected_total": F.col("group_A_B") * F.col("event_A_C") / F.col("total_A_B_C_D"),
        "observed_over_expected": F.col("observed_A") / F.col("expected_total"),
        "alpha_prior": F.lit(float(alpha)), "beta_prior": F.lit(float(beta)),
        "alpha_post": F.col("observed_A") + F.col("alpha_prior"), "beta_post": F.col("expected_total") + F.col("beta_prior"),
        "observed_over_expected_Adj": F.col("alpha_post") / F.col("beta_post"),
    }
    for name, col in steps.items():
        out = out.withColumn(name, col)
    if not signals:
        return out
    a, b = F.col("alpha_post"), F.col("beta_post")
    out = out.withColumns(
        {
            "Percentile05": gamma.gamma_quantile(a, b, 0.05), "Percentile95": gamma.gamma_quantile(a, b, 0.95),
            "observed_pvalue": gamma.ratio_survival(F.col("observed_A"), F.col("expected_total"), F.col("alpha_prior"), F.col("beta_prior")),
            "observed_pvalue_pre": gamma.gamma_survival(a, b, F.col("observed_over_expected_Adj")),
        }
    )
    lo, hi = F.col("Percentile05"), F.col("Percentile95")
    return out.withColumns({"Signal": ~((lo <= 1) & (hi >= 1)), "SignalPositive": lo > 1}).orderBy(F.desc("Percentile05"), *groups, *outcomes)


def proportions(df: DataFrame, groups: Sequence[str], within: Sequence[str], count: str = "count", name: str = "proportion") -> DataFrame:
    """Counts by group and their share inside ``within``."""
    out = df.groupBy(*groups).agg(F.count("*").alias(count))
    return out.withColumn(name, F.col(count) / F.sum(count).over(Window.partitionBy(*within)))


def stratified_baseline(df: DataFrame, strata: Sequence[str], numeric: Sequence[str] = (), levels: Sequence[str] = ()) -> DataFrame:
    """Long baseline table: n, mean and deviation of numeric columns, n and share of levels, by stratum; one pass for each kind."""
    parts = []
    if numeric:
        long = df.select(*strata, *(F.col(c).cast("double").alias(c) for c in numeric)).unpivot(list(strata), list(numeric), "characteristic", "v")
        parts.append(long.groupBy(*strata, "characteristic").agg(F.lit(None).cast("string").alias("level"), F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev("v").alias("sd"), F.lit(None).cast("double").alias("share")))
    if levels:
        long = df.select(*strata, *(F.col(c).cast("string").alias(c) for c in levels)).unpivot(list(strata), list(levels), "characteristic", "level")
        cells = long.groupBy(*strata, "characteristic", "level").agg(F.count("*").alias("n"))
        share = F.col("n") / F.sum("n").over(Window.partitionBy(*strata, "characteristic"))
        parts.append(cells.select(*strata, "characteristic", "level", "n", F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("sd"), share.alias("share")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
