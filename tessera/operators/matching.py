"""Case-control matching: strata matched in parallel, greedy and hardest first inside each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.demographics import age_group

# Default age groups of matching.
AGE_BOUNDS = (0, 3, 6, 13, 20, 30, 40, 200)
AGE_LABELS = ("Infants and Toddlers", "Preschoolers", "School age", "Teenagers", "Young Adults", "Adults", "Other")
CHUNK = 1 << 22
#: Most distances (cases times controls) of one stratum: it is one task, and an hour's work.
STRATUM_PAIRS = 100_000_000_000


def standardize(df: DataFrame, columns: Sequence[str], over: DataFrame | None = None) -> DataFrame:
    """z_<column> by mean and sample deviation of ``over`` (default: the frame); no or zero deviation counts as 1."""
    stats = (over if over is not None else df).agg(*(f(F.col(c)).alias(f"__{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev))))
    out = df.crossJoin(F.broadcast(stats))  # one row of statistics
    scale = lambda c: F.when(F.col(f"__s_{c}").isNull() | (F.col(f"__s_{c}") == 0), F.lit(1.0)).otherwise(F.col(f"__s_{c}"))
    return out.withColumns({f"z_{c}": (F.col(c) - F.col(f"__m_{c}")) / scale(c) for c in columns}).select(*df.columns, *(f"z_{c}" for c in columns))


def distance(columns: Sequence[str], suffix: str = "_case", seed: int | None = None):
    """Euclidean distance of standardised pairs, unknown differences counting 0, with optional tiny seeded noise against ties."""
    total = sum((F.pow(F.coalesce(F.col(c) - F.col(f"{c}{suffix}"), F.lit(0.0)), 2) for c in columns), F.lit(0.0))
    return F.sqrt(total) + (F.rand(seed) * 1e-6 if seed is not None else F.lit(0.0))


def prepare(demographics: DataFrame, cases: DataFrame, exclude: DataFrame | None = None, *, person: str = "personid", strata: Sequence[str] = ("gender", "race", "ethnicity"), distances: Sequence[str] = ("age", "encounters", "followtime"), age: str | None = "age", over: str = "controls") -> tuple[DataFrame, DataFrame]:
    """(cases, controls) with age groups and z-scores; controls are neither cases nor excluded and have every z-score."""
    if missing := [c for c in (person, *strata, *distances, *([age] if age else [])) if c not in demographics.columns]:
        raise ValueError(f"demographics lack {missing}")
    rows = demographics.withColumn("age_group", age_group(F.col(age), AGE_BOUNDS, AGE_LABELS)) if age else demographics
    ids = cases.select(person).distinct()
    mine = rows.join(ids, person, "left_semi")
    pool = rows.join(ids, person, "left_anti")
    pool = pool.join(exclude.select(person).distinct(), person, "left_anti") if exclude is not None else pool
    base = pool if over == "controls" else rows
    return standardize(mine, distances, base), standardize(pool, distances, base).dropna(subset=[f"z_{c}" for c in distances])


def _greedy(case_ids, case_x, need, pool_ids, pool_x) -> list[tuple]:
    """(case, control, rank, distance): the case whose nearest control is farthest chooses first, each control serves once.

    Distances are computed in blocks of cases; only the order needs all nearest distances.
    """
    order = np.argsort(pool_ids, kind="stable")
    pool_ids, pool_x = [pool_ids[i] for i in order], pool_x[order]
    step = max(1, CHUNK // max(1, len(pool_ids) * max(1, pool_x.shape[1])))
    far = lambda x: np.sqrt(((x[:, None, :] - pool_x[None]) ** 2).sum(axis=2))
    nearest = np.concatenate([far(case_x[i : i + step]).min(axis=1) for i in range(0, len(case_ids), step)])
    free = np.ones(len(pool_ids), bool)
    out = []
    for i in sorted(range(len(case_ids)), key=lambda i: (-nearest[i], case_ids[i])):
        d = np.where(free, far(case_x[i : i + 1])[0], np.inf)
        k = min(int(need[i]), int(free.sum()))
        for rank, j in enumerate(np.argsort(d, kind="stable")[:k], 1):
            free[j] = False
            out.append((case_ids[i], pool_ids[j], rank, float(d[j])))
    return out


def match(cases: DataFrame, controls: DataFrame, strata: Sequence[str], distances: Sequence[str], *, person: str = "personid", per_case: int = 4, need: str | None = None) -> DataFrame:
    """Nearest controls for every case inside its exact stratum, without replacement: case, control, rank, distance.

    Strata run as cogrouped Arrow groups, so nothing is collected; a stratum of more than ``STRATUM_PAIRS`` cases times controls is an error
    that asks for one more stratum.  Rows with an unknown stratum
    do not match; unknown coordinates count 0.  Ties go by ids.  ``need`` names a column of each case's own demand.
    """
    idt = cases.schema[person].dataType
    coords = [f"__x{k}" for k in range(len(distances))]  # a column may be a stratum and a coordinate
    schema = T.StructType([T.StructField("case_id", idt), T.StructField("control_id", idt), T.StructField("match_rank", T.IntegerType()), T.StructField("distance", T.DoubleType())])

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame(columns=schema.fieldNames())
        if len(a) * len(b) > STRATUM_PAIRS:
            raise ValueError(f"a stratum has {len(a)} cases and {len(b)} controls: add a stratum")
        x = lambda t: np.nan_to_num(t[coords].to_numpy(float))
        demand = a[need].to_numpy() if need else np.full(len(a), per_case)
        return pd.DataFrame(_greedy(a[person].tolist(), x(a), demand, b[person].tolist(), x(b)), columns=schema.fieldNames())

    known = lambda t, extra: t.dropna(subset=list(strata)).select(*(F.col(c).alias(c) for c in dict.fromkeys([person, *strata])), *(F.col(c).cast("double").alias(n) for n, c in zip(coords, distances)), *extra)
    a, b = known(cases, [need] if need else []), known(controls, [])
    return a.groupBy(*strata).cogroup(b.groupBy(*strata)).applyInPandas(run, schema)


def match_rounds(cases: DataFrame, controls: DataFrame, rounds: Sequence[dict], distances: Sequence[str], *, person: str = "personid", per_case: int = 4, save) -> DataFrame:
    """Rounds of ever looser strata; each asks for what every case still lacks, and drops the controls used before.

    ``rounds``: dicts of strata, and optionally quality.  ``save`` stores a frame and returns it read again, which cuts
    the lineage between rounds.
    """
    done: DataFrame | None = None
    for k, r in enumerate(rounds, 1):
        strata = list(r["strata"])
        demand, pool = cases.withColumn("__need", F.lit(per_case)), controls
        if done is not None:
            got = done.groupBy(F.col("case_id").alias(person)).agg(F.count("*").alias("__got"))
            demand = cases.join(got, person, "left").withColumn("__need", (F.lit(per_case) - F.coalesce("__got", F.lit(0))).cast("int")).drop("__got").where("__need > 0")
            pool = controls.join(done.select(F.col("control_id").alias(person)), person, "left_anti")
        found = match(demand, pool, strata, distances, person=person, need="__need")
        found = found.withColumns({"iteration": F.lit(k), "criteria": F.lit(", ".join(strata)), "quality": F.lit(r.get("quality", f"round {k}"))})
        done = save(found if done is None else done.unionByName(found))
    return done
