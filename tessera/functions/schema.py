"""Nested schemas: paths, flattening, standard code roots, and name-based selection."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The leaves of a standard code triplet.
TRIPLET = ("id", "codingSystemId", "primaryDisplay")


def flat_paths(schema: T.StructType, through_arrays: bool = False) -> Iterator[tuple[str, T.DataType]]:
    """(dotted path, type) of every leaf; arrays are leaves unless looked through."""

    def walk(prefix: str, t: T.DataType) -> Iterator[tuple[str, T.DataType]]:
        inner = t
        while through_arrays and isinstance(inner, T.ArrayType):
            inner = inner.elementType
        if isinstance(inner, T.StructType):
            for f in inner:
                yield from walk(f"{prefix}.{f.name}" if prefix else f.name, f.dataType)
        else:
            yield prefix, t

    yield from walk("", schema)


def quoted(path: str) -> str:
    return ".".join(f"`{p}`" for p in path.split("."))


def array_paths(schema: T.StructType) -> list[str]:
    """Outermost array paths, in order."""
    return [p for p, t in flat_paths(schema) if isinstance(t, T.ArrayType)]


def explode_one(df: DataFrame, path: str) -> DataFrame:
    """One row for each element of the array at ``path`` (one with null if it is empty), as a column of the path's last name."""
    name = path.replace(".", "_")
    if "." not in path:
        return df.withColumn(name, F.explode_outer(F.col(quoted(path))))
    root = path.split(".")[0]
    out = df.withColumn(f"__{name}", F.explode_outer(F.col(quoted(path))))
    field = path.split(".", 1)[1]
    return out.withColumn(root, F.col(f"`{root}`").dropFields(field)).withColumnRenamed(f"__{name}", name)


def flatten(df: DataFrame, explode: str | None = None, most: int = 25) -> DataFrame:
    """Leaves as columns named by underscores.  An array must be named to be exploded; any other array is an error."""
    if explode is not None:
        df = explode_one(df, explode)
    for _ in range(most):
        if not any(isinstance(f.dataType, T.StructType) for f in df.schema):
            break
        cols = []
        for f in df.schema:
            if isinstance(f.dataType, T.StructType):
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
    if left := [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]:
        raise ValueError(f"arrays {left}: name one to explode")
    return df


def select_by_regex(df: DataFrame, patterns: Sequence[str] | None) -> DataFrame:
    """Columns whose names match a pattern (found anywhere, any case), in the frame's order; without patterns all."""
    if not patterns:
        return df
    found = [c for c in df.columns if any(re.search(p, c, re.I) for p in patterns)]
    return df.select(*(F.col(f"`{c}`") for c in found))


def standard_roots(schema: T.StructType, patterns: Sequence[str] = ()) -> dict[str, list[str]]:
    """Paths that end in a standard triplet, and other leaves that match a pattern, with the leaves they have."""
    roots: dict[str, list[str]] = {}
    for path, _ in flat_paths(schema, through_arrays=True):
        parts = path.split(".")
        if len(parts) >= 2 and parts[-2] == "standard" and parts[-1] in TRIPLET:
            roots.setdefault(".".join(parts[:-1]), []).append(parts[-1])
        elif any(re.search(p, path) for p in patterns):
            roots.setdefault(path, [])
    return {r: [x for x in TRIPLET if x in leaves] for r, leaves in roots.items()}


def align_union(frames: Sequence[DataFrame]) -> DataFrame | None:
    """Union by name, missing columns null of the other frames' type; None without frames."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames) if frames else None


def array_depth(schema: T.StructType, path: str) -> list[str]:
    """The arrays that must be exploded, outermost first, before ``path`` is a plain field."""
    out, at, seen = [], schema, []
    for part in path.split("."):
        seen.append(part)
        t = at[part].dataType
        if isinstance(t, T.ArrayType):
            out.append(".".join(seen))
            t = t.elementType
        if isinstance(t, T.StructType):
            at = t
    return out
