"""Code lists and their verification against dictionaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfc

KINDS = ("regex", "like", "prefix")


def code_list(spark: SparkSession, codes: Mapping[str, str] | Sequence[str] | str, group: str = "group", column: str = "codes") -> DataFrame:
    """A code list of (group, code): a mapping as it is; a list as group_0, group_1, ...; one string as ``default``."""
    pairs = list(codes.items()) if isinstance(codes, Mapping) else [("default", codes)] if isinstance(codes, str) else [(f"group_{i}", c) for i, c in enumerate(codes)]
    return spark.createDataFrame(pairs, T.StructType([T.StructField(group, T.StringType()), T.StructField(column, T.StringType())]))


def csv_code_list(spark: SparkSession, path: str, schema: str | T.StructType | None = None, drop_missing: bool = False, how: str = "any", subset: Sequence[str] | None = None, thresh: int | None = None, normalize: bool = True) -> DataFrame:
    """A code list from CSV with a header: leading blanks trimmed, strings in NFC, rows with missing values dropped on request."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", True)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if normalize:
        df = df.select(*(nfc(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema))
    return df.dropna(how=how, thresh=thresh, subset=list(subset) if subset else None) if drop_missing else df


def dictionary(source: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each distinct code of a source: no person, no date."""
    return source.select(*columns).distinct()


def matches(field: Column, pattern: Column, kind: str = "regex") -> Column:
    """Whether a value matches: a regular expression found anywhere, an SQL LIKE pattern, or a prefix."""
    if kind not in KINDS:
        raise ValueError(f"pattern kind {kind!r} is none of {KINDS}")
    return {"regex": lambda: F.rlike(field, pattern), "like": lambda: F.like(field, pattern), "prefix": lambda: F.startswith(field, pattern)}[kind]()


def _label(receiver: str | None, codes: DataFrame, column: str) -> tuple[str, str]:
    own = next((c for c in codes.columns if c != column), None)
    if own is None:
        raise ValueError("a code list needs a group column beside its codes")
    return own, receiver or own


def verify_by_pattern(source: DataFrame, field: str, codes: DataFrame, column: str = "codes", label: str | None = None, kind: str = "regex", distinct_first: bool = True) -> DataFrame:
    """Tag rows by every (group, pattern) that the field matches: a row that matches k patterns comes k times.

    However many patterns there are, the source is scanned twice: once for the field alone, whose distinct values
    meet the patterns, and once for the rows, which meet the tagged values by an equality.  So the cost of the patterns
    does not grow with the rows; ``distinct_first=False`` is one scan and suits dictionaries, whose values are
    distinct already.
    """
    own, name = _label(label, codes, column)
    patterns = codes.select(F.col(own).alias("__label"), F.col(column).alias("__pattern")).where("__pattern is not null").distinct()
    cond = matches(F.col("__value"), F.col("__pattern"), kind)
    if not distinct_first:
        tagged = source.join(F.broadcast(patterns), matches(F.col(field), F.col("__pattern"), kind))
        return tagged.select(*(source[c] for c in source.columns if c != name), F.col("__label").alias(name))
    values = source.select(F.col(field).alias("__value")).where("__value is not null").distinct()
    tags = values.join(F.broadcast(patterns), cond).select("__value", "__label")
    return source.join(tags, source[field] == F.col("__value")).select(*(source[c] for c in source.columns if c != name), F.col("__label").alias(name))


def verify_by_merge(source: DataFrame, codes: DataFrame | Sequence[str], key: str) -> DataFrame:
    """Rows whose key is on the list; a plain list becomes a column named as the key.  The list's other columns come along."""
    if not isinstance(codes, DataFrame):
        codes = source.sparkSession.createDataFrame([(c,) for c in codes], T.StructType([T.StructField(key, source.schema[key].dataType)]))
    extra = [c for c in codes.columns if c == key or c not in source.columns]
    return source.join(codes.select(*extra).distinct(), key)


def verify(source: DataFrame, codes: DataFrame, method: str, field: str | None = None, keep: Sequence[str] = (), index: Sequence[str] = (), label: str | None = None, column: str = "codes", kind: str = "regex") -> DataFrame:
    """Verify codes by ``regex`` or ``merge``, then keep ``keep``, ``index`` and the label, in the source's order."""
    if method == "regex":
        if field is None:
            raise ValueError("regex verification needs the field to search")
        out = verify_by_pattern(source, field, codes, column, label, kind)
        name = _label(label, codes, column)[1]
    elif method == "merge":
        out = verify_by_merge(source, codes, field or codes.columns[0])
        name = label or next((c for c in codes.columns if c != (field or codes.columns[0])), None)
    else:
        raise ValueError(f"unknown method {method!r}: regex or merge")
    wanted = {*keep, *index} | ({name} if name else set())
    return out.select(*(c for c in out.columns if c in wanted)) if keep or index else out
