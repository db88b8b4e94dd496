"""Source tables bound by configuration, with a status for each."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import array_paths, flatten, select_by_regex
from .config import check_keys

KEYS = frozenset("source label inputRegex insert colsRename filter explode_array partitionBy datefieldPrimary indexFields codefield description".split())


class Status(Enum):
    UNLOADED, LOADED, PROCESSED, FAILED, NOT_FOUND = range(5)


@dataclass
class SourceTable:
    """One physical table and how it is shaped: flatten, select, insert, rename, filter, in that order."""

    name: str
    location: str
    spec: Mapping[str, Any] = field(default_factory=dict)
    status: Status = Status.UNLOADED
    error: str = ""
    _df: DataFrame | None = None

    def load(self, spark: SparkSession, raw: DataFrame | None = None) -> DataFrame | None:
        """The shaped frame; a missing table is noted and gives None, a wrong shape is FAILED and raises."""
        if self._df is not None:
            return self._df
        check_keys(self.name, self.spec, KEYS)
        try:
            df = raw if raw is not None else read_location(spark, self.location)
        except LookupError as e:
            self.status, self.error = Status.NOT_FOUND, str(e)
            return None
        self.status = Status.LOADED
        try:
            self._df = shape(df, self.spec)
        except Exception as e:
            self.status, self.error = Status.FAILED, str(e)
            raise
        self.status = Status.PROCESSED
        return self._df


def read_location(spark: SparkSession, location: str) -> DataFrame:
    """A catalog table, or a Parquet path if it has a slash; LookupError if there is none."""
    if "/" in location:
        try:
            return spark.read.parquet(location)
        except Exception as e:
            raise LookupError(f"no table at {location}") from e
    if not spark.catalog.tableExists(location):
        raise LookupError(f"no table {location}")
    return spark.table(location)


def shape(df: DataFrame, spec: Mapping[str, Any]) -> DataFrame:
    """Apply a table's specification; expressions are SQL, never evaluated as Python."""
    explode = spec.get("explode_array")
    if explode or any("." in p for p in array_paths(df.schema)) or any(hasattr(f.dataType, "fields") or hasattr(getattr(f.dataType, "elementType", None), "fields") for f in df.schema):
        df = flatten(df, explode)
    df = select_by_regex(df, spec.get("inputRegex"))
    for name, text in dict(spec.get("insert") or {}).items():
        df = df.withColumn(name, F.expr(text))
    df = df.withColumnsRenamed(dict(spec.get("colsRename") or {}))
    return df.where(spec["filter"]) if spec.get("filter") else df


class Catalog:
    """Source tables by name; frames are built when asked for."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.tables = spark, {}

    def add(self, name: str, location: str, spec: Mapping[str, Any] | None = None) -> SourceTable:
        self.tables[name] = SourceTable(name, location, spec or {})
        return self.tables[name]

    def bind(self, schema: str, tables: Mapping[str, Mapping[str, Any]]) -> Catalog:
        """Bind every configured table of one physical schema (a database, or a folder of Parquet tables)."""
        for name, spec in tables.items():
            source = spec.get("source", name)
            self.add(name, f"{schema.rstrip('/')}/{source}.parquet" if "/" in schema else f"{schema}.{source}", spec)
        return self

    def discover(self, schema: str, template: str | None = None) -> Catalog:
        """Bind every table of a database; the part before ``template`` is the name; tables that do not match keep theirs; the first of a name wins."""
        for t in sorted(t.name for t in self.spark.catalog.listTables(schema)):
            m = re.match(rf"^(.*?){template}", t) if template else None
            name = m[1].rstrip("_") if m and m[1].rstrip("_") else t
            if name not in self.tables:
                self.add(name, f"{schema}.{t}", {"source": t, "label": t})
        return self

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.tables:
            raise KeyError(name)
        df = self.tables[name].load(self.spark)
        if df is None:
            raise LookupError(self.tables[name].error)
        return df

    def __contains__(self, name: str) -> bool:
        return name in self.tables

    def __iter__(self) -> Iterator[str]:
        return iter(self.tables)

    def __len__(self) -> int:
        return len(self.tables)

    def report(self, strict: bool = False) -> list[tuple[str, str, str]]:
        """(name, status, error) of all tables; with ``strict`` a failed one raises."""
        out = [(t.name, t.status.name, t.error) for t in self.tables.values()]
        if strict and (bad := [n for n, s, _ in out if s == "FAILED"]):
            raise RuntimeError(f"failed tables: {bad}")
        return out


def lookup(spark: SparkSession, schema: str, field: str, template: str = "{field}", person: str = "personid") -> DataFrame:
    """Two columns of a table named after a demographic field."""
    return read_location(spark, f"{schema}.{template.format(field=field)}").select(person, field)
