"""Writing tables: safe overwrites, upserts, exports and catalog commands."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Collection, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..operators.ontology import upsert

log = logging.getLogger(__name__)


def _name(table: str) -> str:
    return ".".join(f"`{p}`" for p in table.replace("`", "").split("."))


def drop(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {_name(table)}")


def rename(spark: SparkSession, old: str, new: str) -> None:
    spark.sql(f"ALTER TABLE {_name(old)} RENAME TO {_name(new)}")


def use_database(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def exists(spark: SparkSession, table: str | None) -> bool:
    return bool(table) and spark.catalog.tableExists(table)


def row_count(spark: SparkSession, table: str | None) -> int | None:
    return spark.table(table).count() if exists(spark, table) else None


def write(df: DataFrame, table: str, partition_by: Sequence[str] = (), mode: str = "overwrite", comment: str | None = None) -> DataFrame:
    """Write a table and return it read again.

    An overwrite goes through a staging table, so that a frame may replace the table it reads.  The staging table
    goes when the rows are in their place, or if it could not be written itself; if they could not be moved, it is the only whole copy and
    stays, named in the error.  A partition column that the frame lacks is an error.
    """
    if missing := [c for c in partition_by if c not in df.columns]:
        raise ValueError(f"no columns {missing} to partition {table} by")
    spark = df.sparkSession
    save = lambda f, to, m: (f.write.partitionBy(*partition_by) if partition_by else f.write).mode(m).saveAsTable(to)
    if mode == "append":
        save(df, table, "append")  # columns meet by name
    elif not exists(spark, table):
        save(df, table, mode)
    else:
        temp = f"{table}_stage_{uuid.uuid4().hex[:8]}"
        try:
            save(df, temp, "errorifexists")
        except Exception:
            drop(spark, temp)
            raise
        try:
            save(spark.table(temp), table, "overwrite")
        except Exception as e:
            raise RuntimeError(f"{table} could not be overwritten; its new rows are kept in {temp}") from e
        drop(spark, temp)
    if comment:
        spark.sql(f"COMMENT ON TABLE {_name(table)} IS :c", args={"c": comment})
    spark.catalog.refreshTable(table)
    return spark.table(table)


def write_if_any(df: DataFrame, table: str, **options) -> DataFrame | None:
    return None if df.isEmpty() else write(df, table, **options)


def write_all(frames: Mapping[str, tuple[DataFrame | None, str]], skip_empty: bool = True, clean: Collection[str] = ()) -> dict[str, int | None]:
    """Write {name: (frame, table)}: rows of each, None where there was nothing to write or the name is in ``clean`` (unchanged since its last write)."""
    out: dict[str, int | None] = {}
    for name, (df, table) in frames.items():
        if name in clean or df is None or (skip_empty and df.isEmpty()):
            out[name] = None
        else:
            out[name] = write(df, table).count()
    return out


def try_write(df: DataFrame, table: str, **options) -> DataFrame:
    """Write if it goes; else warn and return the frame as it was."""
    try:
        return write(df, table, **options)
    except Exception as e:
        log.warning("could not write %s: %s", table, e)
        return df


def upsert_table(new: DataFrame, table: str, keys: Sequence[str], mode: str = "update") -> DataFrame:
    """``initialize`` overwrites, ``append`` adds by column name, ``update`` replaces rows of the new keys; ``verify`` reads the rows of those keys."""
    spark = new.sparkSession
    if mode == "initialize" or not exists(spark, table):
        return write(new, table)
    if mode == "append":
        return write(new, table, mode="append")
    if mode == "verify":
        return spark.table(table).join(new.select(*keys).distinct(), list(keys), "left_semi")
    if mode != "update":
        raise ValueError(f"unknown mode {mode!r}")
    return write(upsert(spark.table(table), new, keys), table)


def write_distinct(df: DataFrame, table: str) -> DataFrame:
    return write(df.distinct(), table)


def to_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def to_csv(df: DataFrame, path: str, one_file: bool = False, dirty: bool = False) -> None:
    """CSV with a header, from the executors; a warning if the stored table is older than the frame."""
    if dirty:
        log.warning("%s is exported from a frame that its table does not hold yet", path)
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def to_pandas(df: DataFrame | None, limit: int | None = None) -> pd.DataFrame:
    return pd.DataFrame() if df is None else (df.limit(limit) if limit else df).toPandas()


def from_pandas(spark: SparkSession, frame: pd.DataFrame, table: str | None = None, **options) -> DataFrame:
    """A pandas frame as a DataFrame, written to a table if one is named."""
    df = spark.createDataFrame(frame)
    return write(df, table, **options) if table else df


def query(spark: SparkSession, text: str, **args: object) -> DataFrame:
    """SQL text with named parameters, never formatted into it."""
    return spark.sql(text, args=args or None)
