"""Opening a project: layered configuration, source schemas bound by rule, and the tables to build."""

from __future__ import annotations

import logging
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..session import open_session
from ..sources.catalog import Catalog
from ..sources.config import find_config, load_layers, require
from .project import Project

log = logging.getLogger(__name__)


def _there(spark: SparkSession, schema: str) -> bool:
    return "/" in schema or spark.catalog.databaseExists(schema)


def bind_schemas(spark: SparkSession, config: Mapping[str, Any]) -> tuple[dict[str, Catalog], list[str]]:
    """({type_key: its tables}, schemas that are missing).

    Each entry of ``schemas`` has a rule in ``callFunProcessDataTables`` whose ``schema_type`` it is; the rule names the table
    definitions (``data_type``), or asks to discover the tables (``updateDict``, ``tableNameTemplate``).  Without rules,
    ``RWDTables`` of ``RWDSchema`` are bound as ``r``.
    """
    rules = config.get("callFunProcessDataTables") or {"default": {"data_type": "RWDTables", "schema_type": "RWDSchema", "type_key": "r"}}
    by_schema = {r.get("schema_type"): r for r in rules.values()}
    bound: dict[str, Catalog] = {}
    missing: list[str] = []
    for key, schema in (config.get("schemas") or {}).items():
        rule = by_schema.get(key)
        if not schema or rule is None:
            continue
        if not _there(spark, schema):
            missing.append(key)
            log.warning("no database %s for %s", schema, key)
            continue
        tables = config.get(rule.get("data_type")) or {}
        c = Catalog(spark)
        if tables:
            c.bind(schema, tables)
        elif rule.get("updateDict"):
            c.discover(schema, rule.get("tableNameTemplate"))
        if len(c) and rule.get("type_key"):
            bound[rule["type_key"]] = c
    return bound, missing


def open_project(path: str | Path, schema: str | Path | None = None, top: str | Path | None = None, spark: SparkSession | None = None, dictionaries: Mapping[str, DataFrame] | None = None, strict: bool = False) -> Project:
    """A project file with its layers: global, peers, schema, local.  ``strict`` refuses missing settings and schemas."""
    spark = spark or open_session("tessera project")
    path = Path(path)
    top = top or find_config("config-global.yaml", path.parent)
    config = load_layers(path, schema, top)
    if strict:
        require(config)
    bound, missing = bind_schemas(spark, config)
    if strict and missing:
        raise LookupError(f"missing schemas: {missing}")
    project = Project(spark, path, bound.get("r"), dictionaries or bound.get("d"))
    project.plan.root = {**config, **{k: v for k, v in project.plan.root.items() if not isinstance(v, str)}}
    project.catalogs = bound
    return project
