"""Searches of the ontology relation, crosswalks, code lists by context version, and coverage."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import similarity

# What each search returns, in the relation's column names.
SEARCHES = {
    "ontologies": None,
    "context_id": ("contextId",),
    "context": ("contextId", "contextDescription", "contextVersion"),
    "concept_code": ("codingSystemId", "codingSystemDescription", "conceptCode"),
    "system": ("codingSystemId",),
    "system_name": ("codingSystemId", "codingSystemDescription", "conceptName"),
    "context_name": ("contextId", "conceptName"),
    "context_name_system": ("contextId", "conceptName", "codingSystemId"),
    "concept_names": ("conceptName",),
    "contexts": ("contextId", "contextDescription"),
    "codings": ("codingSystemId", "codingSystemDescription"),
    "codes": ("conceptCode",),
}


#: Most distinct ids on either side of a crosswalk.
CROSSWALK_IDS = 10_000


class Patterns(NamedTuple):
    """Regular expressions, found anywhere in any case, all of which must hold; None holds always."""

    name: str | None = None
    system: str | None = None
    context: str | None = None
    code: str | None = None
    description: str | None = None


def _filtered(df: DataFrame, p: Patterns) -> DataFrame:
    for col, pattern in (("conceptName", p.name), ("codingSystemId", p.system), ("contextId", p.context), ("conceptCode", p.code), ("codingSystemDescription", p.description)):
        if pattern:
            df = df.where(F.col(col).rlike(f"(?i){pattern}"))
    return df


def search(df: DataFrame, what: str = "ontologies", patterns: Patterns = Patterns(), limit: int | None = None) -> DataFrame:
    """Distinct columns of one of the SEARCHES, in order; ``ontologies`` gives every column of every row."""
    cols = SEARCHES[what]
    out = _filtered(df, patterns)
    out = out.select(*cols).distinct().orderBy(*cols) if cols else out
    return out.limit(limit) if limit else out


def concept_summary(df: DataFrame, patterns: Patterns = Patterns()) -> DataFrame:
    """Contexts and codes of every concept."""
    return _filtered(df, patterns).groupBy("conceptName").agg(F.count_distinct("contextId").alias("n_contexts"), F.count_distinct("conceptCode").alias("n_codes"))


def coding_system_summary(df: DataFrame, patterns: Patterns = Patterns()) -> DataFrame:
    """Distinct concepts of every context and coding system, the most first."""
    out = _filtered(df, patterns).groupBy("contextId", "codingSystemId", "codingSystemDescription").agg(F.count_distinct("conceptName").alias("count"))
    return out.orderBy(F.desc("count"), "contextId", "codingSystemId")


def top_context(df: DataFrame) -> DataFrame:
    """Rows of the context with the most distinct concepts (ties: the smallest id)."""
    top = df.groupBy("contextId").agg(F.count_distinct("conceptName").alias("__n")).orderBy(F.desc("__n"), "contextId").limit(1).select("contextId")
    return df.join(F.broadcast(top), "contextId", "left_semi")


def _code_lists(codes: DataFrame, concept: str | None) -> DataFrame:
    rows = codes.where(F.col("conceptName") == concept) if concept is not None else codes
    return rows.groupBy("conceptName", "contextVersion").agg(F.sort_array(F.collect_set(F.struct("conceptCode", "descriptionNumber"))).alias("codes"))


def concept_codes(codes: DataFrame, descriptions: DataFrame, concept: str | None = None) -> DataFrame:
    """Code list of the first context version that has it: versions with one list appear once."""
    order = Window.partitionBy("conceptName", "codes").orderBy("contextVersion")
    first = _code_lists(codes, concept).withColumn("__k", F.row_number().over(order)).where("__k = 1")
    rows = first.select("contextVersion", "conceptName", F.explode("codes").alias("c")).select("contextVersion", "conceptName", F.col("c.conceptCode").alias("conceptCode"), F.col("c.descriptionNumber").alias("descriptionNumber"))
    return rows.join(descriptions, "descriptionNumber").select("contextVersion", "conceptName", "conceptCode", "codingSystem").distinct()


def context_groups(codes: DataFrame, concept: str | None = None) -> DataFrame:
    """contextVersion, conceptName, contextGroup and whether it is its group's reference: the smallest version with that code list."""
    lists = _code_lists(codes, concept).withColumn("__ref", F.min("contextVersion").over(Window.partitionBy("conceptName", "codes")))
    group = F.dense_rank().over(Window.partitionBy("conceptName").orderBy("__ref"))
    return lists.select("contextVersion", "conceptName", group.alias("contextGroup"), (F.col("contextVersion") == F.col("__ref")).cast("int").alias("referenceContext"))


def tagged_codes(df: DataFrame, code: str, table: str, display: bool = True) -> DataFrame:
    """The code triplet of a flat table under common names, tagged by table and field."""
    names = {f"{code}_standard_id": "conceptCode", f"{code}_standard_codingSystemId": "codingSystemId"} | ({f"{code}_standard_primaryDisplay": "primaryDisplay"} if display else {})
    names = {a: b for a, b in names.items() if a in df.columns}
    return df.select(*(F.col(a).alias(b) for a, b in names.items()), F.lit(table).alias("table"), F.lit(code).alias("codefield"))


def crosswalk(data_systems: DataFrame, ontology_systems: DataFrame, cutoff: float = 0.6, most: int = 10, column: str = "codingSystemId") -> DataFrame:
    """Data coding systems to ontology systems that end in them, among the ``most`` alike by matching blocks.

    Both sides are distinct ids, which are few: vocabularies, not data.  More than ``CROSSWALK_IDS`` on either
    side are an error, for all pairs are ranked.
    """
    a = data_systems.select(F.col(column).alias("dataSystemId")).where("dataSystemId is not null").distinct()
    b = ontology_systems.select(F.col(column).alias("ontologySystemId")).where("ontologySystemId is not null").distinct()
    for side in (a, b):
        if side.limit(CROSSWALK_IDS + 1).count() > CROSSWALK_IDS:
            raise ValueError(f"more than {CROSSWALK_IDS} coding systems to compare")
    pairs = a.join(F.broadcast(b), F.col("ontologySystemId").endswith(F.col("dataSystemId")) | F.lit(cutoff > 0)).withColumn("similarity", similarity(F.col("dataSystemId"), F.col("ontologySystemId"))).where(F.col("similarity") >= cutoff)
    order = Window.partitionBy("dataSystemId").orderBy(F.desc("similarity"), F.desc("ontologySystemId"))
    near = pairs.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= most)
    return near.where(F.col("ontologySystemId").endswith(F.col("dataSystemId"))).select("dataSystemId", "ontologySystemId", "similarity")


def summarize_codes(data: DataFrame, ontology: DataFrame, links: DataFrame, least: int = 2) -> dict[str, DataFrame]:
    """Six views of how a table's codes meet the ontology; ``data``: codingSystemId, conceptCode and a count n."""
    systems = data.groupBy("codingSystemId").agg(F.sum("n").alias("n"), F.count_distinct("conceptCode").alias("codes"))
    walked = data.join(F.broadcast(links.select(F.col("dataSystemId").alias("codingSystemId"), "ontologySystemId")), "codingSystemId")
    known = ontology.select(F.col("codingSystemId").alias("ontologySystemId"), "conceptCode").distinct()
    linked = links.select(F.col("dataSystemId").alias("codingSystemId")).distinct()
    matched = walked.join(known, ["ontologySystemId", "conceptCode"], "left_semi")
    return {
        "coding_systems": systems, "crosswalk": links,
        "systems_not_matched": systems.join(linked, "codingSystemId", "left_anti"), "systems_matched": systems.join(linked, "codingSystemId", "left_semi"),
        "codes_matched": matched.select("codingSystemId", "conceptCode", "n").distinct(),
        "codes_not_matched": data.join(matched.select("codingSystemId", "conceptCode").distinct(), ["codingSystemId", "conceptCode"], "left_anti").where(F.col("n") > least),
    }


def ontology_codes(ontology: DataFrame, coverage: DataFrame, name: str, table: str | None = None, system: str | None = None, fields: Sequence[str] = ("codingSystemId", "conceptCode")) -> DataFrame:
    """Codes of matching concepts in the context that covers most of them."""
    rows = coverage.where(F.col("conceptName").rlike(f"(?i){name}"))
    rows = rows.where(F.col("table") == table) if table else rows
    best = top_context(rows).select("contextId", "conceptName").distinct()
    out = ontology.join(F.broadcast(best), ["contextId", "conceptName"])
    out = out.where(F.col("codingSystemId").rlike(f"(?i){system}")) if system else out
    return out.select(*fields).distinct().orderBy(*fields)


def covered_sample(coverage: DataFrame, name: str | None = None, n: int = 40) -> DataFrame:
    """The most covered rows with any coverage; ties by concept and code."""
    rows = coverage.where(F.col("percent") > 0)
    rows = rows.where(F.col("conceptName").rlike(f"(?i){name}")) if name else rows
    return rows.orderBy(F.desc("percent"), "contextId", "conceptName", "code").limit(n)


def descriptions(df: DataFrame, pattern: str, column: str, n: int = 40) -> DataFrame:
    return df.where(F.col(column).rlike(f"(?i){pattern}")).select(column).distinct().orderBy(column).limit(n)


def upsert(current: DataFrame | None, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The current rows whose key the new ones lack (null keys compare equal), then the new rows, by column name."""
    if current is None:
        return new
    k = new.select(*(F.col(c).alias(f"__{c}") for c in keys)).distinct()
    old = current.join(k, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys], "left_anti")
    return old.unionByName(new, allowMissingColumns=True)
