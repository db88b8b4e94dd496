"""Configuration, sources, storage, project builds and streams."""

import datetime as dt
import json

import pytest

from tessera.plans import project as pj
from tessera.sources import config, storage
from tessera.sources.catalog import Catalog, Status, shape
from tessera.streaming import live_index

SF = "/root/testdata/sf0.001"
YAML = """
projectSchema: default
disease: dx
schemaTag: t{tag}
analysis: {{data_version: {version}}}
projectTables:
  # 011 - extract
  types:
    method: dict2pyspark
    dictionary: {{buy: '^purch', look: 'view'}}
  found:
    method: create_extract
    inputs: {{elementList: types, elementListSource: d.kinds}}
    sourceField: event_type
    retained_fields: [event_type]
  # 014 - person tables
  panel:
    method: entityExtract
    inputs: {{spine: people, features: [buys]}}
    indexFields: [user_id]
    on_collision: raise
  people:
    method: write_index_table
    inputs: {{inTable: r.events}}
    indexFields: [user_id]
    datefieldPrimary: [ts]
    code: all
  rows:
    method: entityExtract
    inputs: {{elementList: found, entitySource: r.events}}
    indexFields: [event_type]
  buys:
    method: write_index_table
    inputs: {{inTable: rows}}
    indexFields: [user_id]
    datefieldPrimary: ts
    code: buy
    label: {label}
  byhand:
    purpose: made in a notebook
"""


@pytest.fixture
def project(spark, tmp_path):
    def make(tag="a", version=1, label="x"):
        (tmp_path / "p.yaml").write_text(YAML.format(tag=tag, version=version, label=label))
        c = Catalog(spark).bind(SF, {"events": {}})
        kinds = c["events"].select("event_type").distinct()
        return pj.Project(spark, tmp_path / "p.yaml", c, {"kinds": kinds}, tmp_path / "m.json")

    yield make
    for t in spark.catalog.listTables():
        if "_dx_t" in t.name:
            storage.drop(spark, t.name)


def test_plan_sections_order(project):
    p = project()
    assert p.plan.sections == {"011": ["types", "found"], "014": ["panel", "people", "rows", "buys", "byhand"]}
    order = pj.build_order(p.plan.tables)
    assert order.index("rows") < order.index("buys") < order.index("panel") and order[:2] == ["types", "found"]
    assert pj.dependencies(p.plan.tables["panel"]) == ["people", "buys"] and pj.dependencies(p.plan.tables["people"]) == []
    with pytest.raises(ValueError, match="depend"):
        pj.build_order({"a": {"inputs": {"inTable": "b"}}, "b": {"inputs": {"inTable": "a"}}})


def test_fingerprints(project):
    p = project()
    a = pj.fingerprints(p.plan.tables, pj.source_hash(p.plan.root))
    same = pj.fingerprints(project(label="y").plan.tables, pj.source_hash(p.plan.root))
    assert a == same
    assert set(a.values()).isdisjoint(pj.fingerprints(p.plan.tables, pj.source_hash(project(version=2).plan.root)).values())
    changed = {k: dict(v) for k, v in p.plan.tables.items()}
    changed["rows"]["howjoin"] = "left"
    b = pj.fingerprints(changed, pj.source_hash(p.plan.root))
    assert {n for n in a if a[n] != b[n]} == {"rows", "buys", "panel"}


def test_make_skips_fresh(project, tmp_path):
    p = project("b")
    dry = p.make(dry_run=True)
    assert {r.action for r in dry.results} == {"plan", "unsupported"} and not (tmp_path / "m.json").exists()
    actions = lambda r: {x.name: x.action for x in r.results}
    first = p.make()
    assert actions(first) == {n: "built" for n in ("types", "found", "people", "rows", "buys", "panel")} | {"byhand": "unsupported"}
    assert p.resolve("panel").count() == p.resolve("people").count()
    assert set(actions(project("b").make()).values()) == {"skipped", "unsupported"}
    assert actions(project("b").make(only=["buys"], force=["buys"])) == {"buys": "built"}
    stale = project("b", version=2).make(only=["buys"])
    assert actions(stale) == {"buys": "failed"} and "stale" in stale.results[0].reason
    assert "buys" in first.to_markdown() and not first.failed and stale.failed == ["buys"]
    assert set(actions(project("b", version=2).make(section="14", force_all=False)).values()) >= {"failed"}
    with pytest.raises(ValueError):
        p.make(section="099")


def test_bad_nodes_fail_alone(project):
    p = project("c")
    p.plan.tables["people"]["inputs"] = {"inTabel": "r.events"}
    r = {x.name: x for x in p.make().results}
    assert r["people"].action == "failed" and "inTabel" in r["people"].error and r["panel"].reason == "upstream people failed" and r["buys"].action == "built"


def test_manifest_and_notebook(tmp_path):
    assert pj.load_manifest(tmp_path / "none.json") == {"nodes": {}}
    (tmp_path / "bad.json").write_text("{")
    assert pj.load_manifest(tmp_path / "bad.json") == {"nodes": {}}
    nb = tmp_path / "014-x.ipynb"
    nb.write_text(json.dumps({"nbformat": 4, "nbformat_minor": 5, "metadata": {}, "cells": [{"cell_type": "markdown", "metadata": {}, "source": ["hi"]}]}))
    for k in range(2):
        pj.splice(nb, pj.Report(str(k), [pj.Result("t", "built")]))
    cells = json.loads(nb.read_text())["cells"]
    assert len(cells) == 2 and "section 1" in "".join(cells[1]["source"]) and pj.find_notebook(tmp_path, "014") == nb


def test_config_layers(tmp_path):
    (tmp_path / "g.yaml").write_text("a: {x: 1, y: 1}\nproject: p1\nconfig_table_locations:\n  peer: {location: /elsewhere/peer.yaml}\n  gone: nope.yaml\n")
    (tmp_path / "peer.yaml").write_text("a: {y: 2}\nb: peer\n")
    (tmp_path / "s.yaml").write_text("b: schema\npath: /data/${project}/{today}/{unknown}\n")
    (tmp_path / "l.yaml").write_text("a: {z: 3}\nlist: ['{project}']\n")
    c = config.load_layers(tmp_path / "l.yaml", tmp_path / "s.yaml", tmp_path / "g.yaml")
    assert c["a"] == {"x": 1, "y": 2, "z": 3} and c["b"] == "schema" and c["list"] == ["p1"]
    assert c["path"] == f"/data/p1/{dt.date.today().isoformat()}/{{unknown}}"
    with pytest.raises(ValueError):
        config.require(c)
    with pytest.raises(ValueError):
        config.check_keys("t", {"sourc": 1}, frozenset({"source"}))
    (tmp_path / "configuration").mkdir()
    (tmp_path / "configuration" / "q.yaml").write_text("")
    assert config.find_config("q.yaml", tmp_path) == tmp_path / "configuration" / "q.yaml" and config.find_config("zz", tmp_path) is None


def test_catalog(spark, tmp_path):
    c = Catalog(spark).bind(SF, {"events": {"inputRegex": ["_id$", "^ts"], "insert": {"day": "to_date(ts)"}, "colsRename": {"user_id": "personid"}, "filter": "personid < 5"}, "gone": {}})
    assert c["events"].columns == ["event_id", "ts", "personid", "day"]
    with pytest.raises(LookupError):
        c["gone"]
    with pytest.raises(KeyError):
        c["never"]
    assert [(n, s) for n, s, _ in c.report()] == [("events", "PROCESSED"), ("gone", "NOT_FOUND")]
    c.add("odd", f"{SF}/events.parquet", {"filter": "nope > 1"})
    with pytest.raises(Exception):
        c["odd"]
    assert c.tables["odd"].status is Status.FAILED
    with pytest.raises(RuntimeError):
        c.report(strict=True)
    spark.range(3).write.mode("overwrite").saveAsTable("base_dx_v9")
    try:
        found = Catalog(spark).discover("default", "dx_v9")
        assert "base" in found and found["base"].count() == 3
    finally:
        storage.drop(spark, "base_dx_v9")
    with pytest.raises(ValueError):
        shape(spark.sql("select array(named_struct('a', 1)) as x"), {})


def test_open_project(spark, tmp_path):
    from tessera.plans.setup import open_project

    (tmp_path / "config-global.yaml").write_text(f"projectSchema: default\ncallFunProcessDataTables:\n  x: {{data_type: RWDTables, schema_type: RWDSchema, type_key: r}}\n  y: {{data_type: none, schema_type: Old, type_key: o}}\nRWDTables:\n  events: {{}}\nschemas: {{RWDSchema: {SF}, Old: no_such_db}}\n")
    (tmp_path / "p.yaml").write_text("project: p\ndisease: dx\nschemaTag: ${project}1\nprojectTables:\n  people: {method: write_index_table, inputs: {inTable: r.events}, indexFields: [user_id], datefieldPrimary: ts, code: e}\n")
    p = open_project(tmp_path / "p.yaml", spark=spark)
    assert set(p.catalogs) == {"r"} and list(p) == ["people"] and len(p) == 1 and "people" in p
    assert p.location("people") == "default.people_dx_p1"
    assert p["people"].columns == ["user_id", "index_e", "last_e", "entries_e", "encounter_days_e"]
    with pytest.raises(KeyError):
        p["none"]
    with pytest.raises(LookupError):
        open_project(tmp_path / "p.yaml", spark=spark, strict=True)


def test_storage(spark, tmp_path):
    t = "store_test"
    storage.drop(spark, t)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    storage.write(df, t, comment="it's a table")
    again = storage.write(spark.table(t).where("k = 1"), t)  # replaces the table it reads
    assert again.count() == 1 and not [x for x in spark.catalog.listTables() if "_stage_" in x.name]
    storage.upsert_table(spark.createDataFrame([("c", 1), ("d", 3)], "v string, k int"), t, ["k"])
    assert sorted(map(tuple, spark.table(t).collect())) == [(1, "c"), (3, "d")]
    storage.upsert_table(spark.createDataFrame([("e", 4)], "v string, k int"), t, ["k"], "append")
    assert storage.row_count(spark, t) == 3 and storage.upsert_table(df, t, ["k"], "verify").count() == 1
    with pytest.raises(ValueError):
        storage.write(df, t, ["nope"])
    assert storage.write_all({"a": (df, t), "b": (df.limit(0), t), "c": (None, t)}) == {"a": 2, "b": None, "c": None}
    assert storage.write_if_any(df.limit(0), t) is None
    storage.to_csv(df, str(tmp_path / "c"), one_file=True)
    storage.to_parquet(df, str(tmp_path / "p"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2 == spark.read.parquet(str(tmp_path / "p")).count()
    assert len(storage.to_pandas(df, 1)) == 1 and storage.to_pandas(None).empty
    assert storage.query(spark, "select * from store_test where v = :v", v="a'; drop").count() == 0
    storage.rename(spark, t, "store_other")
    assert storage.exists(spark, "store_other") and not storage.exists(spark, t)
    storage.drop(spark, "store_other")


def test_streams(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "ts")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = live_index.live_index(stream(), ["user_id"], "ts", "e").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    from tessera.operators.indexing import index_table

    want = {r.user_id: (r.index_e, r.last_e, r.entries_e) for r in index_table(ev, "user_id", "ts", "e").collect()}
    assert {r.user_id: (r.index_e, r.last_e, r.entries_e) for r in spark.table("live").collect()} == want
    q = live_index.run_once(live_index.live_courses(stream(), ["user_id"], "ts", "e", "12 hours", "60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).columns == ["user_id", "index_therapy_e", "last_therapy_e", "entries_e"]
    q = live_index.live_counts(stream(), "ts", "1 day", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r["count"] for r in spark.table("counts").collect()) == ev.count()


def test_failed_overwrite_keeps_the_new_rows(spark, monkeypatch):
    """If the second save fails, the staging table is the only whole copy: it stays, and the error names it."""
    from pyspark.sql.readwriter import DataFrameWriter

    t = "store_fail"
    storage.drop(spark, t)
    storage.write(spark.createDataFrame([(1, "a")], "k int, v string"), t)
    real = DataFrameWriter.saveAsTable

    def failing(self, name, *a, **k):
        if name == t:
            spark.sql(f"TRUNCATE TABLE {t}")
            raise OSError("disk gone")
        return real(self, name, *a, **k)

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", failing)
    with pytest.raises(RuntimeError, match="store_fail_stage_") as e:
        storage.write(spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string"), t)
    monkeypatch.undo()
    kept = str(e.value).rsplit(" ", 1)[1]
    assert sorted(map(tuple, spark.table(kept).collect())) == [(2, "b"), (3, "c")]
    for x in (t, kept):
        storage.drop(spark, x)


def test_clean_frames_distinct_writes_and_lookups(spark):
    import pandas as pd

    from tessera.sources.catalog import lookup

    df = spark.createDataFrame([(1, "f"), (1, "f"), (2, "m")], "personid int, gender string")
    assert storage.write_all({"a": (df, "store_clean"), "b": (df, "store_dirty")}, clean={"a"}) == {"a": None, "b": 3}
    assert not storage.exists(spark, "store_clean")
    assert storage.write_distinct(df, "lookup_gender").count() == 2
    assert sorted(map(tuple, lookup(spark, "default", "gender", "lookup_{field}").collect())) == [(1, "f"), (2, "m")]
    assert storage.from_pandas(spark, pd.DataFrame({"k": [1, 2]}), "store_pandas").count() == 2
    for x in ("store_dirty", "lookup_gender", "store_pandas"):
        storage.drop(spark, x)
