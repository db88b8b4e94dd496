"""Every registered query of the core against its SQL in DuckDB, and plans of the ones whose shape matters."""

import datetime as dt

import duckdb
import pandas as pd
import pytest

from tessera.operators import analytics, codes, concepts, indexing
from tessera.plans import catalogue
from tessera.session import table

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def cell(v):
    if v is None or v is pd.NaT or v is pd.NA or v != v:
        return None
    if isinstance(v, (dt.datetime, dt.date, pd.Timestamp)):
        return str(v).replace(" 00:00:00", "")
    return round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v)


def rows(df):
    return sorted(map(str, (tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    got, want = catalogue.queries()[name](spark, SF).toPandas(), duck.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_without_sql_runs(spark, name):
    assert not catalogue.queries()[name](spark, SF).isEmpty()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_index_table_has_no_window(spark):
    p = plan(indexing.index_table(table(spark, SF, "orders"), "o_custkey", "o_orderdate", "o", retained=["o_orderpriority"]))
    assert "Window" not in p and p.count("Exchange") <= 2
    one = plan(indexing.index_table(table(spark, SF, "orders"), "o_custkey", "o_orderdate", "o", distinct_days="set"))
    assert "Window" not in one and one.count("Exchange") == 1


def test_concepts_scan_once(spark):
    for flags in (catalogue.FLAGS[:1], catalogue.FLAGS):
        p = plan(concepts.concept_events(table(spark, SF, "part").selectExpr("p_partkey as personid", "struct(p_type as id, 'urn:type' as codingSystemId) as code"), catalogue.closure(spark), flags, "code", ["personid"]))
        assert p.count("FileScan") == 1 and "Union" not in p and "Python" not in p


def test_pattern_verification_does_not_union(spark):
    p = plan(codes.verify_by_pattern(table(spark, SF, "part"), "p_type", codes.code_list(spark, {"a": "X", "b": "Y", "c": "Z"}), distinct_first=False))
    assert p.count("FileScan") == 1 and "Union" not in p


def test_windows_reach_the_scan(spark):
    from tessera.operators import extraction

    e = table(spark, SF, "events")
    p = plan(extraction.extract(e, e.select("user_id").limit(3), ["user_id"], date="ts", start="2024-01-05", stop="2024-01-20", fields=["event_id"]))
    assert "GreaterThanOrEqual(ts" in p and "props" not in p


def test_signal_against_known_values(spark):
    out = analytics.observed_expected(catalogue._parts_of_day(spark, SF), ["user_id"], ["part"], ["event_type"]).toPandas()
    assert (out.Percentile05 < out.observed_over_expected_Adj).all() and (out.Percentile95 > out.observed_over_expected_Adj).all()
    assert ((out.Percentile05 > 1) == out.SignalPositive).all() and out.Percentile05.is_monotonic_decreasing
