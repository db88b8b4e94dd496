"""Hand-made frames for every rule that the SQL comparison does not reach."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import dates, demographics, gamma, schema, text
from tessera.operators import analytics, codes, cohort, concepts, extraction, indexing, matching, measurements, ontology, profiling

D = dt.date
STAYS = [
    ("a", D(2020, 1, 1), D(2020, 3, 1), "x"), ("a", D(2020, 1, 10), D(2020, 1, 12), "y"), ("a", D(2020, 1, 10), None, "z"), ("a", None, D(2020, 6, 1), "n"), ("b", D(2020, 1, 1), D(2019, 1, 1), "q"),
    ("c", D(2020, 1, 1), None, "r"), ("c", D(2020, 1, 11), None, "s"), ("c", D(2020, 2, 11), None, "t"), ("d", None, None, "u"),
]


@pytest.fixture(scope="module")
def stays(spark):
    return spark.createDataFrame(STAYS, "person string, start date, stop date, tag string")


def by(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_index_rules(stays):
    r = by(indexing.index_table(stays, "person", "start", "s", stop="stop", retained=["tag"]), "person")
    assert r["a"] == {"person": "a", "tag": "x", "index_s": D(2020, 1, 1), "last_s": D(2020, 1, 12), "entries_s": 4, "encounter_days_s": 2}
    assert r["b"]["last_s"] == D(2020, 1, 1)  # a stop before its start is the start
    assert r["d"]["index_s"] is None and r["d"]["entries_s"] == 1 and r["d"]["encounter_days_s"] == 0
    assert by(indexing.index_table(stays, "person", "start", "s", stop="stop", last_mode="max"), "person")["a"]["last_s"] == D(2020, 6, 1)
    windowed = by(indexing.index_table(stays, "person", "start", "s", start="2020-01-05"), "person")
    assert set(windowed) == {"a", "c"}
    with pytest.raises(ValueError):
        indexing.index_table(stays, "person", "start", "s", last_mode="other").collect()


def test_retained_ties_are_settled(spark):
    rows = [("p", D(2020, 1, 1), t, k) for t, k in (("c", 1), ("a", 2), ("b", 3))]
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "person string, d date, tag string, k int").repartition(3)
        assert indexing.index_table(df, "person", "d", "x", retained=["tag"], sort_fields=["k"]).first().tag == "c"
        assert indexing.index_table(df, "person", "d", "x", retained=["tag", "k"], max_gap=3, sort_fields=["tag"]).first().tag == "a"


def test_courses(stays):
    out = indexing.index_table(stays.where("person = 'c'"), "person", "start", "s", max_gap=10).orderBy("course_of_therapy_s").collect()
    assert [(r.course_of_therapy_s, r.index_therapy_s, r.last_therapy_s, r.encounter_days_for_course_s, r.max_gap_s) for r in out] == [
        (0, D(2020, 2, 11), D(2020, 2, 11), 1, None),
        (1, D(2020, 1, 1), D(2020, 1, 11), 2, 10),
    ]


def model_courses(days, stops, max_gap):
    """Plain walk backwards through dated stays, one for each date."""
    best = {}
    for a, b in zip(days, stops):
        best[a] = max(best.get(a, a), b if b and b > a else a)
    ds = sorted(best)
    last = best[ds[-1]]
    course, out = 0, {}
    for i in range(len(ds) - 1, -1, -1):
        gap = (ds[i + 1] - best[ds[i]]).days if i + 1 < len(ds) else None
        if not (gap is not None and gap <= max_gap) and best[ds[i]] != last:
            course += 1
        out.setdefault(course, []).append(ds[i])
    return {c: (min(v), len(v)) for c, v in out.items()}


def test_courses_match_a_plain_walk(spark):
    rng = random.Random(5)
    rows = [(p, D(2020, 1, 1) + dt.timedelta(days=rng.randrange(400)), None) for p in range(40) for _ in range(rng.randrange(1, 15))]
    rows = [(p, a, a + dt.timedelta(days=rng.randrange(20)) if rng.random() < 0.5 else None) for p, a, _ in rows]
    out = indexing.index_table(spark.createDataFrame(rows, "p int, a date, b date"), "p", "a", "s", stop="b", max_gap=25).collect()
    got = {}
    for r in out:
        got.setdefault(r.p, {})[r.course_of_therapy_s] = (r.index_therapy_s, r.encounter_days_for_course_s)
    for p in range(40):
        mine = [x for x in rows if x[0] == p]
        assert got[p] == model_courses([x[1] for x in mine], [x[2] for x in mine], 25)


def test_windows_and_collisions(spark):
    src = spark.createDataFrame([(1, D(2020, 1, 1), "s"), (2, D(2020, 6, 1), "s"), (3, D(2020, 1, 5), "s")], "k int, d date, v string")
    idx = spark.createDataFrame([(1, D(2020, 1, 10), "i"), (2, D(2020, 1, 10), "i")], "k int, ref date, v string")
    inner = extraction.extract(src, idx, ["k"], date="d", reference="ref", start=-10, stop=10)
    assert [(r.k, r.v) for r in inner.collect()] == [(1, "i")]
    left = extraction.extract(src, idx, ["k"], date="d", reference="ref", start=-10, stop=10, how="left")
    assert sorted(r.k for r in left.collect()) == [1, 3]
    assert extraction.extract(src, idx, ["k"], date="d", start="2020-03-01").count() == 1
    for bad in ({"collisions": "raise"}, {"start": 1}, {"date": "d", "start": 1}, {"collisions": "other"}):
        with pytest.raises(ValueError):
            extraction.extract(src, idx, ["k"], **bad)
    with pytest.raises(ValueError):
        extraction.extract(src, [1], ["k"])
    with pytest.raises(ValueError):
        extraction.attach(src, [idx], ["k"])
    cohort_rows = extraction.extract(src, src.select("k"), ["k"], cohort=idx, cohort_columns=["ref"])
    assert {(r.k, r.ref) for r in cohort_rows.collect()} == {(1, D(2020, 1, 10)), (2, D(2020, 1, 10))}


def test_code_lists(spark, tmp_path):
    assert [tuple(r) for r in codes.code_list(spark, ["a", "b"]).collect()] == [("group_0", "a"), ("group_1", "b")]
    assert tuple(codes.code_list(spark, "x").first()) == ("default", "x")
    (tmp_path / "c.csv").write_text("Category,code,N\n  café, A1,3\n,B2,\n", encoding="utf-8")
    rows = codes.csv_code_list(spark, str(tmp_path / "c.csv"), drop_missing=True, subset=["Category"]).collect()
    assert [(r.Category, r.code, r.N) for r in rows] == [("café", "A1", 3)]
    src = spark.createDataFrame([("A1",), ("AB",), (None,)], "code string")
    many = codes.verify_by_pattern(src, "code", codes.code_list(spark, {"x": "A", "y": "^A.$", "z": "q"}))
    assert sorted((r.code, r.group) for r in many.collect()) == [("A1", "x"), ("A1", "y"), ("AB", "x"), ("AB", "y")]
    with pytest.raises(ValueError):
        codes.verify(src, codes.code_list(spark, "A"), "regex")
    with pytest.raises(ValueError):
        codes.verify(src, codes.code_list(spark, "A"), "other", "code")
    assert codes.verify_by_merge(src, ["AB", "zz"], "code").count() == 1


CLOSURE = [("C1", "ECHO", "s", "e1"), ("C1", "ECHO", "s", "e1"), ("C1", "LVEF", "s", "l1"), ("C2", "ECHO", "s", "e2"), ("C1", "NONE", "s", None)]


@pytest.fixture(scope="module")
def onto(spark):
    return concepts.Ontology(spark.createDataFrame(CLOSURE, "context string, concept string, coding_system string, code string"))


def test_concept_multiplicity_and_guards(spark, onto):
    rows = [("p1", "t", D(2020, 1, 1), ("e1", "s")), ("p2", "t", D(2020, 1, 2), ("l1", "s")), ("p3", "t", D(2020, 1, 3), ("zz", "s")), ("p4", "t", D(2020, 1, 3), ("e1", None))]
    src = spark.createDataFrame(rows, "personid string, tenant string, d date, code struct<id: string, codingSystemId: string>")
    flags = [{"flag": "echo", "concept": "ECHO", "context": "C1"}, {"flag": "lvef", "concept": "LVEF", "context": "C1"}, {"flag": "echo", "concept": "ECHO", "context": "C1"}]
    got = sorted((r.personid, r.flag) for r in concepts.concept_events(src, onto, flags, "code", ["personid"]).collect())
    assert got == [("p1", "echo"), ("p1", "echo"), ("p2", "lvef")]
    assert concepts.concept_subsets(flags) == {"C1": ["ECHO", "LVEF"]}
    for bad in ([{"concept": "ECHO"}], [{"concept": "WHAT", "context": "C1"}], []):
        with pytest.raises(ValueError):
            concepts.concept_events(src, onto, bad, "code", ["personid"])
    with pytest.raises(ValueError, match="flag"):
        concepts.concept_events(src.withColumn("flag", F.lit(1)), onto, flags, "code", ["flag"])
    with pytest.raises(ValueError):
        concepts.concept_flags(src, onto, flags, "code", ["personid"])  # one name twice
    people = spark.createDataFrame([("p1",), ("p3",), ("p9",)], "personid string")
    f = by(concepts.concept_flags(src, onto, flags[:2], "code", ["personid"], cohort=people, fill_zero=True), "personid")
    assert {k: (v["echo"], v["lvef"]) for k, v in f.items()} == {"p1": (1, 0), "p3": (0, 0), "p9": (0, 0)}
    with pytest.raises(ValueError):
        concepts.with_code_columns(src.select("personid", F.struct(F.lit("a").alias("id")).alias("code")), "code")


def test_distill_rules(spark):
    rows = [("p", "5", "2020-01-01", "mg", None, "2020-01-02"), ("p", "x", "2020-01-02", "mg", False, "2020-01-02"), ("p", "7", "2020-01-02", "g", False, "2020-01-02"), ("p", "99", "2020-01-03", "mg", True, "2020-01-02"), ("p", "6", "bad", "mg", False, "2020-01-02")]
    df = spark.createDataFrame(rows, "person string, v string, d string, u string, bad boolean, ref string")
    r = measurements.distill(df, "v", "d", ["person"], "t", invalid="bad", unit="u", reference="ref", median="exact").first()
    assert (r.t_n, r.t_max, r.t_median, r.t_unit_n, r.t_pre_peak, r.t_post_peak, r.t_post_delta, r.t_first_value, r.t_last_value) == (2, 7.0, 6.0, 2, 5.0, 7.0, 2.0, 5.0, 7.0)
    with pytest.raises(Exception, match="more than one"):
        measurements.distill(df, "v", "d", ["person"], "t", invalid="bad", unit="u", mixed_units="raise").collect()


def test_features_do_not_fan_out(spark):
    rows = [("p", "c", "mg", D(2020, 1, 1), "1"), ("p", "c", "mg", D(2020, 1, 3), "5"), ("p", "c", "g", D(2020, 1, 2), "9"), ("q", "c", "mg", D(2020, 1, 1), "0")]
    df = spark.createDataFrame(rows, "person string, code string, unit string, d date, v string")
    out = {(r.person, r.unit): r for r in measurements.features(df, ["code"], "v", "d", ["person"], unit="unit").collect()}
    assert len(out) == 3 and out["p", "mg"].avg_daily_change == 2.0 and out["p", "g"].trend_direction == "insufficient_data"
    assert out["q", "mg"].coefficient_variation is None and out["p", "mg"].trend_direction == "increasing"
    with pytest.raises(ValueError):
        measurements.features(df, ["code"], "v", "d", ["person"], unit="units")


def test_features_round_like_the_sql(spark, tmp_path):
    """Means that lie on a tie of the last digit: sums must be taken in the order of days and values."""
    import duckdb

    from tessera.plans import catalogue

    values = {
        54: [(3, 16.15), (5, 21.77), (6, 63.5), (9, 31.47), (11, 3.14), (11, 19.26), (11, 148.2), (14, 27.8), (19, 21.44), (23, 6.64), (23, 34.72), (27, 3.23)],
        94: [(4, 33.22), (6, 44.35), (9, 59.82), (13, 100.19), (15, 11.77), (17, 21.97), (19, 39.4), (21, 6.82), (21, 52.72), (24, 1.4)],
    }
    rows = [(u, "view", dt.datetime(2024, 1, 1) + dt.timedelta(days=d), v) for u, x in values.items() for d, v in x]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    want = {r[0]: r[1] for r in con.sql(f"select user_id, avg_daily_change from ({catalogue.oracle_sql()['measurement_features']})").fetchall()}
    got = {r.user_id: r.avg_daily_change for r in catalogue.measurement_features(spark, str(tmp_path)).collect()}
    assert got == want == {54: -4.159937, 94: -5.372188}


def test_features_keep_the_sign_of_zero(spark, tmp_path):
    """A small fall rounds to -0.0 in the SQL, which is another value than 0.0 wherever rows are compared by their text or bytes."""
    import duckdb

    from tessera.plans import catalogue

    falls = {1: (5.0000003, 5.0000002, 5.0), 2: (5.0, 5.0000001, 5.0000002), 3: (5.0, 5.0, 5.0), 4: (0.0, 7.5, -2.25)}
    rows = [(u, "view", dt.datetime(2024, 1, 1 + i), v) for u, x in falls.items() for i, v in enumerate(x)]
    path = str(tmp_path / "events.parquet")
    spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double").write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    want = {r[0]: str(r) for r in con.sql(catalogue.oracle_sql()["measurement_features"]).fetchall()}
    got = {r.user_id: str(tuple(r)) for r in catalogue.measurement_features(spark, str(tmp_path)).select(con.sql(catalogue.oracle_sql()["measurement_features"]).columns).collect()}
    assert got == want and "-0.0," in want[1] and "-0.0," not in want[2] + want[3]


def test_features_of_nulls_like_the_sql(spark, tmp_path):
    """The SQL takes no change to or from a missing value; the operator by itself skips it."""
    import duckdb

    from tessera.plans import catalogue

    day = lambda i: None if i is None else dt.datetime(2024, 1, 1 + i)
    series = {1: [(0, 1.0), (1, None), (2, 5.0), (4, 4.0)], 2: [(0, 1.0), (0, None), (1, 3.0), (2, 7.0)], 3: [(None, 9.0), (0, 1.0), (3, 2.5), (None, 0.25)], 4: [(0, None), (1, None), (2, None)], None: [(0, 1.0), (1, 2.0), (5, 4.5)]}
    rows = [(u, "view", day(i), v) for u, x in series.items() for i, v in x]
    path = str(tmp_path / "events.parquet")
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts timestamp, value double")
    df.write.parquet(path)
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{path}/*.parquet'")
    sql = catalogue.oracle_sql()["measurement_features"]
    want = {r[0]: r for r in con.sql(sql).fetchall()}
    got = {r.user_id: tuple(r) for r in catalogue.measurement_features(spark, str(tmp_path)).select(con.sql(sql).columns).collect()}
    assert got == want and len(want) == 5
    skipped = {r.user_id: r.avg_daily_change for r in measurements.features(df, ["event_type"], "value", "ts", ["user_id"]).collect()}
    assert skipped[1] == 0.75 and skipped[2] == 3.0 and skipped[4] is None


def test_gamma_closed_forms():
    for k in (1, 2, 5, 30):
        for x in (0.01, 0.5, 1.0, 4.0, 40.0, 90.0):
            want = math.exp(-x) * sum(x**i / math.factorial(i) for i in range(k))
            assert gamma.survival(k, 1.0, x) == pytest.approx(want, rel=1e-10, abs=1e-300)
    assert gamma.survival(0.5, 1.0, 1.3) == pytest.approx(math.erfc(math.sqrt(1.3)), rel=1e-10)
    for a, b, p in ((0.3, 2.0, 0.05), (1.0, 1.0, 0.5), (7.5, 3.0, 0.95), (1000.0, 0.1, 0.05)):
        assert gamma.survival(a, b, gamma.quantile(a, b, p)) == pytest.approx(1 - p, abs=1e-10)
    assert np.isnan(gamma.survival([np.nan, -1], 1.0, 1.0)).all() and np.isnan(gamma.quantile(0.0, 1.0, 0.5))


def test_matching(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "fm"[i // 10 % 2], float(rng.integers(0, 30)), float(rng.integers(0, 5))) for i in range(200)] + [(500, None, 1.0, 1.0)]
    people = spark.createDataFrame(rows, "personid long, g string, x double, y double")
    cases, pool = people.where("personid % 10 = 0"), people.where("personid % 10 != 0")
    got = [tuple(r) for r in matching.match(cases, pool, ["g"], ["x", "y"], per_case=3).collect()]
    assert len(got) == 60 and len({c for _, c, _, _ in got}) == 60
    sex = {r[0]: r[1] for r in rows}
    assert all(sex[a] == sex[b] for a, b, _, _ in got)
    # the hardest case has its nearest controls
    at = {r[0]: np.array(r[2:]) for r in rows}
    for g in "fm":
        cs, ps = [c for c in at if sex[c] == g and c % 10 == 0], [c for c in at if sex[c] == g and c % 10]
        near = {c: min(np.linalg.norm(at[c] - at[p]) for p in ps) for c in cs}
        first = min(cs, key=lambda c: (-near[c], c))
        best = sorted(ps, key=lambda p: (np.linalg.norm(at[first] - at[p]), p))[:3]
        assert [b for a, b, k, _ in sorted(got, key=lambda r: r[2]) if a == first] == best
    again = matching.match(cases.repartition(5), pool.repartition(7), ["g"], ["x", "y"], per_case=3).collect()
    assert sorted(map(tuple, again)) == sorted(got)
    few = pool.limit(50)
    done = matching.match_rounds(cases, few, [{"strata": ["g", "x"]}, {"strata": ["g"], "quality": "loose"}], ["x", "y"], per_case=3, save=lambda f: f.cache())
    rows = done.collect()
    per = {}
    for r in rows:
        per[r.case_id] = per.get(r.case_id, 0) + 1
    assert max(per.values()) <= 3 and len({r.control_id for r in rows}) == len(rows) and {r.iteration for r in rows} <= {1, 2}
    with pytest.raises(ValueError):
        matching.prepare(people, cases, strata=["nope"], distances=["x"], age=None)


def test_standardize_constant(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None)], "k int, v double")
    assert [r.z_v for r in matching.standardize(df, ["v"]).orderBy("k").collect()] == [0.0, 0.0, None]


def test_distance_and_posterior(spark):
    df = spark.createDataFrame([(1.0, 2.0, 4.0, 6.0), (1.0, None, 1.0, 9.0)], "x double, y double, x_case double, y_case double")
    assert [r[0] for r in df.select(matching.distance(["x", "y"])).collect()] == [5.0, 0.0]
    noisy = df.select(matching.distance(["x", "y"], seed=1)).collect()
    assert 5.0 <= noisy[0][0] < 5.00001
    s = df.select(gamma.posterior_survival(F.lit(3), F.lit(1.0)).alias("s")).first().s
    assert s == pytest.approx(math.exp(-6) * sum(6**i / math.factorial(i) for i in range(4)))


def test_dates(spark):
    df = spark.createDataFrame([("2020-02-03", None), ("bad", "2019-01-01"), (None, None)], "a string, b string")
    rows = dates.date_parts(df, ["a", "b"], ["year", "month"]).collect()
    assert [(r.year, r.month, r.year_is_unknown) for r in rows] == [(2020, 2, False), (2019, 1, False), (-1, -1, True)]
    with pytest.raises(ValueError):
        dates.date_parts(df, None, ["year"])
    assert dates.mark_unknown(df.withColumn("year", F.lit(None).cast("int")), ["year"]).first().year == -1


def test_schema_tools(spark):
    df = spark.createDataFrame([(1, ("a", ("i", "s", "d")), [("x", 1), ("y", 2)])], "k int, c struct<raw: string, standard: struct<id: string, codingSystemId: string, primaryDisplay: string>>, arr array<struct<n: string, m: int>>")
    assert [p for p, _ in schema.flat_paths(df.schema)] == ["k", "c.raw", "c.standard.id", "c.standard.codingSystemId", "c.standard.primaryDisplay", "arr"]
    with pytest.raises(ValueError):
        schema.flatten(df)
    flat = schema.flatten(df, "arr")
    assert flat.columns == ["k", "c_raw", "c_standard_id", "c_standard_codingSystemId", "c_standard_primaryDisplay", "arr_n", "arr_m"] and flat.count() == 2
    assert schema.standard_roots(df.schema) == {"c.standard": list(schema.TRIPLET)}
    assert schema.select_by_regex(flat, ["STANDARD_ID$", "^k"]).columns == ["k", "c_standard_id"]
    assert schema.align_union([]) is None


def test_text_functions(spark):
    df = spark.createDataFrame([("café", "abcd"), ("plain", None), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(text.nfc(F.col("a"))).collect()] == ["café", "plain", None]
    assert df.select(text.similarity(F.lit("abcf"), F.col("b")).alias("s")).first().s == 0.75


def test_groupings(spark):
    df = spark.createDataFrame([("Asian Indian", 17.9), ("caucasian", 18.0), (None, None), ("x", 200.0)], "t string, age double")
    c = F.col("t")
    assert [r[0] for r in df.select(demographics.race_group(c)).collect()] == ["Asian", "Other/Unknown", "Other/Unknown", "Other/Unknown"]
    assert [r[0] for r in df.select(demographics.race_group_by_pattern(c)).collect()] == ["Asian", "White", "Other/Unknown", "Other/Unknown"]
    assert [r[0] for r in df.select(demographics.age_group(F.col("age"))).collect()] == ["<18", "18-34", "Unknown", "Unknown"]
    with pytest.raises(ValueError):
        demographics.age_group(c, (1, 2, 3), ("a",))


def test_aggregate_names(spark):
    df = spark.createDataFrame([(1, "g", 2.0, 3.0), (2, "g", 4.0, 5.0)], "id int, g string, a double, b double")
    pair = analytics.aggregate_fields(df, ["id"], ["a", "b"], ["sum", "max"], ["s", "m"]).first()
    assert (pair.s, pair.m, pair.id_distinct_count) == (6.0, 5.0, 2)
    cross = analytics.aggregate_fields(df.drop("b"), ["id"], ["a"], ["sum", "min", "max"]).first()
    assert (cross.a_sum, cross.a_min, cross.a_max) == (6.0, 2.0, 4.0)
    assert analytics.tabulate(df, count_distinct=["id", "nope"]).first().n_id == 2


def test_oe_keeps_unknown_groups(spark):
    df = spark.createDataFrame([(1, None, "o"), (2, "g", "o"), (3, "g", None)], "p int, g string, o string")
    out = analytics.observed_expected(df, ["p"], ["g"], ["o"], signals=False).collect()
    assert len(out) == 3 and all(r.group_A_B and r.event_A_C for r in out)


def test_upsert_null_keys(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", 2020, 2)], "t string, y int, n int")
    new = spark.createDataFrame([(None, "a", 9)], "y int, t string, n int")
    assert sorted((r.t, r.n) for r in ontology.upsert(old, new, ["t", "y"]).collect()) == [("a", 9), ("b", 2)]


def test_days_covered_overlaps(spark):
    rows = [("p", D(2020, 1, 1), D(2020, 1, 10)), ("p", D(2020, 1, 5), D(2020, 1, 6)), ("p", D(2020, 1, 8), D(2020, 1, 12)), ("p", D(2020, 12, 30), D(2021, 5, 1))]
    index = spark.createDataFrame([("p", D(2020, 1, 3)), ("q", D(2020, 1, 1))], "k string, i date")
    r = by(cohort.days_covered(spark.createDataFrame(rows, "k string, a date, b date"), ["k"], "a", "b", index, "i"), "k")
    assert r["p"]["covered_days"] == 10 + 3 and r["q"]["covered_days"] == 0


def test_empty_frames(spark, stays, onto):
    none = stays.limit(0)
    assert indexing.index_table(none, "person", "start", "s").count() == 0
    assert indexing.index_table(none, "person", "start", "s", max_gap=3).count() == 0
    assert profiling.attrition(none, "person", ["start", "stop"]).first().n_rows == 0
    assert measurements.distill(none, "tag", "start", ["person"]).count() == 0


def test_bounded_vocabularies(spark, monkeypatch):
    from tessera.operators import analytics, matching, ontology

    df = spark.createDataFrame([(i, f"v{i}", float(i)) for i in range(6)], "k int, v string, x double")
    spark.conf.set("spark.sql.pivotMaxValues", "5")
    try:
        with pytest.raises(ValueError, match="more than 5"):
            analytics.pivot_counts(df, ["k"], "v", ["k"])
        assert analytics.pivot_counts(df.where("k < 5"), ["k"], "v", ["k"]).count() == 5
    finally:
        spark.conf.unset("spark.sql.pivotMaxValues")
    monkeypatch.setattr(ontology, "CROSSWALK_IDS", 5)
    with pytest.raises(ValueError, match="coding systems"):
        ontology.crosswalk(df.select(F.col("v").alias("codingSystemId")), df.select(F.col("v").alias("codingSystemId")))


def test_counts_read_the_source_twice(spark):
    """Once for the three grains, once for the persons of each group."""
    from tessera.plans import catalogue

    plan = catalogue.queries()["ontology_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 2


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tessera import session

    assert session.own_folder(spark)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.own_folder(SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077")))
