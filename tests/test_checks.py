"""Checks, suite, diffs, profiles and anomalies on small tables, empty and odd ones included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dataplumb.operators import anomaly, checks, diff, profile, suite


@pytest.fixture(scope="module")
def users(spark):
    rows = [(1, "a@x.de", "active", 10.0), (2, None, "active", 20.0), (3, "bad", "odd", 30.0), (4, "c@x.de", "active", float("nan")), (4, "c@x.de", None, 1e6)]
    return spark.createDataFrame(rows, "id int, email string, status string, amount double")


@pytest.fixture(scope="module")
def empty(users):
    return users.limit(0)


def one(df):
    (row,) = df.collect()
    return row


def test_checks(users):
    assert one(checks.volume(users, 1, 4)).message == "Row count 5 exceeds maximum 4"
    r = one(checks.null_rate(users, "EMAIL", 0.1))
    assert (r.status, r.null_count, r.message) == ("fail", 1, "Null rate 0.2 (1/5) exceeds maximum 0.1")
    assert one(checks.distinct_count(users, "status", 1, 2)).status == "pass"
    r = one(checks.values_in_set(users, "status", ["active"], 0.9))
    assert (r.status, r.sample_violations) == ("fail", ["odd"])
    assert one(checks.regex_match(users, "email", "@", 0.7)).status == "pass"
    r = one(checks.duplicate_count(users, "id, email"))
    assert r.message == "1 duplicate(s) in 5 rows exceeds maximum 0; samples: '(4, c@x.de)'"
    assert one(checks.occurrence(users, "status", "max", 1, 2)).extreme_value == "active"
    assert one(checks.agg_check(users, "amount", "avg", 0, 1)).status == "fail"
    assert one(checks.compliance(users, "status = 'active'", 0.5)).compliance_rate == 0.6
    assert one(checks.match_rate(users, users.limit(2), "id", "id")).status == "fail"
    assert one(checks.schema_check(users, ["id", "x"])).missing_columns == ["x"]


def test_empty_tables_pass(empty):
    for c in (checks.null_rate(empty, "id", 0), checks.values_in_set(empty, "status", ["a"]), checks.zscore(empty, "amount", 3), checks.iqr(empty, "amount", 1.5), checks.duplicate_count(empty, "id"), checks.compliance(empty, "id > 0"), checks.match_rate(empty, empty, "id", "id"), checks.occurrence(empty, "id", "max", 1, 2), checks.agg_check(empty, "id", "sum", 0, 1)):
        assert one(c).status == "pass"
    assert one(checks.volume(empty, 1, None)).status == "fail"
    assert one(checks.rel_count_change(empty.selectExpr("date '2024-01-01' as d"), "d")).status == "pass"


def test_freshness(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("x",)], "t string")
    now = dt.datetime(2024, 1, 1, 0, 1)
    r = one(checks.freshness(df, "t", dt.timedelta(seconds=59), now))
    assert (r.status, r.age_seconds) == ("fail", 60)
    assert one(checks.freshness(df, "t", dt.timedelta(seconds=60), now)).status == "pass"


def test_arguments(users):
    for bad in (lambda: checks.null_rate(users, "nope", 0.1), lambda: checks.null_rate(users, "id", 2), lambda: checks.volume(users, 5, 1), lambda: checks.regex_match(users, "email", "(?=x)", 0), lambda: checks.agg_check(users, "id", "mode", 0, 1), lambda: checks.agg_check(users, "email", "avg", 0, 1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception):
        checks.compliance(users, "id > 0; drop table x")


def test_suite(users):
    users.createOrReplaceTempView("suite_users")
    table = suite.define_checks([
        {"check_name": "n", "check_type": "volume", "table_name": "suite_users", "lower_threshold": 9, "filter_expr": "id > 1"},
        {"check_name": "w", "check_type": "null_rate", "table_name": "suite_users", "column_name": "email", "upper_threshold": 0, "monitor_only": True},
        {"check_name": "x", "check_type": "no_such", "table_name": "suite_users"},
        {"check_name": "y", "check_type": "match_rate", "table_name": "suite_users", "column_name": "id", "params": {"right_table": "suite_users", "right_keys": "id"}, "lower_threshold": 1},
    ])
    found = {r.check_name: r for r in suite.run_checks(table).collect()}
    assert [found[k].status for k in "nwxy"] == ["fail", "warn", "error", "pass"]
    assert found["n"].message == "volume value 4.0 violates thresholds (4.0 < lower 9.0); filter matched 4/5 rows"
    assert suite.day_tokens("d >= ${today-1}", dt.date(2024, 3, 1)) == "d >= DATE '2024-02-29'"


def test_diff(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (None, "n", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 1.001), (3, "z", 3.0), (None, "m", 1.0)], "k int, s string, v double")
    got = {r.k: (r.diff_type, r.changed_columns) for r in diff.joindiff(a, b, "k", float_tolerance=0.01).collect()}
    assert got == {2: ("removed", []), 3: ("added", []), None: ("changed", ["s"])}
    with pytest.raises(Exception):
        diff.joindiff(a.union(a), b, "k").collect()
    assert [r.drift for r in diff.schema_diff(a, b.drop("v")).collect()] == ["same", "same", "removed"]


def test_profile(users, empty):
    rows = {r.column_name: r for r in profile.profile_table(users).collect()}
    assert len(rows["id"]) == 29
    assert (rows["amount"].nan_count, rows["amount"].mean, rows["id"].is_unique) == (1, 250015.0, False)
    assert rows["status"].top_values[0] == ("active", 3)
    assert {r.column_name: r.null_rate for r in profile.profile_table(empty).collect()} == dict.fromkeys(empty.columns)
    assert one(profile.profile_summary(users)).total_nulls == 2


def test_anomalies(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 1.2, 1.4, 1.6, 9, 20, 20.1, 20.2, 20.3])] + [(9, None), (10, float("inf"))], "id int, v double")
    got = {r.id: (r.cluster_id, r.point_type) for r in anomaly.dbscan(df, "v", 0.3, 3, "clusters", "id").collect()}
    assert got == {0: (0, "BORDER"), 1: (0, "CORE"), 2: (0, "CORE"), 3: (0, "BORDER"), 4: (-1, "NOISE"), 5: (1, "CORE"), 6: (1, "CORE"), 7: (1, "CORE"), 8: (1, "CORE"), 10: (-1, "NOISE")}
    values = spark.createDataFrame([(i, float(i % 10)) for i in range(300)] + [(999, 1e6)], "id int, v double")
    flagged = anomaly.isolation_forest(values, "v", 50, 256, 0.01, "scores", 1, "id").where("is_anomaly").collect()
    assert 999 in {r.id for r in flagged}


def test_profile_query_counts_all_rows(spark, tmp_path):
    from dataplumb.plans import QUERIES

    n = 1_000_400
    names = F.concat(F.lit("c"), F.col("id").cast("string")).alias("c_name")
    spark.range(1, n + 1).select(F.col("id").alias("c_custkey"), names, F.lit("BUILDING").alias("c_mktsegment"), (F.col("id") % 7).cast("double").alias("c_acctbal")).write.parquet(f"{tmp_path}/customer.parquet")
    rows = {r.column_name: r for r in QUERIES["profile_columns"](spark, str(tmp_path)).collect()}
    assert {r.row_count for r in rows.values()} == {n}
    assert (rows["c_name"].null_count, rows["c_name"].distinct_count) == (n // 10, n - n // 10)


def test_forest_samples_rows(spark):
    """Of few distinct values too, of which the first by hash alone would fill a sample."""
    values = spark.range(20_000).select("id", F.when(F.col("id") % 100 == 0, 50.0).otherwise((F.col("id") % 2).cast("double")).alias("v"))
    flagged = anomaly.isolation_forest(values, "v", 50, 64, 0.02, "scores", 2, "id").where("is_anomaly").collect()
    assert {r.value for r in flagged} == {50.0} and len(flagged) == 200


def test_suite_expressions_that_fail_on_a_row(spark):
    df = spark.createDataFrame([(1, "7"), (2, "x"), (3, "9")], "v int, t string")
    rows = [
        {"check_name": "zero", "check_type": "compliance", "table_name": "t", "params": {"expression": "10 / (v - 1) > 0"}, "lower_threshold": 0.1},
        {"check_name": "text", "check_type": "compliance", "table_name": "t", "params": {"expression": "cast(t as int) > 0"}, "lower_threshold": 0.1},
        {"check_name": "short", "check_type": "compliance", "table_name": "t", "params": {"expression": "t::int > 0 OR t = 'cast(x)'"}, "lower_threshold": 0.1},
        {"check_name": "some", "check_type": "volume", "table_name": "t", "filter_expr": "1 / (v - 2) < 5", "lower_threshold": 1},
        {"check_name": "all", "check_type": "volume", "table_name": "t", "lower_threshold": 1},
    ]
    from dataplumb.operators import suite

    got = {r.check_name: (r.status, r.value) for r in suite.run_checks(suite.define_checks(rows), tables={"t": df}).collect()}
    assert {k: (s, round(v, 3)) for k, (s, v) in got.items()} == {"zero": ("pass", 0.667), "text": ("pass", 0.667), "short": ("pass", 0.667), "some": ("pass", 2.0), "all": ("pass", 3.0)}
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
