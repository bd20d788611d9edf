"""What a suite's messages tell of rows, filters and identifiers."""

import datetime as dt

import pytest

from dataplumb.operators import suite


@pytest.fixture(scope="module")
def rows(spark):
    data = [("a", "1", "x", "2024-01-01"), ("a", "two", "x", "2024-01-02"), ("b", None, None, "never"), ("b", "4", "y", None), ("b", "-5", "y", "2024-01-03")]
    return spark.createDataFrame(data, "part string, amount string, note string, day string")


def run(rows, *specs):
    specs = [{"check_name": f"c{k}", "table_name": "t", **s} for k, s in enumerate(specs)]
    return suite.run_checks(suite.define_checks(specs), dt.datetime(2024, 1, 9), {"t": rows}).collect()


def test_rows_that_fail_are_told_from_nulls(rows):
    (r,) = run(rows, {"check_type": "compliance", "params": {"expression": "CAST(amount AS INT) > 0"}})
    assert r.value == 2 / 5 and r.message == "compliance value 0.4: no thresholds configured (monitor); 1 row(s) could not be evaluated (counted as non-compliant)"
    (r,) = run(rows, {"check_type": "compliance", "params": {"expression": "note IN ('x', 'amount')"}, "lower_threshold": 0.1})
    assert r.message == "compliance value 0.4 is within thresholds"
    parts = run(rows, {"check_type": "compliance", "params": {"expression": "CAST(amount AS INT) > 0"}, "identifier_column": "part"})
    assert [("1 row(s) could not" in r.message) for r in parts] == [True, False]


def test_empty_tables_filters_and_identifiers(rows):
    gone = {"filter_expr": "amount = '99'"}
    (a,) = run(rows, {"check_type": "null_rate", "column_name": "note", "identifier_column": "part", **gone})
    assert (a.identifier, a.value, a.status, a.message) == (None, None, "pass", "No value to evaluate; check passed trivially; filter matched 0/5 rows")
    (b,) = run(rows, {"check_type": "null_rate", "column_name": "note", "identifier_column": "part", "params": {"fail_on_empty": True}, **gone})
    assert (b.status, b.message) == ("fail", "No rows to evaluate: filter matched 0/5 rows (fail_on_empty)")
    (c,) = run(rows.limit(0), {"check_type": "distinct_count", "column_name": "note", "params": {"fail_on_empty": True}})
    assert (c.value, c.status, c.message) == (None, "fail", "No rows to evaluate: table 't' is empty (fail_on_empty)")
    assert run(rows.limit(0), {"check_type": "volume", "identifier_column": "part"}) == []
    parts = run(rows, {"check_type": "volume", "identifier_column": "part", "filter_expr": "note = 'y'"})
    assert [(r.identifier, r.message) for r in parts] == [("b", "volume value 2.0: no thresholds configured (monitor); filter matched 2/3 rows")]


def test_dates_samples_and_columns(rows):
    got = {r.check_name: r for r in run(
        rows,
        {"check_type": "freshness", "column_name": "day", "params": {"reference_time": "2024-01-04"}, "upper_threshold": 1e6},
        {"check_type": "rel_count_change", "params": {"date_column": "day"}},
        {"check_type": "values_in_set", "column_name": "note", "params": {"allowed_values": ["x"]}, "lower_threshold": 0.9, "identifier_column": "part"},
        {"check_type": "schema_check", "params": {"columns": ["part", "Gone", "gone", "other"]}},
        {"check_type": "metric_anomaly_iqr", "params": {"date_column": "day", "reference_date": "2024-02-01", "fail_on_empty": True}, "column_name": "amount", "filter_expr": "amount is null or amount rlike '^-?[0-9]+$'"},
    ) if r.identifier != "a"}
    assert got["c0"].message == "freshness value 86400.0 seconds is within thresholds; 1 row(s) skipped (day is not a timestamp)"
    assert got["c1"].message.endswith("; 1 row(s) skipped (day is not a date)")
    assert got["c2"].message == "values_in_set value 0.0 violates thresholds (0.0 < lower 0.9); samples: 'y'"
    assert got["c3"].value == 2.0 and got["c3"].message.endswith("; missing columns: 'Gone', 'other'")
    assert got["c4"].status == "error" or got["c4"].message.startswith("No metric value on 2024-02-01 (fail_on_empty)")


def test_exact_aggregates_keep_their_digits(spark):
    df = spark.sql("SELECT 9007199254740993L AS n, CAST(310.5 AS DECIMAL(9, 2)) AS d")
    a, b = run(df, {"check_type": "agg", "column_name": "n", "params": {"agg": "max"}, "upper_threshold": 5.0}, {"check_type": "agg", "column_name": "d", "params": {"agg": "sum"}, "upper_threshold": 200.0})
    assert a.message == "agg value 9007199254740993 violates thresholds (9007199254740993 > upper 5)"
    assert b.message == "agg value 310.50 violates thresholds (310.50 > upper 200.00)"
