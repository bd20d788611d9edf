"""Explained outliers on small tables, and against the rules written out for one group."""

import statistics

import pytest

from dataplumb.operators.outlier_tree import outlier_tree


def test_salaries(spark):
    rows = [(i, "junior", 40000.0 + 100 * (i % 20), i % 5) for i in range(120)] + [(200 + i, "senior", 120000.0 + 500 * (i % 20), 10 + i % 5) for i in range(120)] + [(999, "junior", 125000.0, 2)]
    df = spark.createDataFrame(rows, "id int, title string, salary double, years int").coalesce(1)
    got = outlier_tree(df, "title, salary", "outliers", id_column="id").collect()
    hit = [r for r in got if r.id == 999 and r.column_name == "salary"]
    assert len(hit) == 1 and hit[0].row_id == 241 and hit[0].outlier_value == "125000"
    group = [r[2] for r in rows if r[1] == "junior"]
    median = sorted(group)[len(group) // 2]
    mad = sorted(abs(v - median) for v in group)[len(group) // 2] * 1.4826
    assert (hit[0].cluster_median, hit[0].cluster_size) == (median, len(group)) and abs(hit[0].cluster_mad - mad) < 1e-6
    assert abs(hit[0].z_score - (125000 - median) / mad) < 1e-9 and abs(hit[0].cluster_mean - statistics.mean(group)) < 1e-6
    assert '"column":"title"' in hit[0].conditions and "unusually high" in hit[0].explanation and "title" in hit[0].explanation
    summary = outlier_tree(df, "title, salary").first()
    assert summary.status == "fail" and summary.total_rows == 241 and summary.columns_analyzed == 2 and summary.max_depth_reached >= 1


def test_mostly_one_value(spark):
    df = spark.createDataFrame([(i, "shop", 999.99 if i == 50 else 1.10) for i in range(1, 101)], "receipt int, seg string, amount double").coalesce(1)
    r = outlier_tree(df, "seg, amount", "outliers").first()
    assert (r.row_id, r.outlier_value, r.cluster_median, round(r.cluster_mad, 2), round(r.z_score, 2), round(r.upper_bound, 2)) == (50, "999.99", 1.1, 12.52, 79.79, 34.53)


def test_rare_category_and_repeated_values(spark):
    rows = [(1.0 * (i % 7), "a" if i else "z") for i in range(200)]
    got = outlier_tree(spark.createDataFrame(rows, "x double, c string").coalesce(1), "x, c", "outliers").collect()
    assert [(r.column_name, r.outlier_value, r.row_id, round(r.z_score, 3)) for r in got] == [("c", "z", 1, round(200**0.5, 3))]
    often = [(5.0 if i % 10 == 0 else 0.0 + (i % 3) / 100, "a") for i in range(300)]
    assert outlier_tree(spark.createDataFrame(often, "x double, c string"), "x, c").first().status == "pass"


def test_defined_cases(spark):
    df = spark.createDataFrame([(None, "a"), (float("inf"), "b")], "x double, c string")
    assert outlier_tree(df, "x, c").first().total_rows == 1
    assert outlier_tree(df.limit(0), "x, c", "outliers").collect() == []
    for bad in ({"max_depth": 0}, {"z_norm": 0.0}, {"output_mode": "x"}, {"id_column": "c"}):
        with pytest.raises(ValueError):
            outlier_tree(df, "x, c", **bad)
