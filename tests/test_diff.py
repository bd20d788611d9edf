"""Diffs by digests, and columns whose types differ."""

import pytest

from pyspark.sql import functions as F

from dataplumb.operators import diff


def rows(df, key="k"):
    return sorted(((r[key], r.diff_type, tuple(r.changed_columns)) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def tables(spark):
    a = spark.range(500).selectExpr("id AS k", "id * 1.5D AS v", "concat('t', id) AS s", "CAST(id AS DECIMAL(20, 2)) AS d")
    b = a.where("k % 100 <> 7").withColumn("v", F.when(F.col("k") % 50 == 3, F.col("v") + 1e-9).when(F.col("k") % 50 == 4, None).otherwise(F.col("v")))
    return a, b.union(spark.sql("SELECT 1000L, 0D, 'new', CAST(1 AS DECIMAL(20, 2))"))


def test_digests_change_no_result(tables):
    a, b = tables
    for options in ({}, {"float_precision": 4}):
        assert rows(diff.hashdiff(a, b, "k", **options)) == rows(diff.joindiff(a, b, "k", **options))
    assert rows(diff.hashdiff(a, b, "k"))[0] == (1000, "added", ()) and len(rows(diff.hashdiff(a, b, "k"))) == 5 + 10 + 10 + 1
    assert rows(diff.hashdiff(a, a, "k")) == [] and rows(diff.hashdiff(a.limit(0), b.limit(0), "k")) == []
    assert len(rows(diff.hashdiff(a.limit(0), b, "k"))) == b.count()


def test_keys_that_stand_twice_are_errors_with_digests(tables):
    a, b = tables
    with pytest.raises(Exception, match="duplicate key"):
        diff.hashdiff(a.union(a.limit(1)), a, "k").collect()
    with pytest.raises(ValueError):
        diff.joindiff(a, b, "k", include_all=True, digests=True)


def test_numbers_of_other_types_by_value_and_null_keys(spark):
    a = spark.sql("SELECT * FROM VALUES (1, CAST(5000 AS DECIMAL(10, 2)), 'x'), (2, CAST(7 AS DECIMAL(10, 2)), '7'), (NULL, NULL, NULL) AS t(k, v, s)")
    b = spark.sql("SELECT * FROM VALUES (1L, 5000D, 'x'), (2L, 8D, '7'), (NULL, NULL, NULL) AS t(k, v, s)")
    for f in (diff.hashdiff, diff.joindiff):
        assert rows(f(a, b, "k")) == [(2, "changed", ("v",))]
    big = [spark.sql(f"SELECT 1 AS k, CAST({n} AS {kind}) AS v") for n, kind in ((9007199254740993, "BIGINT"), (9007199254740992, "DECIMAL(20, 0)"))]
    for f in (diff.hashdiff, diff.joindiff):
        assert rows(f(*big, "k")) == [(1, "changed", ("v",))]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_zoned_timestamps_do_not_depend_on_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        a = spark.sql("SELECT k, timestamp_micros(m) AS ts FROM VALUES (1, 1709251200000000L), (2, 1709251200500000L), (3, NULL) AS t(k, m)")
        b = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP_NTZ'2024-03-01 00:00:00'), (2, TIMESTAMP_NTZ'2024-03-01 00:00:01'), (3, NULL) AS t(k, ts)")
        c = spark.sql("SELECT * FROM VALUES (1, '2024-03-01 00:00:00+00'), (2, '2024-03-01 00:00:00.5+00'), (3, 'n/a') AS t(k, ts)")
        for f in (diff.hashdiff, diff.joindiff):
            assert rows(f(a, b, "k")) == rows(f(b, a, "k")) == [(2, "changed", ("ts",))]
            assert rows(f(a, c, "k")) == [(3, "changed", ("ts",))]
        keyed = diff.hashdiff(a.where("k = 1").select("ts", "k"), b.where("k = 1").select("ts", "k"), "ts")
        assert keyed.collect() == []
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
