"""The session, the command line, the pytest plugin, postal addresses, and numbers that a double can't tell apart."""

import json
import logging

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dataplumb import config, pytest_plugin
from dataplumb.__main__ import main
from dataplumb.functions import postal
from dataplumb.operators import checks, profile
from dataplumb.session import Session


@pytest.fixture(scope="module")
def dq(spark):
    return Session(spark)


def test_frames(dq):
    frame = pd.DataFrame({"a": [1, 2, 3], "b": ["x", None, "z"]})
    for data in (frame, pa.Table.from_pandas(frame), dq.frame(frame)):
        result = dq.quality_check(data, {"volume": {"min_rows": 3}, "null_rate": {"column": "b", "max_null_rate": 0.1}, "distinct_count": {"column": "a"}})
        assert result.status == "fail" and {k: v["status"] for k, v in result["checks"].items()} == {"volume": "pass", "null_rate": "fail", "distinct_count": "pass"}
    assert dq.validate(frame, {"a": "bigint", "b": "string"}).valid
    assert dq.validate(frame, {"a": "string", "c": "int"}).errors == ["column 'a' is bigint, not string", "column 'c' is missing"]
    assert dq.profile(frame).count() == 2
    with pytest.raises(ValueError):
        dq.quality_check(frame, {"zscore": {}})
    with pytest.raises(TypeError):
        dq.frame(3)


def test_sql(dq, spark):
    spark.range(10).selectExpr("id", "if(id > 7, null, id) v", "'o''k' t").createOrReplaceTempView("some_rows")
    row = dq.sql("SELECT n.status, v.status AS s2 FROM null_rate('some_rows', 'v', 0.1) n CROSS JOIN volume('some_rows', 1, NULL) v").first()
    assert tuple(row) == ("fail", "pass")
    assert dq.sql("SELECT status FROM values_in_set('some_rows', 't', ['o''k', 'a,b)'], min_rate := 1.0)").first()[0] == "pass"


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "rows.csv")
    pd.DataFrame({"a": [1, None], "b": ["x", "y"]}).to_csv(path, index=False)
    assert main(["quality", path, "--volume-min", "2"], spark) == 0
    assert main(["quality", path, "--null-max", "0.1", "--column", "a"], spark) == 1
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["status"] == "fail"
    assert main(["profile", path, "--format", "csv"], spark) == 0
    with pytest.raises(SystemExit):
        main(["quality", path], spark)


def test_plugin(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert pytest_plugin.failures("three", volume_min=3) == [] and len(pytest_plugin.failures("three", volume_min=4)) == 1


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("221B Baker Street, London", ("221b", "baker street", "london", None, None, None)),
        ("Hauptstr. 5, 80331 München, Germany", ("5", "hauptstr.", "münchen", None, "80331", "germany")),
        ("350 5th Ave, New York NY 10118, USA", ("350", "5th ave", "new york", "ny", "10118", "usa")),
        ("10 Downing Street, London SW1A 2AA", ("10", "downing street", "london", None, "sw1a 2aa", None)),
        (None, None),
    ],
)
def test_postal(spark, text, parts):
    got = spark.createDataFrame([(text,)], "t string").select(postal.postal_parse_address(F.col("t")), postal.postal_expand_address(F.col("t"))).first()
    assert (None if got[0] is None else tuple(got[0])) == parts
    assert (got[1] is None) == (text is None)


def test_settings():
    config.set_trace(config.Config(trace_enabled=True, trace_level="debug"))
    assert logging.getLogger("dataplumb").level == logging.DEBUG
    config.set_trace()
    assert logging.getLogger("dataplumb").level == logging.WARNING


def test_whole_numbers_beyond_doubles(spark):
    base = 2**60
    df = spark.createDataFrame([(base + k,) for k in [*range(40)] * 5 + [5000]], "v long")
    row = checks.zscore(df, "v", 3.0).first()
    assert row.outlier_count == 1 and 300 < row.stddev < 400
    row = checks.iqr(df, "v", 1.5).first()
    assert row.outlier_count == 1 and row.iqr == 20.0 and row.q1 == float(base)
    decimals = df.selectExpr("cast(v as decimal(38,2)) v")
    assert checks.iqr(decimals, "v", 1.5).first().outlier_count == 1
    small = spark.createDataFrame([(1,), (2,), (3,), (None,)], "v long")
    assert checks.zscore(small, "v", 3.0).first().mean == 2.0


def test_profile_patterns(spark):
    df = spark.createDataFrame([("a@b.de", "(212) 555-0123", "123", [1]), ("c@d.org", "+1 212 555 0124", "45", [2, 3])], "e string, p string, n string, l array<int>")
    got = {r.column_name: r.pattern_summary for r in profile.profile_table(df).collect()}
    assert got == {"e": "email", "p": "phone", "n": "numeric_string", "l": "list"}
    pairs = spark.createDataFrame([(float(k % 7), float(k), float(-k)) for k in range(200)], "a double, b double, c double")
    rows = {(r.column_a, r.column_b): r for r in profile.profile_correlations(pairs).collect()}
    frame = pairs.toPandas()
    for (a, b), r in rows.items():
        assert abs(r.pearson - frame[a].corr(frame[b])) < 1e-9
        assert abs(r.spearman - frame[a].rank(method="min").corr(frame[b].rank(method="min"))) < 1e-9
