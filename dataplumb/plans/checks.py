"""Queries of the checks, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import checks

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


# A tenth of the customers' names and nations are taken out, so that there is something to find.
_CUSTOMER = "(SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 97 = 0 THEN 'SPACESHIP' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer)"


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")).alias("c_name")
    segment = F.when(F.col("c_custkey") % 97 == 0, "SPACESHIP").otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    return table(spark, sf_dir, "customer").select("c_custkey", name, segment, "c_acctbal")


@query("SELECT CASE WHEN n < 10 OR n > 100000000 THEN 'fail' ELSE 'pass' END AS status, n AS row_count, 10::BIGINT AS min_threshold, 100000000::BIGINT AS max_threshold, 'Row count ' || n || ' is within acceptable range' AS message FROM (SELECT count(*) AS n FROM lineitem)")
def check_volume(spark, sf_dir):
    return checks.volume(table(spark, sf_dir, "lineitem"), 10, 100_000_000)


@query(f"SELECT 'fail' AS status, k AS null_count, n AS total_count, k / n AS null_rate, 0.05::DOUBLE AS threshold, 'Null rate ' || round(k / n, 3) || ' (' || k || '/' || n || ') exceeds maximum 0.05' AS message FROM (SELECT count(*) - count(c_name) AS k, count(*) AS n FROM {_CUSTOMER})")
def check_null_rate(spark, sf_dir):
    return checks.null_rate(_customer(spark, sf_dir), "c_name", 0.05)


@query("SELECT CASE WHEN n > 5000 THEN 'fail' ELSE 'pass' END AS status, n AS distinct_count, 1::BIGINT AS min_threshold, 5000::BIGINT AS max_threshold, 'Distinct count ' || n || CASE WHEN n > 5000 THEN ' exceeds maximum 5000' ELSE ' is within acceptable range' END AS message FROM (SELECT count(DISTINCT l_partkey) AS n FROM lineitem)")
def check_distinct_count(spark, sf_dir):
    return checks.distinct_count(table(spark, sf_dir, "lineitem"), "l_partkey", 1, 5000)


@query("SELECT 'fail' AS status, ['o_missing'] AS missing_columns, 'Table table is missing 1 column(s)' AS message")
def check_schema(spark, sf_dir):
    return checks.schema_check(table(spark, sf_dir, "orders"), ["O_ORDERKEY", "o_missing"])


@query("SELECT CASE WHEN m >= TIMESTAMP '2024-06-01' - INTERVAL 30 DAY THEN 'pass' ELSE 'fail' END AS status, m AS metric_value, TIMESTAMP '2024-06-01' - INTERVAL 30 DAY AS threshold, round(extract(epoch FROM TIMESTAMP '2024-06-01' - m))::BIGINT AS age_seconds, CASE WHEN m >= TIMESTAMP '2024-06-01' - INTERVAL 30 DAY THEN 'Data is fresh. ' ELSE 'Data is stale. ' END || 'Latest update: ' || m || ' (age: ' || round(extract(epoch FROM TIMESTAMP '2024-06-01' - m))::BIGINT || CASE WHEN m >= TIMESTAMP '2024-06-01' - INTERVAL 30 DAY THEN 's)' ELSE 's, max allowed: 2592000s)' END AS message FROM (SELECT max(ts) AS m FROM events)")
def check_freshness(spark, sf_dir):
    return checks.freshness(table(spark, sf_dir, "events"), "ts", dt.timedelta(days=30), dt.datetime(2024, 6, 1))


_PRICES = "(SELECT CASE WHEN l_orderkey % 500 = 0 THEN l_extendedprice * 100 ELSE l_extendedprice END AS v FROM lineitem)"


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.when(F.col("l_orderkey") % 500 == 0, F.col("l_extendedprice") * 100).otherwise(F.col("l_extendedprice")).alias("v"))


@query(f"WITH s AS (SELECT avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n FROM {_PRICES}), o AS (SELECT count(*) FILTER (abs((v - mean) / sd) > 3) AS k FROM {_PRICES}, s) SELECT CASE WHEN k > 0 THEN 'fail' ELSE 'pass' END AS status, round(mean, 4) AS mean, round(sd, 4) AS stddev, k AS outlier_count, n AS total_count, k / n AS outlier_rate, 3.0::DOUBLE AS threshold, k || ' outlier(s) detected (' || round(k / n * 100, 3) || '% of ' || n || ' rows)' AS message FROM s, o")
def check_zscore(spark, sf_dir):
    return checks.zscore(_prices(spark, sf_dir), "v", 3.0).withColumns({c: F.round(c, 4) for c in ("mean", "stddev")})


@query(f"WITH q AS (SELECT quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM {_PRICES}), b AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q), o AS (SELECT count(*) FILTER (v < lo OR v > hi) AS k, count(*) AS n FROM {_PRICES}, b) SELECT CASE WHEN k > 0 THEN 'fail' ELSE 'pass' END AS status, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, k AS outlier_count, n AS total_count, 1.5::DOUBLE AS multiplier, k || ' outlier(s) detected outside bounds [' || round(lo, 3) || ', ' || round(hi, 3) || ']' AS message FROM b, o")
def check_iqr(spark, sf_dir):
    return checks.iqr(_prices(spark, sf_dir), "v", 1.5).withColumns({c: F.round(c, 6) for c in ("q1", "q3", "iqr", "lower_bound", "upper_bound")})


@query(f"SELECT CASE WHEN r < 0.99 THEN 'fail' ELSE 'pass' END AS status, r AS match_rate, k AS matched_count, n AS total_count, 0.99::DOUBLE AS min_threshold, NULL::DOUBLE AS max_threshold, 'Match rate ' || round(r, 3) || ' (' || k || '/' || n || ')' || CASE WHEN r < 0.99 THEN ' is below minimum 0.99' ELSE ' is within acceptable range' END AS message FROM (SELECT count(*) FILTER (regexp_matches(c_mktsegment, '^[A-R]')) AS k, count(*) AS n, k / n AS r FROM {_CUSTOMER} WHERE c_mktsegment IS NOT NULL)")
def check_regex_match(spark, sf_dir):
    return checks.regex_match(_customer(spark, sf_dir), "c_mktsegment", "^[A-R]", 0.99)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(f"SELECT CASE WHEN r >= 1 THEN 'pass' ELSE 'fail' END AS status, r AS in_set_rate, k AS in_set_count, n AS total_count, 1.0::DOUBLE AS threshold, bad AS sample_violations, 'In-set rate ' || round(r, 3) || ' (' || k || '/' || n || ')' || CASE WHEN r >= 1 THEN ' is acceptable' ELSE ' is below minimum 1.0' END AS message FROM (SELECT count(*) FILTER (c_mktsegment IN {tuple(_SEGMENTS)}) AS k, count(*) AS n, k / n AS r, list_sort(coalesce(list(DISTINCT c_mktsegment) FILTER (c_mktsegment NOT IN {tuple(_SEGMENTS)}), [])) AS bad FROM {_CUSTOMER} WHERE c_mktsegment IS NOT NULL)")
def check_values_in_set(spark, sf_dir):
    return checks.values_in_set(_customer(spark, sf_dir), "c_mktsegment", _SEGMENTS)


def _aggregates(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    out = None
    for agg in checks.AGGREGATES:
        one = checks.agg_check(df, "l_quantity", agg, 0, 40).withColumn("value", F.round("value", 4))
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["check_agg"] = _aggregates
ORACLES["check_agg"] = " UNION ALL ".join(f"SELECT CASE WHEN v < 0 OR v > 40 THEN 'fail' ELSE 'pass' END AS status, '{a}' AS agg, round(v, 4) AS value, 0::DOUBLE AS lower_threshold, 40::DOUBLE AS upper_threshold, '{a} value ' || round(v, 3) || CASE WHEN v > 40 THEN ' exceeds maximum 40.0' ELSE ' is within acceptable range' END AS message FROM (SELECT {f}(l_quantity)::DOUBLE AS v FROM lineitem)" for a, f in (("avg", "avg"), ("min", "min"), ("max", "max"), ("sum", "sum"), ("median", "median"), ("stddev", "stddev_samp")))


@query("WITH k AS (SELECT l_orderkey, l_linenumber // 2 AS part, count(*) AS c FROM lineitem GROUP BY 1, 2), s AS (SELECT list(t ORDER BY t) AS t FROM (SELECT '(' || l_orderkey || ', ' || part || ')' AS t FROM k WHERE c > 1 ORDER BY 1 LIMIT 5)) SELECT CASE WHEN d > 5 THEN 'fail' ELSE 'pass' END AS status, d AS duplicate_count, n AS total_count, 5::BIGINT AS threshold, d || ' duplicate(s) in ' || n || ' rows exceeds maximum 5; samples: ''' || array_to_string(t, ''', ''') || '''' AS message FROM (SELECT sum(c - 1)::BIGINT AS d, sum(c)::BIGINT AS n FROM k), s")
def check_duplicate_count(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_linenumber") / 2).alias("part"))
    return checks.duplicate_count(df, "l_orderkey, part", 5)


@query("WITH k AS (SELECT l_suppkey::VARCHAR AS v, count(*) AS c FROM lineitem GROUP BY 1), b AS (SELECT max(c) AS o, count(*) AS d FROM k), x AS (SELECT min(v) AS v FROM k, b WHERE c = o) SELECT CASE WHEN o > 100 THEN 'fail' ELSE 'pass' END AS status, 'max' AS mode, o AS occurrence, v AS extreme_value, d AS distinct_values, 1::BIGINT AS lower_threshold, 100::BIGINT AS upper_threshold, 'max occurrence ' || o || ' (value: ' || v || ')' || CASE WHEN o > 100 THEN ' exceeds maximum 100' ELSE ' is within acceptable range' END AS message FROM b, x")
def check_occurrence(spark, sf_dir):
    return checks.occurrence(table(spark, sf_dir, "lineitem"), "l_suppkey", "max", 1, 100)


_BROKEN = "CASE WHEN l_orderkey % 50 = 0 THEN -l_orderkey WHEN l_orderkey % 77 = 0 THEN NULL ELSE l_orderkey END"


@query(f"WITH l AS (SELECT {_BROKEN} AS k FROM lineitem), m AS (SELECT k, k IN (SELECT o_orderkey FROM orders) AS hit FROM l), s AS (SELECT list(t ORDER BY t) AS t FROM (SELECT DISTINCT k::VARCHAR AS t FROM m WHERE NOT hit ORDER BY 1 LIMIT 5)) SELECT CASE WHEN r >= 0.99 THEN 'pass' ELSE 'fail' END AS status, r AS match_rate, a AS matched_count, n AS total_count, 0.99::DOUBLE AS threshold, 'Match rate ' || round(r, 3) || ' (' || a || '/' || n || ')' || CASE WHEN r >= 0.99 THEN ' is acceptable' ELSE ' is below minimum 0.99; samples: ''' || array_to_string(t, ''', ''') || '''' END || CASE WHEN z > 0 THEN '; ' || z || ' row(s) with a NULL key excluded' ELSE '' END AS message FROM (SELECT count(*) FILTER (hit) AS a, count(k) AS n, count(*) - count(k) AS z, a / n AS r FROM m), s")
def check_match_rate(spark, sf_dir):
    key = F.when(F.col("l_orderkey") % 50 == 0, -F.col("l_orderkey")).when(F.col("l_orderkey") % 77 == 0, None).otherwise(F.col("l_orderkey"))
    return checks.match_rate(table(spark, sf_dir, "lineitem").select(key.alias("k")), table(spark, sf_dir, "orders"), "k", "o_orderkey", 0.99)


@query("SELECT CASE WHEN r >= 0.9 THEN 'pass' ELSE 'fail' END AS status, r AS compliance_rate, k AS compliant_count, n AS total_count, 0.9::DOUBLE AS threshold, 'Compliance rate ' || round(r, 3) || ' (' || k || '/' || n || ')' || CASE WHEN r >= 0.9 THEN ' is acceptable' ELSE ' is below minimum 0.9' END AS message FROM (SELECT count(*) FILTER (l_discount <= 0.08 AND l_tax >= 0) AS k, count(*) AS n, k / n AS r FROM lineitem)")
def check_compliance(spark, sf_dir):
    return checks.compliance(table(spark, sf_dir, "lineitem"), "l_discount <= 0.08 AND l_tax >= 0", 0.9)


# Most of 20 January is taken out of the events.
_EVENTS = "(SELECT * FROM events WHERE NOT (ts::DATE = DATE '2024-01-20' AND event_id % 10 <> 0))"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("NOT (to_date(ts) = date '2024-01-20' AND event_id % 10 <> 0)")


_RANGE = {"start_date": "2024-01-10", "end_date": "2024-01-25"}
_REFS = "refs AS (SELECT unnest(generate_series(DATE '2024-01-10', DATE '2024-01-25', INTERVAL 1 DAY))::DATE AS rd)"
_REL = f"daily AS (SELECT ts::DATE AS d, count(*) AS c FROM {_EVENTS} GROUP BY 1), {_REFS}, w AS (SELECT rd, coalesce((SELECT c FROM daily WHERE d = rd), 0) AS n, (SELECT avg(c) FROM daily WHERE d < rd AND d >= rd - 7) AS b, (SELECT count(*) FROM daily WHERE d < rd AND d >= rd - 7) AS days FROM refs), r AS (SELECT *, (n - b) / b AS x FROM w)"


@query(f"WITH {_REL} SELECT CASE WHEN x < -0.5 OR x > 0.5 THEN 'fail' ELSE 'pass' END AS status, rd AS reference_date, n::DOUBLE AS reference_count, b AS baseline_avg, days AS baseline_days, round(x, 9) AS rel_change, -0.5::DOUBLE AS lower_threshold, 0.5::DOUBLE AS upper_threshold, 'Count ' || n || ' on ' || rd || CASE WHEN x < -0.5 OR x > 0.5 THEN ' deviates by ' || round(x, 3) || ' from baseline average ' ELSE ' is within ' || round(x, 3) || ' of baseline average ' END || round(b, 3) AS message FROM r")
def check_rel_count_change(spark, sf_dir):
    return checks.rel_count_change(_events(spark, sf_dir), "ts", **_RANGE).withColumn("rel_change", F.round("rel_change", 9))


@query(f"WITH {_REL} SELECT rd AS ds, 'rel_count_change' AS kind, 'Count ' || n || ' on ' || rd || ' deviates by ' || round(x, 3) || ' from baseline average ' || round(b, 3) AS label, 'alarm' AS severity, round(x, 9) AS value, CASE WHEN x < -0.5 THEN -0.5 ELSE 0.5 END::DOUBLE AS threshold, 'events' AS series FROM r WHERE x < -0.5 OR x > 0.5")
def events_rel_count_change(spark, sf_dir):
    return checks.rel_count_change_events(_events(spark, sf_dir), "ts", series="events", **_RANGE).withColumn("value", F.round("value", 9))


_IQR = f"daily AS (SELECT ts::DATE AS d, count(*)::DOUBLE AS m FROM {_EVENTS} GROUP BY 1), {_REFS}, w AS (SELECT rd, coalesce((SELECT m FROM daily WHERE d = rd), 0) AS m, (SELECT quantile_cont(m, 0.25) FROM daily WHERE d < rd AND d >= rd - 14) AS q1, (SELECT quantile_cont(m, 0.75) FROM daily WHERE d < rd AND d >= rd - 14) AS q3, (SELECT count(*) FROM daily WHERE d < rd AND d >= rd - 14) AS days FROM refs), r AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, m < q1 - 1.5 * (q3 - q1) OR m > q3 + 1.5 * (q3 - q1) AS bad FROM w)"


@query(f"WITH {_IQR} SELECT CASE WHEN bad THEN 'fail' ELSE 'pass' END AS status, rd AS reference_date, m AS metric_value, q1, q3, lo AS lower_bound, hi AS upper_bound, days AS baseline_days, 'both' AS mode, 'Metric ' || round(m, 3) || ' on ' || rd || CASE WHEN bad THEN ' is outside IQR bounds [' ELSE ' is within IQR bounds [' END || round(lo, 3) || ', ' || round(hi, 3) || ']' || CASE WHEN bad THEN ' (mode: both)' ELSE '' END AS message FROM r")
def check_metric_anomaly_iqr(spark, sf_dir):
    return checks.metric_anomaly_iqr(_events(spark, sf_dir), "ts", window_days=14, **_RANGE)


@query(f"WITH {_IQR} SELECT rd AS ds, 'metric_anomaly_iqr' AS kind, 'Metric ' || round(m, 3) || ' on ' || rd || ' is outside IQR bounds [' || round(lo, 3) || ', ' || round(hi, 3) || '] (mode: both)' AS label, 'alarm' AS severity, m AS value, CASE WHEN m < lo THEN lo ELSE hi END AS threshold, 'events' AS series FROM r WHERE bad")
def events_metric_anomaly_iqr(spark, sf_dir):
    return checks.metric_anomaly_iqr_events(_events(spark, sf_dir), "ts", window_days=14, series="events", **_RANGE)


_KINDS = ["click", "view", "purchase"]
_ROLL = f"{_REFS}, e AS (SELECT ts::DATE AS d, event_type AS v FROM events), r AS (SELECT rd, count(*) FILTER (v IN {tuple(_KINDS)}) AS k, count(*) AS n, list_sort(list(DISTINCT v) FILTER (v NOT IN {tuple(_KINDS)}))[1:5] AS bad FROM refs JOIN e ON d <= rd AND d > rd - 3 GROUP BY rd)"


@query(f"WITH {_ROLL} SELECT CASE WHEN k / n < 0.9 THEN 'fail' ELSE 'pass' END AS status, rd AS reference_date, k / n AS in_set_rate, k AS in_set_count, n AS total_count, 0.9::DOUBLE AS threshold, coalesce(bad, []) AS sample_violations, 'In-set rate ' || round(k / n, 3) || ' (' || k || '/' || n || ') over the trailing 3 day(s) is ' || CASE WHEN k / n < 0.9 THEN 'below minimum 0.9' ELSE 'acceptable' END AS message FROM r")
def check_rolling_values_in_set(spark, sf_dir):
    return checks.rolling_values_in_set(table(spark, sf_dir, "events"), "event_type", _KINDS, "ts", 3, 0.9, **_RANGE)


@query(f"WITH {_ROLL} SELECT rd AS ds, 'rolling_values_in_set' AS kind, 'In-set rate ' || round(k / n, 3) || ' (' || k || '/' || n || ') over the trailing 3 day(s) is below minimum 0.9' AS label, 'alarm' AS severity, k / n AS value, 0.9::DOUBLE AS threshold, 'events.event_type' AS series FROM r WHERE k / n < 0.9")
def events_rolling_values_in_set(spark, sf_dir):
    return checks.rolling_values_in_set_events(table(spark, sf_dir, "events"), "event_type", _KINDS, "ts", 3, 0.9, series="events.event_type", **_RANGE)
