"""Queries of suite, diffs and profiles, with their SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import diff, profile, suite
from .checks import _CUSTOMER, _customer, table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


_SUITE = [
    {"check_name": "a_rows", "check_type": "volume", "table_name": "dq_orders", "lower_threshold": 1},
    {"check_name": "b_price_null", "check_type": "null_rate", "table_name": "dq_orders", "column_name": "o_totalprice", "upper_threshold": 0.0},
    {"check_name": "c_status", "check_type": "values_in_set", "table_name": "dq_orders", "column_name": "o_orderstatus", "params": {"allowed_values": ["O", "F"]}, "lower_threshold": 0.99, "monitor_only": True},
    {"check_name": "d_price", "check_type": "agg", "table_name": "dq_orders", "column_name": "o_totalprice", "params": {"agg": "max"}, "upper_threshold": 100.0, "identifier_column": "o_orderpriority"},
    {"check_name": "e_broken", "check_type": "null_rate", "table_name": "dq_orders", "column_name": "no_such_column"},
]
_SUITE_SQL = """
WITH v AS (
  SELECT 'a_rows' AS check_name, 'volume' AS check_type, NULL AS column_name, NULL AS identifier, count(*)::DOUBLE AS value, 1.0 AS lower_threshold, NULL::DOUBLE AS upper_threshold FROM orders
  UNION ALL SELECT 'b_price_null', 'null_rate', 'o_totalprice', NULL, (count(*) - count(o_totalprice)) / count(*), NULL, 0.0 FROM orders
  UNION ALL SELECT 'c_status', 'values_in_set', 'o_orderstatus', NULL, count(*) FILTER (o_orderstatus IN ('O', 'F')) / count(o_orderstatus), 0.99, NULL FROM orders
  UNION ALL SELECT 'd_price', 'agg', 'o_totalprice', o_orderpriority, max(o_totalprice), NULL, 100.0 FROM orders GROUP BY o_orderpriority),
t AS (SELECT *, round(value, 3)::VARCHAR AS shown FROM v)
SELECT check_name, check_type, 'dq_orders' AS table_name, column_name, identifier, value, lower_threshold::DOUBLE AS lower_threshold, upper_threshold,
  CASE WHEN value < lower_threshold OR value > upper_threshold THEN CASE WHEN check_name = 'c_status' THEN 'warn' ELSE 'fail' END ELSE 'pass' END AS status,
  check_type || ' value ' || shown || CASE WHEN value < lower_threshold THEN ' violates thresholds (' || shown || ' < lower ' || lower_threshold || '); samples: ''P''' WHEN value > upper_threshold THEN ' violates thresholds (' || shown || ' > upper ' || upper_threshold || ')' ELSE ' is within thresholds' END AS message FROM t
UNION ALL SELECT 'e_broken', 'null_rate', 'dq_orders', 'no_such_column', NULL, NULL, NULL, NULL, 'error', 'check ''e_broken'' (null_rate) cannot run: column ''no_such_column'' not found; available columns: ' || (SELECT string_agg(column_name, ', ') FROM (DESCRIBE orders))
"""


@query(_SUITE_SQL)
def suite_orders(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("dq_orders")
    return suite.run_checks(suite.define_checks(_SUITE), dt.datetime(2024, 1, 1)).drop("run_ts")


_MESSAGES = [
    {"check_name": "compliant", "check_type": "compliance", "table_name": "dq_texts", "params": {"expression": "CAST(amount AS DOUBLE) > 100000 AND note IS NOT NULL"}, "lower_threshold": 0.9},
    {"check_name": "dates", "check_type": "rel_count_change", "table_name": "dq_texts", "params": {"date_column": "day", "reference_date": "1998-01-05", "window_days": 10}},
    {"check_name": "duplicates", "check_type": "duplicate_count", "table_name": "dq_texts", "column_name": "priority", "upper_threshold": 0.0, "filter_expr": "k % 3 = 0"},
    {"check_name": "empty", "check_type": "volume", "table_name": "dq_texts", "params": {"fail_on_empty": True}, "filter_expr": "k < 0"},
    {"check_name": "fresh", "check_type": "freshness", "table_name": "dq_texts", "column_name": "day", "params": {"reference_time": "2010-01-01 00:00:00"}, "upper_threshold": 60.0},
    {"check_name": "largest", "check_type": "agg", "table_name": "dq_texts", "column_name": "k", "params": {"agg": "max"}, "upper_threshold": 10.5},
    {"check_name": "match", "check_type": "match_rate", "table_name": "dq_texts", "column_name": "customer", "params": {"right_table": "dq_customers", "right_keys": "c_custkey"}, "lower_threshold": 1.0},
    {"check_name": "members", "check_type": "values_in_set", "table_name": "dq_texts", "column_name": "priority", "params": {"allowed_values": ["1-URGENT", "2-HIGH"]}, "lower_threshold": 1.0},
    {"check_name": "odd", "check_type": "agg", "table_name": "dq_texts", "column_name": "price", "params": {"agg": "avg"}, "lower_threshold": 1.0},
    {"check_name": "parts", "check_type": "null_rate", "table_name": "dq_texts", "column_name": "note", "identifier_column": "status", "filter_expr": "status <> 'P'"},
    {"check_name": "schema", "check_type": "schema_check", "table_name": "dq_texts", "params": {"columns": "k,more,price,less"}},
]
_TEXTS = """(SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN 'n/a' ELSE round(o_totalprice)::BIGINT::VARCHAR END AS amount, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderpriority END AS note, o_orderpriority AS priority, o_orderstatus AS status,
  CASE WHEN o_orderkey % 20 <> 0 THEN o_custkey + 100 END AS customer, CASE WHEN o_orderkey % 90 = 0 THEN 'soon' ELSE substr(o_orderdate::VARCHAR, 1, 10) END AS day, CASE WHEN o_orderkey % 400 = 0 THEN 'nan'::DOUBLE ELSE o_totalprice END AS price FROM orders)"""


@query(f"""
WITH t AS {_TEXTS},
good AS (SELECT k, amount, note, try_cast(amount AS DOUBLE) AS a FROM t),
compliant AS (SELECT count(*) FILTER (a > 100000 AND note IS NOT NULL)::DOUBLE / count(*) AS v, count(*) FILTER (a IS NULL AND note IS NOT NULL) AS bad FROM good),
daily AS (SELECT try_cast(day AS DATE) AS d, count(*) AS c FROM t WHERE try_cast(day AS DATE) IS NOT NULL GROUP BY 1),
base AS (SELECT avg(c) AS b FROM daily WHERE d < DATE '1998-01-05' AND d >= DATE '1997-12-26'),
change AS (SELECT (coalesce((SELECT c FROM daily WHERE d = DATE '1998-01-05'), 0) - b) / b AS v FROM base),
skipped AS (SELECT count(*) AS n FROM t WHERE day = 'soon'),
age AS (SELECT epoch(TIMESTAMP '2010-01-01' - max(try_cast(day AS TIMESTAMP)))::DOUBLE AS v FROM t),
matched AS (SELECT count(*) FILTER (customer IN (SELECT c_custkey FROM customer))::DOUBLE / count(customer) AS v, count(*) - count(customer) AS nulls FROM t),
missing AS (SELECT string_agg('''' || x || '''', ', ' ORDER BY x) AS s FROM (SELECT DISTINCT customer::VARCHAR AS x FROM t WHERE customer NOT IN (SELECT c_custkey FROM customer) ORDER BY x LIMIT 5)),
inside AS (SELECT count(*) FILTER (priority IN ('1-URGENT', '2-HIGH'))::DOUBLE / count(priority) AS v FROM t),
others AS (SELECT string_agg('''' || x || '''', ', ' ORDER BY x) AS s FROM (SELECT DISTINCT priority AS x FROM t WHERE priority NOT IN ('1-URGENT', '2-HIGH') ORDER BY x LIMIT 5)),
twice AS (SELECT (count(*) - count(DISTINCT priority))::DOUBLE AS v, count(*) AS kept, (SELECT count(*) FROM t) AS total FROM t WHERE k % 3 = 0),
keys AS (SELECT string_agg('''' || x || '''', ', ' ORDER BY x) AS s FROM (SELECT priority AS x FROM t WHERE k % 3 = 0 GROUP BY priority HAVING count(*) > 1 ORDER BY x LIMIT 5)),
parts AS (SELECT status, (count(*) - count(note))::DOUBLE / count(*) AS v, count(*) AS n FROM t WHERE status <> 'P' GROUP BY status),
largest AS (SELECT max(k) AS v FROM t),
odd AS (SELECT count(*) AS n FROM t WHERE isnan(price))
SELECT 'compliant' AS check_name, NULL AS identifier, v AS value, NULL::DOUBLE AS upper_threshold, CASE WHEN v < 0.9 THEN 'fail' ELSE 'pass' END AS status,
  'compliance value ' || round(v, 3) || CASE WHEN v < 0.9 THEN ' violates thresholds (' || round(v, 3) || ' < lower 0.9)' ELSE ' is within thresholds' END || '; ' || bad || ' row(s) could not be evaluated (counted as non-compliant)' AS message FROM compliant
UNION ALL SELECT 'dates', NULL, v, NULL, 'pass', CASE WHEN v IS NULL THEN 'No value to evaluate; check passed trivially' ELSE 'rel_count_change value ' || round(v, 3) || ': no thresholds configured (monitor)' END || '; ' || n || ' row(s) skipped (day is not a date)' FROM change, skipped
UNION ALL SELECT 'duplicates', NULL, v, 0.0, 'fail', 'duplicate_count value ' || v || ' violates thresholds (' || v || ' > upper 0.0); samples: ' || s || '; filter matched ' || kept || '/' || total || ' rows' FROM twice, keys
UNION ALL SELECT 'empty', NULL, NULL, NULL, 'fail', 'No rows to evaluate: filter matched 0/' || (SELECT count(*) FROM t) || ' rows (fail_on_empty)'
UNION ALL SELECT 'fresh', NULL, v, 60.0, 'fail', 'freshness value ' || v || ' seconds violates thresholds (' || v || ' seconds > upper 60.0 seconds); ' || n || ' row(s) skipped (day is not a timestamp)' FROM age, skipped
UNION ALL SELECT 'largest', NULL, v::DOUBLE, 10.5, 'fail', 'agg value ' || v || ' violates thresholds (' || v || ' > upper 10.5)' FROM largest
UNION ALL SELECT 'match', NULL, v, NULL, CASE WHEN v < 1 THEN 'fail' ELSE 'pass' END, 'match_rate value ' || round(v, 3) || ' violates thresholds (' || round(v, 3) || ' < lower 1.0); samples: ' || s || '; ' || nulls || ' row(s) with a NULL key excluded' FROM matched, missing
UNION ALL SELECT 'members', NULL, v, NULL, 'fail', 'values_in_set value ' || round(v, 3) || ' violates thresholds (' || round(v, 3) || ' < lower 1.0); samples: ' || s FROM inside, others
UNION ALL SELECT 'odd', NULL, 'nan'::DOUBLE, NULL, 'fail', 'agg value is NaN: the column contains ' || n || ' NaN/Inf value(s)' FROM odd
UNION ALL SELECT 'parts', status, v, NULL, 'pass', 'null_rate value ' || round(v, 3) || ': no thresholds configured (monitor); filter matched ' || n || '/' || n || ' rows' FROM parts
UNION ALL SELECT 'schema', NULL, 2.0, 0.0, 'fail', 'schema_check value 2.0 violates thresholds (2.0 > upper 0.0); missing columns: ''more'', ''less'''
""")
def suite_messages(spark, sf_dir):
    """What messages tell: rows that couldn't be evaluated, samples, skipped dates, null keys, filters, missing columns."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    texts = table(spark, sf_dir, "orders").select(
        k.alias("k"), F.when(k % 50 == 0, "n/a").otherwise(F.round(price).cast("long").cast("string")).alias("amount"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("note"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"),
        F.when(k % 20 != 0, F.col("o_custkey") + 100).alias("customer"), F.when(k % 90 == 0, "soon").otherwise(F.substring(F.col("o_orderdate").cast("string"), 1, 10)).alias("day"), F.when(k % 400 == 0, float("nan")).otherwise(price).alias("price"),
    )
    table(spark, sf_dir, "customer").createOrReplaceTempView("dq_customers")
    return suite.run_checks(suite.define_checks(_MESSAGES), dt.datetime(2024, 1, 1), {"dq_texts": texts}).select("check_name", "identifier", "value", "upper_threshold", "status", "message")


_NEW = "(SELECT CASE WHEN o_orderkey % 40 = 0 THEN o_orderkey + 100000000 ELSE o_orderkey END AS o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 WHEN o_orderkey % 7 = 1 THEN o_totalprice + 0.001 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus FROM orders)"


def _changed(spark, sf_dir):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.when(k % 40 == 0, k + 100_000_000).otherwise(k).alias("o_orderkey"), "o_custkey", F.when(k % 7 == 0, p + 1).when(k % 7 == 1, p + 0.001).otherwise(p).alias("o_totalprice"), F.when(k % 11 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    )


_DIFF = """
WITH d AS (SELECT CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS diff_type, coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_custkey, b.o_totalprice, b.o_orderstatus,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN []::VARCHAR[] ELSE list_filter([CASE WHEN {price} THEN 'o_totalprice' END, CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END], lambda x: x IS NOT NULL) END AS changed_columns
  FROM orders a FULL JOIN {new} b ON a.o_orderkey = b.o_orderkey)
SELECT * FROM d WHERE diff_type <> 'changed' OR len(changed_columns) > 0
"""


@query(_DIFF.format(price="abs(a.o_totalprice - b.o_totalprice) > 0.01", new=_NEW))
def diff_join(spark, sf_dir):
    return diff.joindiff(table(spark, sf_dir, "orders"), _changed(spark, sf_dir), "o_orderkey", float_tolerance=0.01)


@query(_DIFF.format(price="a.o_totalprice IS DISTINCT FROM b.o_totalprice", new=_NEW))
def diff_hash(spark, sf_dir):
    return diff.hashdiff(table(spark, sf_dir, "orders"), _changed(spark, sf_dir), ["o_orderkey"])


@query("SELECT * FROM (VALUES ('o_orderkey', 'bigint', 'bigint', 'same'), ('o_custkey', 'bigint', 'string', 'retyped'), ('o_orderstatus', 'string', 'string', 'same'), ('o_totalprice', 'double', NULL, 'removed'), ('note', NULL, 'string', 'added')) AS t(column_name, source_type, target_type, drift)")
def diff_schemas(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return diff.schema_diff(df.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), df.select("o_orderkey", F.col("o_custkey").cast("string"), "o_orderstatus", F.lit("x").alias("note")))


def _numeric(name: str) -> str:
    return f"""SELECT '{name}' AS column_name, count(*) AS row_count, count(*) - count({name}) AS null_count, count(DISTINCT {name}) AS distinct_count, round(avg({name}), 6) AS mean, round(quantile_cont({name}, 0.5), 6) AS median, round(stddev_samp({name}), 6) AS stddev, round(quantile_cont({name}, 0.25), 6) AS p25, round(quantile_cont({name}, 0.75), 6) AS p75, round(skewness({name}), 6) AS skewness, round(kurtosis({name}), 6) AS kurtosis, count(*) FILTER ({name} = 0) AS zero_count, count(*) FILTER ({name} < 0) AS negative_count, NULL::DOUBLE AS avg_length, NULL::BIGINT AS max_length, NULL::VARCHAR AS pattern_summary, count(DISTINCT {name}) = count({name}) AS is_unique FROM {_CUSTOMER}"""


@query(_numeric("c_acctbal") + f" UNION ALL SELECT 'c_name', count(*), count(*) - count(c_name), count(DISTINCT c_name), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, round(avg(length(c_name)), 6), max(length(c_name)), 'mixed', true FROM {_CUSTOMER}")
def profile_columns(spark, sf_dir):
    out = profile.profile_table(_customer(spark, sf_dir), ["c_acctbal", "c_name"], exact=True)
    rounded = {c: F.round(c, 6) for c in ("mean", "median", "stddev", "p25", "p75", "skewness", "kurtosis", "avg_length")}
    return out.withColumns(rounded).select("column_name", "row_count", "null_count", "distinct_count", *rounded, "zero_count", "negative_count", "max_length", "pattern_summary", "is_unique")


@query("WITH g AS (SELECT l_returnflag, l_linestatus, l_discount, count(*) AS c FROM lineitem GROUP BY ALL) SELECT sum(c)::BIGINT AS row_count, 3::BIGINT AS column_count, 1::BIGINT AS numeric_columns, 2::BIGINT AS string_columns, 0::BIGINT AS temporal_columns, 0::BIGINT AS boolean_columns, 0::BIGINT AS complex_columns, 0::BIGINT AS other_columns, 0::BIGINT AS total_nulls, 0.0::DOUBLE AS total_null_rate, sum(c - 1)::BIGINT AS duplicate_row_count, (sum(c) * 24)::BIGINT AS estimated_memory_bytes FROM g")
def profile_overview(spark, sf_dir):
    return profile.profile_summary(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_discount"))


_PAIR = "SELECT '{a}' AS column_a, '{b}' AS column_b, round(corr({a}, {b}), 6) AS pearson, round((SELECT corr(ra, rb) FROM (SELECT rank() OVER (ORDER BY {a}) AS ra, rank() OVER (ORDER BY {b}) AS rb FROM lineitem)), 6) AS spearman, count(*) AS n FROM lineitem"


@query(" UNION ALL ".join(_PAIR.format(a=a, b=b) for a, b in (("l_quantity", "l_extendedprice"), ("l_quantity", "l_tax"), ("l_extendedprice", "l_tax"))))
def profile_pairs(spark, sf_dir):
    out = profile.profile_correlations(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return out.withColumns({c: F.round(c, 6) for c in ("pearson", "spearman")})
