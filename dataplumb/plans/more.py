"""Queries over values built from the tables, whose results SQL can tell: clusters, forests, scalars, personal data, addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from .._tables import spread
from ..functions import money, phone, pii, postal, validators, vat
from ..operators import anomaly
from ..operators.outlier_tree import outlier_tree
from .checks import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_acctbal / 1000 AS x, (s_suppkey % 50) / 10 AS y, s_nationkey / 10 AS z FROM supplier),
near AS (SELECT a.k, b.k AS q FROM p a JOIN p b ON sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 1.0),
n AS (SELECT k, count(*) - 1 AS nb FROM near GROUP BY k),
core AS (SELECT k FROM n WHERE nb + 1 >= 4),
edge AS (SELECT near.k, q FROM near JOIN core ON near.k = core.k JOIN core c ON near.q = c.k),
reach AS (SELECT k, k AS q FROM core UNION SELECT reach.k, edge.q FROM reach JOIN edge ON reach.q = edge.k),
low AS (SELECT k, min(q) AS c FROM reach GROUP BY k),
named AS (SELECT k, dense_rank() OVER (ORDER BY c) - 1 AS cluster FROM low),
border AS (SELECT near.k, min(cluster) AS cluster FROM near JOIN named ON near.q = named.k WHERE near.k NOT IN (SELECT k FROM core) GROUP BY near.k),
every AS (SELECT p.k, n.nb, coalesce(named.cluster, border.cluster, -1) AS cluster, CASE WHEN named.k IS NOT NULL THEN 'CORE' WHEN border.k IS NOT NULL THEN 'BORDER' ELSE 'NOISE' END AS kind FROM p JOIN n USING (k) LEFT JOIN named USING (k) LEFT JOIN border USING (k)),
most AS (SELECT max(nb)::DOUBLE AS m FROM every)
SELECT k AS s_suppkey, cluster::INT AS cluster_id, kind AS point_type, nb AS neighbor_count,
  round(CASE kind WHEN 'NOISE' THEN 1.0 WHEN 'CORE' THEN 0.1 + 0.2 * (1 - nb / m) ELSE 0.3 + 0.3 * (1 - nb / m) END, 6) AS anomaly_score, kind = 'NOISE' AS is_anomaly FROM every, most
""")
def anomaly_dbscan_mv(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 50 / 10).alias("y"), (F.col("s_nationkey") / 10).alias("z"))
    out = anomaly.dbscan_mv(df, "x,y,z", 1.0, 4, "clusters", id_column="s_suppkey").drop("row_id").withColumnRenamed("id", "s_suppkey")
    return out.withColumn("anomaly_score", F.round("anomaly_score", 6))


@query("""
WITH o AS (SELECT CASE WHEN o_orderkey % 1000 = 0 THEN 1 ELSE 0 END AS planted FROM orders)
SELECT count(*) AS total_rows, sum(planted)::BIGINT AS planted, sum(planted)::BIGINT AS planted_found, true AS within_share FROM o
""")
def anomaly_forest_planted(spark, sf_dir):
    """All planted values are found, and no more rows are flagged than contamination allows."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 1000 == 0, F.col("o_totalprice") * 50 + 1e7).otherwise(F.col("o_totalprice")).alias("p"))
    planted = F.col("id") % 1000 == 0
    out = anomaly.isolation_forest(df, "p", 50, 256, 0.01, "scores", 42, "o_orderkey")
    return out.agg(F.count("*").alias("total_rows"), F.count(F.when(planted, 1)).alias("planted"), F.count(F.when(planted & F.col("is_anomaly"), 1)).alias("planted_found"), (F.count(F.when(F.col("is_anomaly"), 1)) <= 0.01 * F.count("*") + 1).alias("within_share"))


@query("SELECT l_linenumber_count AS total_rows, true AS within_share FROM (SELECT count(*) AS l_linenumber_count FROM lineitem)")
def anomaly_forest_ties(spark, sf_dir):
    """A column of few values: ties at the cut aren't flagged, so that no more than a tenth is."""
    out = anomaly.isolation_forest(table(spark, sf_dir, "lineitem"), "l_quantity", 50, 256, 0.1, "summary", 7)
    return out.select(F.col("total_count").alias("total_rows"), (F.col("outlier_count") <= 0.1 * F.col("total_count")).alias("within_share"))


@query("""
WITH c AS (SELECT c_custkey AS k, round(c_acctbal, 2)::DECIMAL(18,3) AS a FROM customer)
SELECT k AS c_custkey, (a - 1.5)::DECIMAL(18,3) AS less, a > 0 AS positive, a = 0 AS zero, true AS same, k % 2 = 0 AS known,
  CASE k % 2 WHEN 0 THEN '€' END AS symbol, CASE k % 2 WHEN 0 THEN 'Euro' END AS name, (a * 2)::DECIMAL(18,3) AS twice,
  (CASE WHEN a < 0 THEN '-' ELSE '' END) || replace(replace(replace(format('{:,.2f}', abs(a)::DOUBLE), ',', '#'), '.', ','), '#', '.') || ' EUR' AS shown FROM c
""")
def scalar_money_more(spark, sf_dir):
    m = money.money(F.round("c_acctbal", 2), "EUR")
    code = F.when(F.col("c_custkey") % 2 == 0, "eur").otherwise("xxx")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", money.money_subtract(m, money.money(F.lit(1.5), "EUR"))["amount"].alias("less"), money.money_is_positive(m).alias("positive"), money.money_is_zero(m).alias("zero"), money.money_same_currency(m, m).alias("same"), money.is_valid_currency(code).alias("known"),
        money.currency_symbol(code).alias("symbol"), money.currency_name(code).alias("name"), money.money_multiply(m, F.lit(2.0))["amount"].alias("twice"), money.money_format(m, "code").alias("shown"),
    )


@query("""
WITH s AS (SELECT s_suppkey AS k, lpad((s_suppkey * 7919 % 100000000)::BIGINT::VARCHAR, 8, '0') AS d, CASE s_suppkey % 3 WHEN 0 THEN 'DK' WHEN 1 THEN 'LU' ELSE 'US' END AS c FROM supplier)
SELECT k AS s_suppkey, c || d AS plain, CASE WHEN c <> 'US' THEN c END AS country, CASE WHEN c <> 'US' THEN d END AS digits, c <> 'US' AS syntax, c <> 'US' AS known, c <> 'US' AS eu,
  CASE c WHEN 'DK' THEN 'Denmark' WHEN 'LU' THEN 'Luxembourg' END AS name FROM s
""")
def scalar_vat_more(spark, sf_dir):
    country = F.when(F.col("s_suppkey") % 3 == 0, "DK").when(F.col("s_suppkey") % 3 == 1, "LU").otherwise("US")
    v = F.concat(F.lower(country), F.lit(" "), F.lpad((F.col("s_suppkey") * 7919 % 100_000_000).cast("string"), 8, "0"), F.lit("."))
    parts = vat.vat_split(v)
    return table(spark, sf_dir, "supplier").select("s_suppkey", vat.vat_normalize(v).alias("plain"), parts["country"].alias("country"), parts["digits"].alias("digits"), F.coalesce(vat.vat_is_valid_syntax(v), F.lit(False)).alias("syntax"), vat.is_valid_vat_country(country).alias("known"), vat.vat_is_eu_member(country).alias("eu"), vat.vat_country_name(country).alias("name"))


@query("""
WITH c AS (SELECT c_custkey AS k, lpad((c_custkey % 1000)::VARCHAR, 3, '0') AS area, lpad((c_custkey * 7919 % 1000000)::BIGINT::VARCHAR, 6, '0') AS d FROM customer)
SELECT k AS c_custkey, area NOT IN ('000', '666') AND area < '900' AND substr(d, 1, 2) <> '00' AND lpad(substr(d, 3), 4, '0') <> '0000' AS ssn,
  k % 2 = 0 AS nino, k % 3 <> 0 AS mail FROM c
""")
def scalar_identifiers(spark, sf_dir):
    k = F.col("c_custkey")
    d = F.lpad((k * 7919 % 1_000_000).cast("string"), 6, "0")
    ssn = F.concat_ws("-", F.lpad((k % 1000).cast("string"), 3, "0"), F.substring(d, 1, 2), F.substring(d, 3, 4))
    nino = F.concat(F.when(k % 2 == 0, "AB").otherwise("GB"), d, F.lit("c"))
    mail = F.concat(F.when(k % 3 == 0, "a b").otherwise("a.b"), F.lit("@"), d, F.lit(".example.org"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", validators.is_valid_ssn(ssn).alias("ssn"), validators.is_valid_nino(nino).alias("nino"), validators.email_is_valid(mail).alias("mail"))


@query("""
WITH c AS (SELECT c_custkey AS k, lpad((100000 + c_custkey * 31 % 900000)::BIGINT::VARCHAR, 6, '0') AS d FROM customer)
SELECT k AS c_custkey, '+4930' || d AS e164, 'DE' AS region, true AS valid, true AS possible, true AS for_region, 'NSN_MATCH' AS matched, 49 AS country_code, '30' || d AS national, 'FIXED_LINE' AS kind FROM c
""")
def scalar_phone(spark, sf_dir):
    d = F.lpad((100_000 + F.col("c_custkey") * 31 % 900_000).cast("string"), 6, "0")
    local, abroad = F.concat(F.lit("030 "), d), F.concat(F.lit("+49 30 "), d)
    parsed = phone.phonenumber_parse(local, "DE")
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        "c_custkey", phone.phonenumber_format(local, "DE", "E164").alias("e164"), phone.phonenumber_region(local, "DE").alias("region"), phone.phonenumber_is_valid(local, "DE").alias("valid"), phone.phonenumber_is_possible(local, "DE").alias("possible"), phone.phonenumber_is_valid_for_region(abroad, "DE").alias("for_region"),
        phone.phonenumber_match(local, abroad, "DE").alias("matched"), parsed["country_code"].alias("country_code"), parsed["national_number"].alias("national"), parsed["type"].alias("kind"),
    )


def _notes(spark, sf_dir):
    """A note for each customer, dealt over tasks: an address of its own, an IP address, and for every third one a birth date."""
    k = F.col("c_custkey").cast("string")
    note = F.concat(F.lit("mail c"), k, F.lit("@example.org, from 10.0."), (F.col("c_custkey") % 256).cast("string"), F.lit(".7"), F.when(F.col("c_custkey") % 3 == 0, ", born 1980-02-03").otherwise(""))
    return spread(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")).select("c_custkey", note.alias("note"), "c_acctbal")


_NOTES = "WITH c AS (SELECT c_custkey AS k, 'c' || c_custkey || '@example.org' AS mail, '10.0.' || (c_custkey % 256) || '.7' AS ip FROM customer)"


@query(_NOTES + """,
m AS (SELECT k, 'EMAIL' AS t, mail AS x, 5 AS a FROM c UNION ALL SELECT k, 'IP_ADDRESS', ip, 5 + length(mail) + 7 FROM c UNION ALL SELECT k, 'DATE_OF_BIRTH', '1980-02-03', 5 + length(mail) + 7 + length(ip) + 7 FROM c WHERE k % 3 = 0)
SELECT k AS c_custkey, t AS pii_type, x AS matched_text, a::INT AS start_pos, (a + length(x))::INT AS end_pos, 1.0::DOUBLE AS confidence FROM m
""")
def pii_found(spark, sf_dir):
    return _notes(spark, sf_dir).select("c_custkey", F.explode(pii.pii_detect(F.col("note"))).alias("m")).select("c_custkey", F.col("m.type").alias("pii_type"), F.col("m.text").alias("matched_text"), F.col("m.start_pos").alias("start_pos"), F.col("m.end_pos").alias("end_pos"), F.col("m.confidence").alias("confidence"))


@query(_NOTES + """
SELECT k AS c_custkey, 'mail [EMAIL], from [IP_ADDRESS]' || CASE WHEN k % 3 = 0 THEN ', born [DATE_OF_BIRTH]' ELSE '' END AS redacted,
  'mail ' || substr(sha256(mail), 1, 16) || ', from ' || ip || CASE WHEN k % 3 = 0 THEN ', born 1980-02-03' ELSE '' END AS hashed,
  2 + (k % 3 = 0)::INT::BIGINT AS n, true AS any_found, 1 AS mails FROM c
""")
def pii_strategies(spark, sf_dir):
    note = F.col("note")
    return _notes(spark, sf_dir).select("c_custkey", pii.pii_mask(note).alias("redacted"), pii.pii_mask_column(note, "EMAIL", "hash").alias("hashed"), pii.pii_count(note).alias("n"), pii.pii_contains(note).alias("any_found"), F.size(pii.pii_detect_emails(note)).alias("mails"))


@query(_NOTES + """,
v AS (SELECT 'EMAIL' AS t, mail AS x FROM c UNION ALL SELECT 'IP_ADDRESS', ip FROM c UNION ALL SELECT 'DATE_OF_BIRTH', '1980-02-03' FROM c WHERE k % 3 = 0),
d AS (SELECT t, x, row_number() OVER (PARTITION BY t ORDER BY x) AS nth FROM (SELECT DISTINCT t, x FROM v))
SELECT 'note' AS column_name, t AS pii_type, count(*) AS match_count, (SELECT string_agg(x, '|' ORDER BY x) FROM d WHERE d.t = v.t AND nth <= 5) AS samples, 1.0::DOUBLE AS confidence, (SELECT count(*) FROM c) AS values_scanned, 'found' AS status FROM v GROUP BY t
UNION ALL SELECT 'c_acctbal', NULL, 0, '', NULL, 0, 'skipped (double)'
""")
def pii_scan_notes(spark, sf_dir):
    return pii.pii_scan_table(_notes(spark, sf_dir).drop("c_custkey")).select("column_name", "pii_type", "match_count", F.array_join("sample_values", "|").alias("samples"), "confidence", "values_scanned", "status")


@query(_NOTES + """,
n AS (SELECT *, 'mail ' || mail || ', from ' || ip || CASE WHEN k % 3 = 0 THEN ', born 1980-02-03' ELSE '' END AS note, 'mail [EMAIL], from [IP_ADDRESS]' || CASE WHEN k % 3 = 0 THEN ', born [DATE_OF_BIRTH]' ELSE '' END AS masked FROM c),
m AS (SELECT *, 'EMAIL' AS t, mail AS x FROM n UNION ALL SELECT *, 'IP_ADDRESS', ip FROM n UNION ALL SELECT *, 'DATE_OF_BIRTH', '1980-02-03' FROM n WHERE k % 3 = 0)
SELECT k AS c_custkey, 'note' AS column_name, t AS pii_type, note AS original_value, masked AS masked_value, x AS matched_text, (strpos(note, x) - 1)::INT AS start_pos, (strpos(note, x) - 1 + length(x))::INT AS end_pos FROM m
""")
def pii_audit_notes(spark, sf_dir):
    return pii.pii_audit_table(_notes(spark, sf_dir), "note", id_column="c_custkey").select(F.col("id").alias("c_custkey"), "column_name", "pii_type", "original_value", "masked_value", "matched_text", "start_pos", "end_pos")


@query("""
SELECT s_suppkey, s_suppkey::VARCHAR AS house_number, 'mill road' AS road, 'kiel' AS city, lpad((10000 + s_suppkey % 90000)::VARCHAR, 5, '0') AS postcode, 'germany' AS country,
  s_suppkey || ' mill road ' || (10000 + s_suppkey % 90000) || ' kiel germany' AS expanded FROM supplier
""")
def postal_built(spark, sf_dir):
    code = (10_000 + F.col("s_suppkey") % 90_000).cast("string")
    k = F.col("s_suppkey").cast("string")
    p = postal.postal_parse_address(F.concat(k, F.lit(" Mill Road, "), code, F.lit(" Kiel, Germany")))
    e = postal.postal_expand_address(F.concat(k, F.lit(" Mill Rd, "), code, F.lit(" Kiel, Germany")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", p["house_number"].alias("house_number"), p["road"].alias("road"), p["city"].alias("city"), p["postcode"].alias("postcode"), p["country"].alias("country"), F.get(e, F.lit(0)).alias("expanded"))


@query("""
WITH c AS (SELECT c_custkey AS k, 'shop' AS seg, CASE WHEN c_custkey % 1000 = 0 THEN 999.99 WHEN c_custkey % 7 = 0 THEN 1.2 ELSE 1.1 END::DOUBLE AS v FROM customer),
m AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, 1.1::DOUBLE AS median FROM c),
d AS (SELECT avg(abs(v - 1.1)) * sqrt(pi() / 2) AS mad FROM c)
SELECT k AS c_custkey, 'v' AS column_name, '999.99' AS outlier_value, v AS outlier_value_num, round(mean, 6) AS cluster_mean, round(sd, 6) AS cluster_sd, median AS cluster_median, round(mad, 6) AS cluster_mad, n AS cluster_size,
  round((v - median) / mad, 6) AS z_score, round(median - 2.67 * mad, 6) AS lower_bound, round(median + 2.67 * mad, 6) AS upper_bound, '[]' AS conditions, true AS told, round(power(mad / (v - median), 2), 9) AS outlier_score
FROM c, m, d WHERE v > 900
""")
def anomaly_outlier_tree(spark, sf_dir):
    v = F.when(F.col("c_custkey") % 1000 == 0, 999.99).when(F.col("c_custkey") % 7 == 0, 1.2).otherwise(1.1)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.lit("shop").alias("seg"), v.alias("v"))
    out = outlier_tree(df, "seg, v", "outliers", id_column="c_custkey").drop("row_id").withColumnRenamed("id", "c_custkey")
    for c in ("cluster_mean", "cluster_sd", "cluster_mad", "z_score", "lower_bound", "upper_bound"):
        out = out.withColumn(c, F.round(c, 6))
    told = F.col("explanation").startswith("Value 999.99 for column 'v' is unusually high (median: 1.10, MAD: ")
    return out.withColumn("outlier_score", F.round("outlier_score", 9)).withColumn("told", told).drop("explanation")


@query("""
WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 <> 0 THEN 'a' ELSE 'b' END AS seg, c_custkey % 1000 = 1 AND c_custkey % 3 <> 0 AS planted FROM customer),
r AS (SELECT *, CASE WHEN planted OR seg = 'b' THEN 100.0 ELSE 1.0 END::DOUBLE AS v FROM c),
a AS (SELECT count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd, avg(abs(v - 1)) * sqrt(pi() / 2) AS mad FROM r WHERE seg = 'a'),
b AS (SELECT count(*) AS n, count(*) FILTER (planted)::DOUBLE / count(*) AS share FROM r WHERE v > 1)
SELECT k AS c_custkey, 'v' AS column_name, '100' AS outlier_value, 100.0::DOUBLE AS outlier_value_num, round(mean, 6) AS cluster_mean, round(sd, 6) AS cluster_sd, 1.0::DOUBLE AS cluster_median, round(mad, 6) AS cluster_mad, n AS cluster_size,
  round(99 / mad, 6) AS z_score, round(1 - 2.67 * mad, 6) AS lower_bound, round(1 + 2.67 * mad, 6) AS upper_bound, '[{"column":"seg","type":"categorical","operator":"in","values":["a"]}]' AS conditions, ' when seg IN (''a'')' AS reason, round(power(mad / 99, 2), 9) AS outlier_score FROM r, a WHERE planted
UNION ALL SELECT k, 'seg', 'a', NULL, NULL, NULL, NULL, NULL, n, round(1 / sqrt(share), 6), NULL, NULL, '[{"column":"v","type":"numeric","operator":">","value":1}]', ' when v > 1', round(share, 9) FROM r, b WHERE planted
""")
def anomaly_outlier_tree_split(spark, sf_dir):
    """Values that are odd only in their group: the conditions of the split that parts it, for both columns."""
    k = F.col("c_custkey")
    seg = F.when(k % 3 != 0, "a").otherwise("b")
    v = F.when(((k % 1000 == 1) & (k % 3 != 0)) | (k % 3 == 0), 100.0).otherwise(1.0)
    out = outlier_tree(table(spark, sf_dir, "customer").select("c_custkey", seg.alias("seg"), v.alias("v")), "seg, v", "outliers", id_column="c_custkey").drop("row_id").withColumnRenamed("id", "c_custkey")
    for c in ("cluster_mean", "cluster_sd", "cluster_mad", "z_score", "lower_bound", "upper_bound"):
        out = out.withColumn(c, F.round(c, 6))
    return out.withColumn("outlier_score", F.round("outlier_score", 9)).withColumn("reason", F.regexp_extract("explanation", r"\)( when .*)\z", 1)).drop("explanation")
