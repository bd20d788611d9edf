"""Queries of the scalar functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money, validators, vat
from .checks import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


_D = [f"substr(d, {k}, 1)::INT" for k in range(1, 12)]


@query("WITH c AS (SELECT c_custkey, lpad((c_custkey * 7919 % 100000000)::BIGINT::VARCHAR, 8, '0') AS d FROM customer), s AS (SELECT *, (2*" + _D[0] + "+7*" + _D[1] + "+6*" + _D[2] + "+5*" + _D[3] + "+4*" + _D[4] + "+3*" + _D[5] + "+2*" + _D[6] + "+" + _D[7] + ") % 11 = 0 AS dk, substr(d, 1, 6)::INT % 89 = substr(d, 7, 2)::INT AS lu FROM c) SELECT c_custkey, dk AS dk_valid, CASE WHEN NOT dk THEN 'checksum_mismatch' END AS dk_reason, lu AS lu_valid, 'DK' || d AS dk_plain, NULL::BOOLEAN AS nothing FROM s")
def scalar_vat(spark, sf_dir):
    d = F.lpad((F.col("c_custkey") * 7919 % 100_000_000).cast("string"), 8, "0")
    dk = F.concat(F.lit(" dk-"), d)
    return table(spark, sf_dir, "customer").select("c_custkey", vat.vat_is_valid(dk).alias("dk_valid"), vat.vat_validate(dk)["reason"].alias("dk_reason"), vat.vat_is_valid(F.concat(F.lit("LU"), d)).alias("lu_valid"), vat.vat_format(dk).alias("dk_plain"), vat.vat_is_valid(F.lit(None).cast("string")).alias("nothing"))


@query("SELECT c_custkey, round(c_acctbal, 3)::DECIMAL(18,3) AS amount, 'EUR' AS currency, (round(c_acctbal, 3)::DECIMAL(18,3) + 1.5)::DECIMAL(18,3) AS more, c_acctbal < 0 AS negative, abs(round(c_acctbal, 3)::DECIMAL(18,3)) AS absolute, (c_custkey / 1000)::DECIMAL(18,3) AS from_fils, round(c_acctbal, 3) BETWEEN 0 AND 500 AS between_bounds FROM customer")
def scalar_money(spark, sf_dir):
    m = money.money(F.col("c_acctbal"), " eur ")
    more = money.money_add(m, money.money(F.lit(1.5), "EUR"))
    return table(spark, sf_dir, "customer").select("c_custkey", money.money_amount(m).alias("amount"), money.money_currency(m).alias("currency"), more["amount"].alias("more"), money.money_is_negative(m).alias("negative"), money.money_abs(m)["amount"].alias("absolute"), money.money_from_cents(F.col("c_custkey"), "KWD")["amount"].alias("from_fils"), money.money_in_range(m, 0, 500).alias("between_bounds"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN false WHEN 3 THEN false ELSE true END AS valid, CASE c_custkey % 4 WHEN 0 THEN 'invalid_format' WHEN 3 THEN 'empty' END AS reason FROM customer")
def scalar_email(spark, sf_dir):
    name = F.col("c_custkey").cast("string")
    e = F.when(F.col("c_custkey") % 4 == 0, F.concat(name, F.lit("@@x.de"))).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit(" a."), name, F.lit("@mail-1.example.com "))).when(F.col("c_custkey") % 4 == 2, F.concat(name, F.lit("+x@host"))).otherwise("  ")
    v = validators.email_validate(e)
    return table(spark, sf_dir, "customer").select("c_custkey", v["valid"].alias("valid"), v["reason"].alias("reason"))


@query("WITH c AS (SELECT c_custkey, '4' || lpad((c_custkey * 104729)::VARCHAR, 15, '0') AS d FROM customer) SELECT c_custkey, list_sum(list_transform(generate_series(1, 16), lambda k: CASE WHEN k % 2 = 1 THEN substr(d, k, 1)::INT * 2 - CASE WHEN substr(d, k, 1)::INT > 4 THEN 9 ELSE 0 END ELSE substr(d, k, 1)::INT END)) % 10 = 0 AS valid FROM c")
def scalar_card(spark, sf_dir):
    d = F.concat(F.lit("4"), F.lpad((F.col("c_custkey") * 104729).cast("string"), 15, "0"))
    return table(spark, sf_dir, "customer").select("c_custkey", validators.is_valid_credit_card(d).alias("valid"))
