"""Scalar functions on known values."""

import pytest
from pyspark.sql import functions as F

from dataplumb.functions import money, validators, vat


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("v"))).collect()]


def test_vat_checksums(spark):
    good = ["ATU13585627", "BE0428759497", "DE136695976", "DK13585628", "ESA13585625", "ES54362315K", "ESX2482300W", "FI20774740", "FR40303265045", "EL094259216", "IE6433435F", "IE8D79739I", "IE6433435OA", "IT00743110157", "LU15027442", "NL004495445B01", "PL8567346215", "PT501964843", "SE123456789701", "SI50223054", "GB980780684"]
    assert values(spark, vat.vat_is_valid, good) == [True] * len(good)
    bad = ["ATU13585626", "BE0428759496", "DE136695975", "DK13585627", "FI20774741", "FR41303265045", "IT00743110158", "LU15027443", "NL004495446B01", "PL8567346216", "PT501964842", "SI50223055"]
    assert values(spark, vat.vat_is_valid, bad) == [False] * len(bad)


def test_vat_reasons(spark):
    found = values(spark, lambda c: vat.vat_validate(c)["reason"], ["", "12345", "ZZ123", "DE12", "DE136695975", " de 136.695-976", None])
    assert found == ["empty", "missing_prefix", "unsupported_country", "invalid_format", "checksum_mismatch", None, None]
    assert values(spark, vat.vat_normalize, ["ＤＥ 12"]) == ["DE12"]
    with pytest.raises(ValueError):
        vat.vat_format(F.lit("x"), "pretty")


def test_identifiers(spark):
    assert values(spark, validators.is_valid_iban, ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE89370400440532013001", "x", None]) == [True, True, False, False, None]
    assert values(spark, validators.is_valid_credit_card, ["4111 1111 1111 1111", "378282246310005", "4111111111111112", "411", None]) == [True, True, False, False, None]
    assert values(spark, validators.is_valid_ssn, ["123-45-6789", "000-45-6789", "123 45-6789"]) == [True, False, False]
    assert values(spark, validators.is_valid_nino, ["AB123456C", "BG123456A", "ab 12 34 56 d"]) == [True, False, True]
    assert values(spark, validators.is_valid_de_tax_id, ["86095742719", "86095742718", "11111111111"]) == [True, False, False]
    assert values(spark, validators.is_valid_kvnr, ["A123456780", "A123456781"]) == [True, False]


def test_email(spark):
    found = values(spark, validators.email_is_valid, ["a.b@x.example", " a@localhost ", "a@1.2", "a..b@x.de", "", "x" * 65 + "@y.de", None])
    assert found == [True, True, False, False, False, False, None]
    assert values(spark, lambda c: validators.email_is_valid(c, "dns"), ["a@x.de", "bad"]) == [None, False]


def test_money(spark):
    df = spark.range(1)
    m = money.money(F.lit(-1234.5675), "eur")
    row = df.select(money.money_format(m).alias("a"), money.money_format(money.money(F.lit(1234), "JPY"), "code").alias("b"), money.money_format(money.money(F.lit(5), "USD"), "long").alias("c"), money.money_multiply(m, F.lit(2.0))["amount"].cast("string").alias("d"), money.money_same_currency(m, m).alias("e")).first()
    assert row.a == "-1.234,57 €" and row.b == "1,234 JPY" and row.c == "5.00 United States Dollar" and row.d == "-2469.136" and row.e
    for bad in (money.money(F.lit(1), "ABC"), money.money_add(money.money(F.lit(1), "EUR"), money.money(F.lit(1), "USD")), money.money(F.lit(1e18), "EUR")):
        with pytest.raises(Exception):
            df.select(bad).collect()
