"""Personal data and phone numbers on known values."""

from pyspark.sql import functions as F

from dataplumb.functions import phone, pii


def test_phone_parsing():
    p = phone.parse("+49 (0)30 123456", "US")
    assert (p["valid"], p["country_code"], p["national_number"], p["region"], p["type"]) == (True, 49, "30123456", "DE", "FIXED_LINE")
    assert phone.parse("(506) 234-5678", "US")["region"] == "CA"
    assert phone.parse("tel: 201-555-0123 ext. 7", "US")["extension"] == "7"
    assert phone.parse("0151 23456789", "DE")["type"] == "MOBILE"
    assert phone.parse("12", "DE")["reason"] == "too_short"
    assert phone.parse("+999 1234567", "DE")["reason"] == "unsupported_region"
    assert phone.parse("call me", "DE")["reason"] == "not_a_number" and phone.parse(None, "DE") is None
    assert phone.formatted("030 123456", "DE", "E164") == "+4930123456"
    for region, row in phone.REGIONS.items():
        assert phone.parse(f"+{row[0]}{row[7]}", "DE")["valid"], region


def test_phone_columns(spark):
    df = spark.createDataFrame([("030 123456", "+49 30 123456"), (None, "1")], "a string, b string")
    rows = df.select(phone.phonenumber_format(F.col("a"), "DE").alias("f"), phone.phonenumber_is_valid(F.col("a"), "DE").alias("v"), phone.phonenumber_match(F.col("a"), F.col("b"), "DE").alias("m"), phone.phonenumber_example("de").alias("e")).collect()
    assert tuple(rows[0]) == ("+4930123456", True, "NSN_MATCH", "+4930123456") and tuple(rows[1])[:3] == (None, None, None)


def test_pii(spark):
    text = "é a.b@x.example, 4111 1111 1111 1111, 192.168.1.100, DE89 3704 0044 0532 0130 00 and 123-45-6789"
    assert [m[0] for m in pii.matches(text)] == ["EMAIL", "CREDIT_CARD", "IP_ADDRESS", "IBAN", "US_SSN"]
    df = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    rows = df.select(pii.pii_mask(F.col("t"), "partial", ["CREDIT_CARD", "IP_ADDRESS"]).alias("m"), pii.pii_count(F.col("t")).alias("n"), F.get(pii.pii_detect(F.col("t")), F.lit(0))["start_pos"].alias("p")).collect()
    assert "4111********1111" in rows[0].m and "192.***.*.***" in rows[0].m
    assert [r.n for r in rows] == [5, None, 0] and rows[0].p == 3
    assert pii.masked_value("x", "EMAIL", "hash") == "2d711642b726b044"


def test_ipv6():
    for v in ("2001:db8::1", "::1", "1::", "fe80::1%eth0", "::ffff:192.0.2.1", "2001:0db8:0:0:0:0:0:1", "64:ff9b::192.0.2.33"):
        text = f"é from {v}, host"
        assert [(t, text[a:b]) for t, a, b in pii.matches(text)] == [("IP_ADDRESS", v)]
        assert [(t, a) for t, a, _ in pii.matches(f"IP:{v}.")] == [("IP_ADDRESS", 3)] or v.startswith(":") or v.endswith(":") or "%" in v
    for text in ("at 12:30:45", "std::vector", "a::b", "1:2:3:4:5:6:7", "1::2::3", ":::1", "x2001:db8::1", "12345::1", "1:2:3:4:5:6:7:8:9"):
        assert pii.matches(text, ("IP_ADDRESS",)) == []
    assert pii.masked_value("2001:db8::1", "IP_ADDRESS", "partial") == "2001:***::*"


def test_address_query_keeps_all_rows(spark, tmp_path):
    from dataplumb.plans import QUERIES

    texts = [None, "none", "at ::1 and fe80::2", "10.0.0.1."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.n for r in QUERIES["pii_addresses"](spark, str(tmp_path)).collect()} == {0: None, 1: 0, 2: 2, 3: 1}
