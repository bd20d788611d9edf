"""Queries of personal data and numbers in the forms that people write them in, built from the tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from .._tables import spread
from ..config import Config
from ..functions import phone, pii, validators, vat
from .checks import table

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def put(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def _check_digits(bban):
    """Of a German account: 98 less the remainder of the number with DE00 behind it."""
    number = (bban.cast("decimal(18,0)").cast("decimal(38,0)") * 1_000_000 + 131_400).cast("decimal(38,0)")
    return F.lpad((98 - number % 97).cast("int").cast("string"), 2, "0")


def _letters(spark, sf_dir):
    """A letter for each customer, with a bank account over two lines, a national telephone number, an address with an umlaut and a device."""
    k = F.col("c_custkey")
    bban = F.lpad((k * 7_919_000_017 % 10**15).cast("string"), 18, "98")
    iban = F.concat(F.lit("DE"), _check_digits(bban), F.lit(" "), F.substring(bban, 1, 4), F.lit("\n"), F.substring(bban, 5, 4), F.lit(" "), F.substring(bban, 9, 10))
    number = F.concat(F.lit("0171 "), F.lpad((k * 7919 % 10_000_000).cast("string"), 7, "0"))
    mail = F.concat(F.lit("jörg.k"), k, F.lit("@müller.example"))
    device = F.concat_ws(".", F.lpad((k % 10_000).cast("string"), 4, "0"), F.lit("5e8b"), F.lit("1c2a"))
    text = F.concat(F.lit("Für Sie: "), number, F.lit(", "), mail, F.lit(". Konto "), iban, F.lit(" und Gerät "), device)
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", text.alias("text"))


_LETTERS = r"""
WITH n AS (SELECT c_custkey AS k, lpad((c_custkey * 7919000017 % 1000000000000000)::VARCHAR, 18, '98') AS bban FROM customer),
p AS (SELECT k, 'DE' || lpad((98 - (bban::HUGEINT * 1000000 + 131400) % 97)::VARCHAR, 2, '0') || ' ' || substr(bban, 1, 4) || chr(10) || substr(bban, 5, 4) || ' ' || substr(bban, 9, 10) AS iban,
  '0171 ' || lpad((k * 7919 % 10000000)::VARCHAR, 7, '0') AS phone, 'jörg.k' || k || '@müller.example' AS mail, lpad((k % 10000)::VARCHAR, 4, '0') || '.5e8b.1c2a' AS device FROM n),
t AS (SELECT *, 'Für Sie: ' || phone || ', ' || mail || '. Konto ' || iban || ' und Gerät ' || device AS text FROM p)"""


@query(_LETTERS + """,
m AS (SELECT *, 'PHONE' AS t, phone AS x FROM t UNION ALL SELECT *, 'EMAIL', mail FROM t UNION ALL SELECT *, 'IBAN', iban FROM t UNION ALL SELECT *, 'MAC_ADDRESS', device FROM t)
SELECT k AS c_custkey, t AS pii_type, x AS matched_text, strlen(split_part(text, x, 1))::INT AS start_pos, (strlen(split_part(text, x, 1)) + strlen(x))::INT AS end_pos FROM m
""")
def pii_formats(spark, sf_dir):
    found = _letters(spark, sf_dir).select("c_custkey", F.explode(pii.pii_detect(F.col("text"))).alias("m"))
    return found.select("c_custkey", F.col("m.type").alias("pii_type"), F.col("m.text").alias("matched_text"), F.col("m.start_pos").alias("start_pos"), F.col("m.end_pos").alias("end_pos"))


@query(_LETTERS + """
SELECT k AS c_custkey, 'Für Sie: [PHONE], [EMAIL]. Konto [IBAN] und Gerät [MAC_ADDRESS]' AS redacted, substr(sha256(replace(iban, chr(10), ' ')), 1, 16) AS hashed, repeat('*', length(phone)) AS starred,
  [phone] AS phones, [mail] AS mails, [iban] AS ibans, 0 AS cards, 0 AS ssns, 0 AS names, 4 AS first_found, NULL::INT AS second_found, 2 AS n_texts FROM t
""")
def pii_functions(spark, sf_dir):
    """The functions of one type, of one value and of arrays of texts."""
    text = F.col("text")
    texts = lambda c: F.transform(c, lambda m: m["text"])
    iban, number = F.get(pii.pii_detect_ibans(text), F.lit(0))["text"], F.get(pii.pii_detect_phones(text), F.lit(0))["text"]
    batch = pii.pii_detect_batch(F.array(text, F.lit(None).cast("string")))
    df = _letters(spark, sf_dir).withColumns({"iban": iban, "number": number, "batch": batch})
    return df.select(
        "c_custkey", pii.pii_redact_column(text).alias("redacted"), pii.pii_mask_value(F.col("iban"), "IBAN", "hash").alias("hashed"), pii.pii_mask_value(F.col("number"), "PHONE", "asterisk").alias("starred"),
        texts(pii.pii_detect_phones(text)).alias("phones"), texts(pii.pii_detect_emails(text)).alias("mails"), texts(pii.pii_detect_ibans(text)).alias("ibans"), F.size(pii.pii_detect_credit_cards(text)).alias("cards"), F.size(pii.pii_detect_ssns(text)).alias("ssns"), F.size(pii.pii_detect_names(text)).alias("names"),
        F.size(F.get("batch", F.lit(0))).alias("first_found"), F.when(F.get("batch", F.lit(1)).isNotNull(), F.size(F.get("batch", F.lit(1)))).alias("second_found"), F.size("batch").alias("n_texts"),
    )


@query(_LETTERS + """,
w AS (SELECT *, 'DE' || lpad(((substr(iban, 3, 2)::INT + 1) % 100)::VARCHAR, 2, '0') || replace(substr(iban, 5), chr(10), ' ') AS wrong FROM t)
SELECT k AS c_custkey, 2 AS only_two, ['IBAN', 'PHONE'] AS kinds, 0 AS strict, 1 AS lenient, 0.6::DOUBLE AS lenient_confidence, 0 AS lenient_but_sure, repeat('*', length(phone)) AS by_setting FROM w
""")
def pii_settings(spark, sf_dir):
    """Types, confidence, check digits and mask by settings."""
    text, base = F.col("text"), Config()
    two = replace(base, pii_enabled_types=("IBAN", "PHONE"))
    found = pii.pii_detect(text, config=two)
    wrong = F.col("wrong")
    lenient = pii.pii_detect(wrong, "IBAN", replace(base, pii_require_checksum=False))
    sure = pii.pii_detect(wrong, "IBAN", replace(base, pii_require_checksum=False, pii_min_confidence=0.9))
    first = F.regexp_extract(text, "DE[0-9]{2} [0-9]{4}\n[0-9]{4} [0-9]{10}", 0)
    digits = F.lpad(((F.substring(first, 3, 2).cast("int") + 1) % 100).cast("string"), 2, "0")
    # In regular groups, as failures are looked for in these alone.
    plain = F.regexp_replace(F.substring(first, 5, 40), "[ \n]", "")
    df = _letters(spark, sf_dir).withColumn("wrong", F.concat(F.lit("DE"), digits, plain))
    number = F.regexp_extract(text, "0171 [0-9]{7}", 0)
    return df.select(
        "c_custkey", F.size(found).alias("only_two"), F.array_sort(F.transform(found, lambda m: m["type"])).alias("kinds"), F.size(pii.pii_detect(wrong, "IBAN")).alias("strict"), F.size(lenient).alias("lenient"),
        F.get(lenient, F.lit(0))["confidence"].alias("lenient_confidence"), F.size(sure).alias("lenient_but_sure"), pii.pii_mask(number, config=replace(base, pii_default_mask_strategy="asterisk")).alias("by_setting"),
    )


@query("""
WITH c AS (SELECT c_custkey AS k, lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0') AS d FROM customer)
SELECT k AS c_custkey,
  CASE k % 6 WHEN 0 THEN '+49151' || d WHEN 1 THEN '+331' || d WHEN 2 THEN '+48600' || substr(d, 3) WHEN 3 THEN '+612' || d END AS e164,
  CASE k % 6 WHEN 0 THEN 'DE' WHEN 1 THEN 'FR' WHEN 2 THEN 'PL' WHEN 3 THEN 'AU' END AS region,
  CASE k % 6 WHEN 0 THEN 'MOBILE' WHEN 2 THEN 'MOBILE' WHEN 1 THEN 'FIXED_LINE' WHEN 3 THEN 'FIXED_LINE' END AS kind, k % 6 < 4 AS valid, CASE k % 6 WHEN 4 THEN 'invalid_number' WHEN 5 THEN 'too_long' END AS reason, k % 6 <> 5 AS possible,
  CASE k % 6 WHEN 0 THEN '+4930123456' WHEN 1 THEN '+33123456789' WHEN 2 THEN '+48123456789' WHEN 3 THEN '+61212345678' WHEN 4 THEN '+441212345678' WHEN 5 THEN '+34810123456' END AS example FROM c
""")
def scalar_phone_regions(spark, sf_dir):
    """National numbers of several regions, invalid and too long ones."""
    k = F.col("c_custkey")
    d = F.lpad((k * 7919 % 100_000_000).cast("string"), 8, "0")
    pick = lambda *values: F.element_at(F.array(*values), (k % 6 + 1).cast("int"))
    region = pick(*map(F.lit, ("DE", "FR", "PL", "AU", "GB", "ES")))
    number = pick(F.concat(F.lit("0151 "), d), F.concat(F.lit("01 "), d), F.concat(F.lit("600 "), F.substring(d, 3, 6)), F.concat(F.lit("(02) "), d), F.concat(F.lit("076"), d), F.concat(F.lit("9112"), d))
    parsed = phone.phonenumber_parse(number, region)
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select(
        "c_custkey", phone.phonenumber_format(number, region, "E164").alias("e164"), parsed["region"].alias("region"), parsed["type"].alias("kind"), parsed["valid"].alias("valid"), parsed["reason"].alias("reason"), phone.phonenumber_is_possible(number, region).alias("possible"), phone.phonenumber_example(region).alias("example")
    )


@query("""
WITH n AS (SELECT c_custkey AS k, lpad((c_custkey * 7919000017 % 1000000000000000)::VARCHAR, 18, '98') AS bban FROM customer),
v AS (SELECT k, k % 3 <> 0 AS iban, k % 2 = 0 AS tax, k % 5 <> 0 AS coin, md5(k::VARCHAR) AS h FROM n)
SELECT k AS c_custkey, iban, tax, coin, CASE WHEN k % 2 = 0 THEN 'DK' END AS country, k % 2 = 0 AS there FROM v
""")
def scalar_identifiers_more(spark, sf_dir):
    """Bank accounts (wrapped once, or with other check digits), tax numbers, addresses of coins, VAT numbers."""
    k = F.col("c_custkey")
    bban = F.lpad((k * 7_919_000_017 % 10**15).cast("string"), 18, "98")
    digits = F.when(k % 3 == 0, F.lpad(((_check_digits(bban).cast("int") + 1) % 100).cast("string"), 2, "0")).otherwise(_check_digits(bban))
    iban = F.concat(F.lit("DE"), digits, F.lit("\n"), bban)
    tax = F.when(k % 2 == 0, "65929970489").otherwise("65929970488")
    h = F.md5(k.cast("string"))
    coin = F.concat(F.lit("0x"), h, F.substring(h, 1, 8), F.when(k % 5 == 0, "0").otherwise(""))
    number = F.concat(F.when(k % 2 == 0, "DK ").otherwise("XX "), F.lpad((k * 7919 % 90_000_000 + 10_000_000).cast("string"), 8, "0"))
    return spread(table(spark, sf_dir, "customer").select("c_custkey")).select("c_custkey", validators.is_valid_iban(iban).alias("iban"), validators.is_valid_de_tax_id(tax).alias("tax"), pii.pii_is_valid_crypto_address(coin).alias("coin"), vat.vat(number)["country"].alias("country"), vat.vat_exists(number).alias("there"))
