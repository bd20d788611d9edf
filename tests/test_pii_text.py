"""Values in the forms that people write them in: folded spaces, wrapped lines, groups of any size, settings."""

from dataclasses import replace

import pytest

from pyspark.sql import functions as F

from dataplumb import config
from dataplumb.config import Config
from dataplumb.functions import phone, pii, pii_text, validators


def found(text, types=None, settings=None):
    return [f"{n}:{text[a:b]}" for n, a, b in pii.matches(text, types, settings)]


@pytest.mark.parametrize("text", [
    "DE89 3704 0044 0532 0130 00", "DE89-3704-0044-0532-0130-00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NL91-ABNA-0417-1643-00", "DE89 37040044 0532013000", "DE 89 370 400 440 532 013 000", "DE89 3704 0044 0532 0130 00",
])
def test_bank_accounts(text):
    assert found(f"an {text}, bis morgen") == [f"IBAN:{text}"]
    assert found(f"ü {text} und fertig") == [f"IBAN:{text}"]


def test_no_bank_accounts():
    for text in ("DE00 3704 0044 0532 0130 00", "XX89 3704 0044 0532 0130 00", "DE89 3704 0044 0532 0130 001", "de89370400440532013000"):
        assert not [f for f in found(text) if f.startswith("IBAN")]


@pytest.mark.parametrize(("text", "want"), [
    ("Konto IBAN DE89 3704\n0044 0532 0130 00 bei", ["IBAN:DE89 3704\n0044 0532 0130 00"]), ("card 4111 1111\n1111 1111 was", ["CREDIT_CARD:4111 1111\n1111 1111"]), ("5500 0000 0000\r\n0004, Ablauf", ["CREDIT_CARD:5500 0000 0000\r\n0004"]),
    ("an AT61 1904 3002 \n   3457 3201 erledigt", ["IBAN:AT61 1904 3002 \n   3457 3201"]), ("Karte 4111 1111 1111 1111\n2024 Ablauf", ["CREDIT_CARD:4111 1111 1111 1111"]), ("Artikel 4111 1111\n1111 1112 Stück", []), ("Nummer 4111 1111\n\n1111 1111", []), ("4111\n1111\n1111\n1111", []),
])
def test_wrapped_values(text, want):
    assert found(text, ("EMAIL", "IBAN", "CREDIT_CARD")) == want


def test_places_of_a_folded_text():
    text = "a b \r\n  c\n\nd　\ne"
    lines = pii_text.Folded(text, True)
    assert lines.text == "a b c\n\nd  e"
    assert [text[slice(*lines.span(k, k + 1))] for k, c in enumerate(lines.text) if c.isalpha()] == list("abcde")
    assert lines.joined(0, 5) == 1 and pii_text.Folded("plain").text == "plain"


@pytest.mark.parametrize("text", ["0171 1234567", "089/12345678", "(089) 123 456 78", "089-123456-78", "+49 (0) 221 4711-0", "0049 171 1234567", "+491711234567", "+1 (415) 555-1234", "(555) 123-4567", "415-555-1234", "030 123456"])
def test_telephone_numbers(text):
    assert found(f"Rückruf {text} erbeten") == [f"PHONE:{text}"] and found(f"({text})") == [f"PHONE:{text}"]


def test_no_telephone_numbers():
    for text in ("2026-10-25", "25.10.2026", "1.234,56 EUR", "PLZ 01067 Dresden", "09:30, 17:45:00", "10.0.19045", "12345 und 54321", "01.01.2026 - 31.12.2026", "01701234567", "0123-4567-8901-abcdef"):
        assert not [f for f in found(text) if f.startswith("PHONE")], text
    assert found("Handy: 01701234567") == ["PHONE:01701234567"] and found("Hotel 01701234567") == []


def test_addresses_and_devices():
    for text in ("jörg.k@example.com", "info@müller-gmbh.de", "пётр@пример.рф", "a@b"):
        assert found(f"«{text}», danke") == [f"EMAIL:{text}"]
    assert found("?email=max@web.de&id=7") == ["EMAIL:max@web.de"] and found("x" * 65 + "@web.de") == []
    for text in ("00265e8b1c2a", "00:26:5E:8B:1C:2A", "00-26-5E-8B-1C-2A", "0026.5e8b.1c2a", "0123.4567.89ab"):
        assert found(f"Gerät {text}", ("MAC_ADDRESS",)) == [f"MAC_ADDRESS:{text}"]
    for text in ("491711234567", "NL 004495445B01", "ABCDEFABCDEF", "X00265e8b1c2a", "aabb.ccdd.eeff.0011", "9531985d-5d9d-49f8-9818-e811892f902b"):
        assert found(text, ("MAC_ADDRESS",)) == [], text


def test_hash_and_mask_of_a_wrapped_value():
    for how in ("hash", "partial"):
        assert pii.masked_value("DE89 3704\n0044 0532 0130 00", "IBAN", how) == pii.masked_value("DE89 3704 0044 0532 0130 00", "IBAN", how)


def test_settings_change_results():
    text = "mail a@b.example or 0171 1234567, DE00 3704 0044 0532 0130 00"
    base = Config()
    assert found(text, None, replace(base, pii_enabled_types=("EMAIL",))) == ["EMAIL:a@b.example"]
    assert found(text, ("PHONE",), replace(base, pii_enabled_types=("EMAIL",))) == ["PHONE:0171 1234567"]
    lenient = replace(base, pii_require_checksum=False)
    assert "IBAN:DE00 3704 0044 0532 0130 00" in found(text, None, lenient) and "IBAN:DE00 3704 0044 0532 0130 00" not in found(text, None, replace(lenient, pii_min_confidence=0.7))
    assert found("Anna Schmidt", None, replace(base, pii_min_confidence=0.6)) == [] and found("Anna Schmidt") == ["NAME:Anna Schmidt"]


def test_settings_of_the_session(spark):
    df = spark.createDataFrame([("call 0171 1234567 or a@b.example",), ("nothing here",), (None,)], "t string")
    names = {"dataplumb.pii_enabled_types": "email", "dataplumb.pii_default_mask_strategy": "asterisk", "dataplumb.phone_default_region": "de"}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        assert [r[0] for r in df.select(pii.pii_mask(F.col("t"))).collect()] == ["call 0171 1234567 or ***********", "nothing here", None]
        assert df.select(phone.phonenumber_format(F.lit("030 123456"))).first()[0] == "+4930123456"
        assert {r.setting: r.value for r in config.pii_config().collect()}["pii_enabled_types"] == "('EMAIL',)"
        spark.conf.set("dataplumb.pii_min_confidence", "2")
        with pytest.raises(ValueError, match="between 0 and 1"):
            pii.pii_count(F.col("t"))
    finally:
        for k in [*names, "dataplumb.pii_min_confidence"]:
            spark.conf.unset(k)
    assert [r[0] for r in df.select(pii.pii_count(F.col("t"))).collect()] == [2, 0, None]


def test_validators_take_values_wrapped_once(spark):
    df = spark.createDataFrame([("DE89 3704\n0044 0532 0130 00", "4111 1111\r\n1111 1111"), ("DE89 3704\n0044 0532\n0130 00", "4111\n1111\n1111 1111"), (None, None)], "i string, c string")
    assert [tuple(r) for r in df.select(validators.is_valid_iban(F.col("i")), validators.is_valid_credit_card(F.col("c"))).collect()] == [(True, True), (False, False), (None, None)]
