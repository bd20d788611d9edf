"""VAT identifiers: normalising, syntax and check digits, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names, and patterns of the national part.
COUNTRIES = {
    "AT": ("Austria", "U[0-9]{8}"),
    "BE": ("Belgium", "[01][0-9]{9}"),
    "BG": ("Bulgaria", "[0-9]{9,10}"),
    "CY": ("Cyprus", "(?!12)[0-69][0-9]{7}[A-Z]"),
    "CZ": ("Czech Republic", "[0-9]{8,10}"),
    "DE": ("Germany", "[0-9]{9}"),
    "DK": ("Denmark", "[0-9]{8}"),
    "EE": ("Estonia", "10[0-9]{7}"),
    "ES": ("Spain", "([A-Z][0-9]{8}|[0-9]{8}[A-Z]|[A-Z][0-9]{7}[A-Z])"),
    "FI": ("Finland", "[0-9]{8}"),
    "FR": ("France", "[A-HJ-NP-Z0-9]{2}[0-9]{9}"),
    "GB": ("United Kingdom", "([0-9]{9}|[0-9]{12}|(HA|GD)[0-9]{3})"),
    "GR": ("Greece", "[0-9]{9}"),
    "HR": ("Croatia", "[0-9]{11}"),
    "HU": ("Hungary", "[0-9]{8}"),
    "IE": ("Ireland", "([0-9][A-Z][0-9]{5}[A-Z]|[0-9]{7}[A-Z]{1,2})"),
    "IT": ("Italy", "[0-9]{11}"),
    "LT": ("Lithuania", "([0-9]{7}1[0-9]|[0-9]{10}1[0-9])"),
    "LU": ("Luxembourg", "[0-9]{8}"),
    "LV": ("Latvia", "[0-9]{11}"),
    "MT": ("Malta", "[0-9]{8}"),
    "NL": ("Netherlands", "[0-9]{9}B[0-9]{2}"),
    "PL": ("Poland", "[0-9]{10}"),
    "PT": ("Portugal", "[0-9]{9}"),
    "RO": ("Romania", "[1-9][0-9]{1,9}"),
    "SE": ("Sweden", "[0-9]{10}01"),
    "SI": ("Slovenia", "[0-9]{8}"),
    "SK": ("Slovakia", "[0-9]{10}"),
    "XI": ("United Kingdom", "([0-9]{9}|[0-9]{12}|(HA|GD)[0-9]{3})"),
}
NOT_EU = ("GB", "XI")
NIF_LETTERS, CIF_LETTERS, IE_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE", "JABCDEFGHI", "WABCDEFGHIJKLMNOPQRSTUV"

_WIDE = "".join(chr(0xFF01 + k) for k in range(94))
_PLAIN = "".join(chr(0x21 + k) for k in range(94))


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, so that long expressions don't repeat it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def vat_normalize(v: Column) -> Column:
    """Full width folded, letters and digits only, in capitals."""
    return F.upper(F.regexp_replace(F.translate(v, _WIDE, _PLAIN), "[^A-Za-z0-9]", ""))


def _country(n: Column) -> Column:
    prefix = F.substring(n, 1, 2)
    return F.when(prefix == "EL", "GR").when(prefix.rlike("^[A-Z]{2}$"), prefix)


def _national(n: Column) -> Column:
    return F.substring(n, 3, 100)


def _digit(s: Column, place: int) -> Column:
    return F.ascii(F.substring(s, place, 1)) - 48


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


def _weighted(s: Column, weights: list[int]) -> Column:
    return _sum([_digit(s, k + 1) * w for k, w in enumerate(weights)])


def _doubled(d: Column) -> Column:
    """The digit sum of twice the digit."""
    return F.floor(d * 2 / 10) + d * 2 % 10


def luhn_ok(s: Column, n: int) -> Column:
    return _sum([_doubled(_digit(s, k)) if (n - k) % 2 else _digit(s, k) for k in range(1, n + 1)]) % 10 == 0


def mod_11_10_ok(s: Column, n: int) -> Column:
    """ISO 7064 mod 11,10 over n digits, the last being the check digit."""


    def step(p: Column, d: Column) -> Column:
        return let((d + p) % 10, lambda total: F.when(total == 0, 20).otherwise(total * 2) % 11)

    p = F.aggregate(F.array(*(_digit(s, k) for k in range(1, n))), F.lit(10), step)
    return (11 - p) % 10 == _digit(s, n)


def _number(s: Column, start: int, length: int) -> Column:
    return F.substring(s, start, length).try_cast("long")


def _letter(letters: str, index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, letters)), (index + 1).cast("int"))


def _spain(s: Column) -> Column:
    last = F.substring(s, 9, 1)
    plain = _letter(NIF_LETTERS, _number(s, 1, 8) % 23) == last
    lead = F.translate(F.substring(s, 1, 1), "XYZ", "012")
    foreign = _letter(NIF_LETTERS, F.concat(lead, F.substring(s, 2, 7)).try_cast("long") % 23) == last
    check = (10 - _sum([_doubled(_digit(s, k)) if k % 2 == 0 else _digit(s, k) for k in range(2, 9)]) % 10) % 10
    company = (last == check.cast("string")) | (last == _letter(CIF_LETTERS, check))
    return F.when(s.rlike("^[0-9]{8}[A-Z]$"), plain).when(s.rlike("^[XYZ][0-9]{7}[A-Z]$"), foreign).otherwise(company)


def _ireland(s: Column) -> Column:
    old = s.rlike("^[0-9][A-Z][0-9]{5}[A-Z]$")
    body = F.when(old, F.concat(F.lit("0"), F.substring(s, 3, 5), F.substring(s, 1, 1))).otherwise(F.substring(s, 1, 7))
    extra = F.when(~old & (F.length(s) == 9), F.when(F.substring(s, 9, 1) == "W", 0).otherwise(F.ascii(F.substring(s, 9, 1)) - 64)).otherwise(0)
    return _letter(IE_LETTERS, (_weighted(body, [8, 7, 6, 5, 4, 3, 2]) + 9 * extra) % 23) == F.substring(s, 8, 1)


def _netherlands(s: Column) -> Column:
    rest = _weighted(s, [9, 8, 7, 6, 5, 4, 3, 2]) % 11
    # NL, the number and B as digits: N is 23, L is 21, B is 11.
    whole = F.concat(F.lit("2321"), F.substring(s, 1, 9), F.lit("11"), F.substring(s, 11, 2)).try_cast("decimal(38,0)")
    return ((rest < 10) & (rest == _digit(s, 9))) | (whole % 97 == 1)


def _finland(s: Column) -> Column:
    rest = _weighted(s, [7, 9, 10, 5, 8, 4, 2]) % 11
    return F.when(rest == 1, False).otherwise((11 - rest) % 11 == _digit(s, 8))


def _slovenia(s: Column) -> Column:
    check = 11 - _weighted(s, [8, 7, 6, 5, 4, 3, 2]) % 11
    return F.when(check == 11, False).otherwise(check % 10 == _digit(s, 8))


CHECKSUMS = {
    "AT": lambda s: (96 - _sum([_digit(s, k + 1) if k % 2 else _doubled(_digit(s, k + 1)) for k in range(1, 8)])) % 10 == _digit(s, 9),  # after the U
    "BE": lambda s: 97 - _number(s, 1, 8) % 97 == _number(s, 9, 2),
    "DE": lambda s: mod_11_10_ok(s, 9),
    "DK": lambda s: _weighted(s, [2, 7, 6, 5, 4, 3, 2, 1]) % 11 == 0,
    "ES": _spain,
    "FI": _finland,
    "FR": lambda s: F.when(s.rlike("^[0-9]"), F.coalesce(_number(s, 1, 2) == (12 + 3 * (_number(s, 3, 9) % 97)) % 97, F.lit(True))).otherwise(True),
    "GR": lambda s: _weighted(s, [256, 128, 64, 32, 16, 8, 4, 2]) % 11 % 10 == _digit(s, 9),
    "IE": _ireland,
    "IT": lambda s: luhn_ok(s, 11),
    "LU": lambda s: _number(s, 1, 6) % 89 == _number(s, 7, 2),
    "NL": _netherlands,
    "PL": lambda s: _weighted(s, [6, 5, 7, 2, 3, 4, 5, 6, 7]) % 11 == _digit(s, 10),
    "PT": lambda s: F.when(_weighted(s, [9, 8, 7, 6, 5, 4, 3, 2]) % 11 < 2, 0).otherwise(11 - _weighted(s, [9, 8, 7, 6, 5, 4, 3, 2]) % 11) == _digit(s, 9),
    "SE": lambda s: luhn_ok(s, 10),
    "SI": _slovenia,
}


def _known(country: Column) -> Column:
    return country.isin(list(COUNTRIES))


def _syntax(country: Column, national: Column) -> Column:
    out = F.when(F.lit(False), False)
    for code, (_, pattern) in COUNTRIES.items():
        out = out.when(country == code, national.rlike(f"^(?:{pattern})\\z"))
    return out.otherwise(False)


def _checksum(country: Column, national: Column) -> Column:
    out = F.when(F.lit(False), False)
    for code, ok in CHECKSUMS.items():
        out = out.when(country == code, F.coalesce(ok(national), F.lit(False)))
    return out.otherwise(True)


def vat_split(v: Column) -> Column:
    """(country, digits); EL is GR. Null where there is no prefix of a known country."""
    split = lambda n: F.when(_known(_country(n)), F.struct(_country(n).alias("country"), _national(n).alias("digits")))
    return let(vat_normalize(v), split)


vat = vat_split


def vat_is_valid_syntax(v: Column) -> Column:
    parts = lambda n: F.struct(_country(n).alias("c"), _national(n).alias("s"))
    return F.when(v.isNotNull(), let(let(vat_normalize(v), parts), lambda p: F.coalesce(_syntax(p["c"], p["s"]), F.lit(False))))


vat_exists = vat_is_valid_syntax


def vat_validate(v: Column) -> Column:
    """(valid, country, reason): empty, missing_prefix, unsupported_country, invalid_format or checksum_mismatch."""
    def judge(p: Column) -> Column:
        country, national = p["c"], p["s"]
        reason = F.when(p["n"] == "", "empty").when(country.isNull(), "missing_prefix").when(~_known(country), "unsupported_country").when(~_syntax(country, national), "invalid_format").when(~_checksum(country, national), "checksum_mismatch")
        return let(reason, lambda r: F.struct(r.isNull().alias("valid"), F.when(_known(country), country).alias("country"), r.alias("reason")))

    parts = lambda n: F.struct(n.alias("n"), _country(n).alias("c"), _national(n).alias("s"))
    return F.when(v.isNotNull(), let(let(vat_normalize(v), parts), judge))


def vat_is_valid(v: Column) -> Column:
    return vat_validate(v)["valid"]


def vat_format(v: Column, style: str = "iso") -> Column:
    """iso: with the country's code; plain: without."""
    if style not in ("iso", "plain"):
        raise ValueError("style must be 'iso' or 'plain'")
    parts = vat_split(v)
    return F.concat(parts["country"], parts["digits"]) if style == "iso" else parts["digits"]


def is_valid_vat_country(c: Column) -> Column:
    return F.upper(F.trim(c)).isin([*COUNTRIES, "EL"])


def vat_is_eu_member(c: Column) -> Column:
    return F.upper(F.trim(c)).isin([k for k in [*COUNTRIES, "EL"] if k not in NOT_EU])


def vat_country_name(c: Column) -> Column:
    code = F.upper(F.trim(c))
    out = F.when(code == "EL", COUNTRIES["GR"][0])
    for k, (name, _) in COUNTRIES.items():
        out = out.when(code == k, name)
    return out
