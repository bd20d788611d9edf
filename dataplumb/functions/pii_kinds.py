"""Finders of the personal-data types that need more than one pattern: keywords, check digits, entropy, names.

Each takes a text and yields (start, end) in characters.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

#: The alphabet of Base58, the letters of document numbers, weights of check digits.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
DOCUMENT = "0-9CFGHJKLMNPRTVWXYZ"
ICAO_WEIGHTS = (7, 3, 1)
PENSION_WEIGHTS = (2, 1, 2, 5, 7, 1, 2, 1, 2, 1, 2, 1)

_EDGE, _END = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
#: At most three words and no comma or sentence end between a keyword and what it announces.
_GAP = r"[ :=\t]*(?:(?!\d)[^\s,;.!?]+[ :=\t]+){0,3}"


def base58_ok(v: str) -> bool:
    """A Base58Check address of 25 bytes: the last four are the digest of the others."""
    number = 0
    for c in v:
        if (k := BASE58.find(c)) < 0:
            return False
        number = number * 58 + k
    if number.bit_length() > 200:
        return False
    raw = number.to_bytes(25, "big")
    zeros = len(v) - len(v.lstrip("1"))
    if len(raw) - len(raw.lstrip(b"\0")) != zeros:
        return False
    return hashlib.sha256(hashlib.sha256(raw[:21]).digest()).digest()[:4] == raw[21:]


def is_crypto_address(v: str) -> bool:
    v = v.strip()
    if re.fullmatch(r"0x[0-9A-Fa-f]{40}", v):
        return True
    if re.fullmatch(r"(?:bc1[02-9ac-hj-np-z]+|BC1[02-9AC-HJ-NP-Z]+)", v):
        return len(v) in (42, 62)
    return bool(re.fullmatch(r"[13][1-9A-HJ-NP-Za-km-z]{25,34}", v)) and base58_ok(v)


_CRYPTO = re.compile(_EDGE + r"(?:0x[0-9A-Fa-f]{40}|(?:bc1|BC1)[0-9A-Za-z]{39,59}|[13][1-9A-HJ-NP-Za-km-z]{25,34})" + _END)


def crypto_addresses(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _CRYPTO.finditer(text) if is_crypto_address(m[0]))


def entropy(v: str) -> float:
    """Bits a character."""
    return -sum(c / len(v) * math.log2(c / len(v)) for c in Counter(v).values())


_KNOWN_KEY = re.compile(_EDGE + r"(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36})" + _END)
_LONG_KEY = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_-]{32,64}(?![A-Za-z0-9_+/-])")
_IDENTIFIER = re.compile(r"\{?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\}?|(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")


def api_keys(text: str) -> Iterator[tuple[int, int]]:
    yield from (m.span() for m in _KNOWN_KEY.finditer(text))
    for m in _LONG_KEY.finditer(text):
        if entropy(m[0]) >= 3.5 and not _IDENTIFIER.fullmatch(m[0]) and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            yield m.span()


#: Months by their first letters, in German and English.
_MONTHS = {"jan": 1, "jän": 1, "feb": 2, "mär": 3, "mar": 3, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "okt": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12}
_BIRTH = re.compile(
    r"(?<!\w)(?:geboren|geb\.|geburtsdatum|geburtstag|dob|d\.o\.b\.|date of birth|birthday|born)" + _GAP
    + r"(?P<date>(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}|\d{2})|(?P<y2>\d{4})-(?P<m2>\d{2})-(?P<d2>\d{2})|(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y3>\d{4})|(?P<d4>\d{1,2})\. ?(?P<m4>[^\W\d]{3,9}) (?P<y4>\d{4})|(?P<m5>[^\W\d]{3,9}) (?P<d5>\d{1,2}), ?(?P<y5>\d{4}))(?!\d)",
    re.IGNORECASE,
)


def births(text: str) -> Iterator[tuple[int, int]]:
    today = datetime.date.today()

    def ok(year: int, month: int, day: int) -> bool:
        try:
            return datetime.date(1900, 1, 1) <= datetime.date(year, month, day) <= today
        except ValueError:
            return False

    for m in _BIRTH.finditer(text):
        g = m.groupdict()
        if g["y"]:
            year = int(g["y"])
            if len(g["y"]) == 2:
                year += 2000 if year <= today.year % 100 else 1900
            good = ok(year, int(g["m"]), int(g["d"]))
        elif g["y2"]:
            good = ok(int(g["y2"]), int(g["m2"]), int(g["d2"]))
        elif g["y3"]:
            good = ok(int(g["y3"]), int(g["a"]), int(g["b"])) or ok(int(g["y3"]), int(g["b"]), int(g["a"]))
        else:
            month, day, year = (g["m4"], g["d4"], g["y4"]) if g["y4"] else (g["m5"], g["d5"], g["y5"])
            good = month[:3].lower() in _MONTHS and ok(int(year), _MONTHS[month[:3].lower()], int(day))
        if good:
            yield m.span("date")


def _digit_sum(n: int) -> int:
    return n // 10 + n % 10


def pension_ok(v: str) -> bool:
    """Area, birth date, letter as two digits, serial; the last digit checks the others."""
    n = re.sub(r"\s", "", v).upper()
    digits = n[:8] + f"{ord(n[8]) - 64:02d}" + n[9:]
    day, month = int(n[2:4]), int(n[4:6])
    return 1 <= day <= 31 and 1 <= month <= 12 and sum(_digit_sum(int(c) * w) for c, w in zip(digits, PENSION_WEIGHTS, strict=False)) % 10 == int(digits[12])


_PENSION = re.compile(_EDGE + r"[0-9]{2} ?[0-9]{6} ?[A-Za-z] ?[0-9]{3}" + _END)


def pension_numbers(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _PENSION.finditer(text) if pension_ok(m[0]))


def health_ok(v: str) -> bool:
    digits = f"{ord(v[0].upper()) - 64:02d}" + v[1:]
    return sum(_digit_sum(int(c) * (1 + k % 2)) for k, c in enumerate(digits[:10])) % 10 == int(digits[10])


_HEALTH = re.compile(r"(?<!\w)(?i:krankenversichertennummer|versichertennummer|versicherten-nr\.?|kvnr|kv-nr\.?|egk|gesundheitskarte|health insurance number)" + _GAP + r"(?P<id>[A-Z][0-9]{9})" + _END)


def health_numbers(text: str) -> Iterator[tuple[int, int]]:
    return (m.span("id") for m in _HEALTH.finditer(text) if health_ok(m["id"]))


def icao_ok(v: str) -> bool:
    """The last digit checks the characters before it, letters counting from 10."""
    return sum(int(c, 36) * ICAO_WEIGHTS[k % 3] for k, c in enumerate(v[:-1])) % 10 == int(v[-1])


_CARD = re.compile(_EDGE + rf"(?P<id>[CFGHJKLMNPRTVWXYZ][{DOCUMENT}]{{8}}(?P<check>[0-9])?)" + _END)
_CARD_WORD = re.compile(r"(?<!\w)(?i:personalausweis|ausweis(?:-?nr\.?|nummer)?|reisepass|passnummer|id card|passport)" + _GAP + r"\Z")


def id_cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if re.search("[0-9]", m["id"][1:9]) and ((m["check"] and icao_ok(m["id"])) or _CARD_WORD.search(text, max(0, m.start() - 80), m.start())):
            yield m.span("id")


_POSTAL = [
    re.compile(r"(?i:\b(?:plz|postleitzahl|postcode|zip)\b)[ :]*(?P<id>[0-9]{4,5}|[0-9]{4} ?[A-Z]{2}|[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})" + _END),
    re.compile(r"(?:\b[0-9]+ ?[a-z]?,? |^|\n|, |\b(?:D|A|CH)-)(?P<id>[0-9]{4,5})(?= [A-ZÄÖÜ][a-zäöüß]+)"),
    re.compile(r"(?<!\w)(?P<id>[1-9][0-9]{3} ?[A-Z]{2})(?= [A-Z][a-z]+)"),
    re.compile(r"(?<!\w)(?P<id>[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2})(?=\s*(?:\n|$|,))"),
]


def postal_codes(text: str) -> Iterator[tuple[int, int]]:
    seen = set()
    for pattern in _POSTAL:
        for m in pattern.finditer(text):
            if m.span("id") not in seen:
                seen.add(m.span("id"))
                yield m.span("id")


#: Common given names: without an entity model, names are a given name with up to two capitalised words after it.
GIVEN_NAMES = frozenset(
    "Alexander Alice Andrea Andreas Anna Anne Anton Barbara Bernd Birgit Carlos Carmen Charles Charlotte Christian Christina Claudia Daniel David Elena Elisabeth Elizabeth Emily Emma Erik Eva Felix Frank Franz Gabriele George Hans Heike Helga Henry Ingrid Isabel Jack James Jan Jane Jean Jennifer Jens Jessica Johann Johanna John Jonas José Joseph Juan Julia Jürgen Karin Karl Katharina Klaus Laura Lena Lisa Louise Lucas Luis Lukas Manfred Maria Marie Mario Mark Markus Martin Martina Mary Matthias Max Michael Monika Nicole Nina Olga Oliver Oscar Pablo Patricia Paul Peter Petra Philipp Pierre Rainer Ralf Richard Robert Sabine Sandra Sarah Sebastian Silvia Simon Sofia Sophie Stefan Stefanie Susanne Sven Thomas Tobias Ulrich Ursula Uwe Victoria Walter Werner William Wolfgang".split()
)
_NAME = re.compile(r"(?<!\w)(?P<given>[A-ZÀ-Þ][a-zà-ÿ]+)(?: [A-ZÀ-Þ][a-zà-ÿ]+){1,2}(?!\w)")


def names(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := _NAME.search(text, at):
        if m["given"] in GIVEN_NAMES:
            yield m.span()
            at = m.end()
        else:
            at = m.end("given")
