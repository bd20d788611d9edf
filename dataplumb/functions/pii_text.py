"""Finders that scan rather than match: text with spaces and line breaks folded, bank accounts and cards in groups of any size,
addresses beyond ASCII, device addresses, telephone numbers in national and international form.

Each takes a text and yields (start, end) in characters of that text.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

from .validators import IBAN_LENGTHS

Spans = Iterator[tuple[int, int]]

#: The space separators of Unicode but for the ASCII space.
SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_SPACE = re.compile(f"[{SPACES}]")
_FOLD = re.compile(f"[{SPACES}]|[ \\t]*(?:\\r\\n|\\n|\\r)(?:[ \\t]*(?:\\r\\n|\\n|\\r))*[ \\t]*")
_BREAK = re.compile(r"\r\n|\n|\r")


class Folded:
    """A text in which every Unicode space is an ASCII one and, if lines are joined, so is a line break with the blanks around it.

    Blank lines stay. Places in the folded text are those of the original plus what was taken out before them.
    """

    def __init__(self, text: str, lines: bool = False):
        parts, self._at, self._shift, self.breaks, done, made = [], [0], [0], [], 0, 0
        for m in (_FOLD if lines else _SPACE).finditer(text):
            n = len(_BREAK.findall(m[0])) if lines else 0
            if n > 1:
                continue
            parts += [text[done : m.start()], " "]
            made += m.start() - done + 1
            if n:
                self.breaks.append(made - 1)
            done = m.end()
            if done - made != self._shift[-1]:
                self._at.append(made)
                self._shift.append(done - made)
        self.text = "".join([*parts, text[done:]]) if parts else text

    def original(self, place: int) -> int:
        return place + self._shift[bisect_right(self._at, place) - 1]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """end may be behind a folded run, which doesn't belong to what ends there."""
        return self.original(start), self.original(end - 1) + 1

    def joined(self, start: int, end: int) -> int:
        """How many line breaks are folded inside."""
        return bisect_left(self.breaks, end) - bisect_left(self.breaks, start)


def wrapped(find: Callable[[str], Spans], text: str, known: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What find finds over one line break, beside the known spans of single lines."""
    lines, found = Folded(text, True), []
    for a, b in find(lines.text) if lines.breaks else ():
        if lines.joined(a, b) == 1:
            span = lines.span(a, b)
            if all(span[1] <= x or y <= span[0] for x, y in known):
                found.append(span)
    return found


def iban_ok(value: str) -> bool:
    """Registered country and length, and the check digits."""
    n = re.sub(r"[ -]", "", value).upper()
    return IBAN_LENGTHS.get(n[:2]) == len(n) and n.isascii() and n.isalnum() and int("".join(str(int(c, 36)) for c in n[4:] + n[:4])) % 97 == 1


#: A country, check digits and groups of four with one separator throughout or none, and a shorter last group.
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}([ -]?)[A-Z0-9]{4}(?:\1[A-Z0-9]{4}){1,6}(?:\1[A-Z0-9]{1,3})?\b", re.ASCII)
_COUNTRY = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}")


def ibans(text: str) -> Spans:
    """In regular groups, without the last ones until the check digits fit; then in any groups from a country to its length."""
    known = []
    for m in _IBAN.finditer(text):
        value, separator = m[0], m[1]
        while not iban_ok(value) and separator and separator in value[4:]:
            value = value[: value.rindex(separator)]
        if iban_ok(value):
            known.append((m.start(), m.start() + len(value)))
    yield from known
    ends = [b for _, b in known]
    last = 0
    for m in _COUNTRY.finditer(text):
        start, length = m.start(), IBAN_LENGTHS.get(m[0])
        k = bisect_right(ends, start)
        if length is None or start < last or (k < len(known) and known[k][0] <= start):
            continue
        end = _grouped(text, start, length)
        if end and iban_ok(text[start:end]):
            yield start, end
            last = end


def _grouped(text: str, start: int, length: int) -> int | None:
    """The end of so many capitals and digits from start on, with single separators between some; None if they aren't there or go on."""
    at = count = gaps = 0
    for at in range(start, len(text)):
        if count == length:
            break
        c = text[at]
        if c.isascii() and (c.isdigit() or c.isupper()):
            if (count < 2 and not c.isupper()) or (2 <= count < 4 and not c.isdigit()):
                return None
            count += 1
        elif c in " -" and count and text[at + 1 : at + 2].isascii() and text[at + 1 : at + 2].isalnum():
            gaps += 1
        else:
            return None
    else:
        at = len(text)
    ends = count == length and gaps and not (text[at : at + 1].isascii() and text[at : at + 1].isalnum())
    return at if ends else None


def wrong_ibans(text: str) -> Spans:
    """Of the shape and length of an account, whose check digits don't fit."""
    for m in _IBAN.finditer(text):
        n = re.sub(r"[ -]", "", m[0])
        if IBAN_LENGTHS.get(n[:2]) == len(n) and not iban_ok(m[0]):
            yield m.span()


#: What counts as a letter of an address beyond ASCII; characters of the part before the @, in an address and next to it.
LETTERS = r"\u00c0-\u07ff\u1000-\u1fff\u3000-\uffff"
_ALNUM = f"[A-Za-z0-9{LETTERS}]"
_LABEL = f"{_ALNUM}(?:[A-Za-z0-9{LETTERS}-]{{0,61}}{_ALNUM})?"
_LOCAL = re.compile(f"[A-Za-z0-9{LETTERS}.!$%'*+^_`{{|}}~-]")
_START = re.compile(_ALNUM)
_DOMAIN = re.compile(rf"{_LABEL}(?:\.{_LABEL})*")


def emails(text: str) -> Spans:
    """Around each @: the run of local characters before it from its first letter or digit on, at most 64, and the domain after it."""
    used, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > used and _LOCAL.match(text, start - 1):
            start -= 1
        while start < at and not _START.match(text, start):
            start += 1
        domain = _DOMAIN.match(text, at + 1) if start < at and at - start <= 64 else None
        used = domain.end() if domain else at + 1
        if domain:
            yield start, domain.end()
        at = text.find("@", used)


_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-\Z")
#: Forms of a device address, by pairs, by fours and bare; fours and the bare form have a letter, the bare one a digit too.
_MAC = re.compile(
    r"\b(?:(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b"
    r"|(?=[0-9.]{0,13}[A-Fa-f])(?:[0-9A-Fa-f]{4}\.){2}[0-9A-Fa-f]{4}\b(?!\.[0-9A-Fa-f])"
    r"|(?!\d{9}[Bb]\d{2}\b)(?=[0-9A-Fa-f]{0,11}[A-Fa-f])(?=[A-Fa-f]{0,11}\d)[0-9A-Fa-f]{12}\b)",
    re.ASCII,
)


def macs(text: str) -> Spans:
    for m in _MAC.finditer(text):
        a, b = m.span()
        if "." in m[0] and re.match(r"[0-9A-Fa-f]\.", text[max(a - 2, 0) : a]):
            continue
        if b - a == 12 and _UUID.search(text, max(a - 24, 0), a):
            continue
        yield a, b


#: Forms of telephone numbers. International with + or 00, compact with 00, national with a 0, North American; and one in brackets anywhere.
_PHONE = re.compile(
    r"(?<![A-Za-z0-9+])(?P<intl>(?:\+\d{1,3}|00[1-9]\d{0,2}(?=[ \-./(]))(?:[ \-./]?\(\d{1,4}\)|[ \-./]?\d{1,5}){1,6}"
    r"|00[1-9]\d{6,13}"
    r"|(?:\(0[1-9]\d{1,4}\) ?|0[1-9]\d{1,4}(?: ?/ ?|[ \-]))\d{2,8}(?:[ \-/]\d{1,8}){0,3})(?![A-Za-z0-9+])"
    r"|(?<![A-Za-z0-9+])(?P<american>1[ \-]?\([2-9]\d{2}\)[ \-.]?[2-9]\d{2}[ \-.]?\d{4}|(?:1-)?[2-9]\d{2}-[2-9]\d{2}-\d{4})(?![A-Za-z0-9+])"
    r"|(?P<bracketed>\(\d{3}\)[\s\-.]?\d{3}[\s\-.]?\d{4})",
    re.ASCII,
)
#: Words after which a compact national number is one.
_CALLED = re.compile(
    r"(?<![A-Za-z0-9])(?:telefonnummer|telefon|telefax|tel\.-?nr|tel|mobilnummer|mobiltelefon|mobile|mobil|handynummer|handy|phone|cell|fon|fax)"
    r"(?:\.|-?nr\.?|\s+no\.?|\s+number)?\s*:?\s*(?P<number>0[1-9][0-9]{5,13})(?![0-9A-Za-z])",
    re.IGNORECASE | re.ASCII,
)


def _phone_ok(number: str, judge: Callable[[str], bool | None]) -> bool:
    """7 to 15 digits, 8 behind a 00; a compact 00 number is one only if it isn't known to be none."""
    n = sum(c.isdigit() for c in number)
    if not 7 <= n <= 15 or (number.startswith("00") and n < 10):
        return False
    return not (number.startswith("00") and n == len(number)) or judge("+" + number[2:]) is not False


def _part_of_more(text: str, start: int, end: int) -> bool:
    """Digits or letters go on before the number or behind it."""
    before, previous = text[start - 1 : start], text[start - 2 : start - 1] if start >= 2 else ""
    led = text[start] != "+" and previous.isascii() and ((before == "-" and previous.isalnum()) or (before and before in " \t\n\r/." and previous.isdigit()))
    return led or bool(re.match(r"-[A-Za-z0-9]", text[end : end + 2]))


def phones(text: str, judge: Callable[[str], bool | None] = lambda number: None) -> Spans:
    """judge: whether a number in international form can be one, None where that isn't known."""
    known = []
    for m in _PHONE.finditer(text):
        a, b = m.span()
        if (m["bracketed"] or not _part_of_more(text, a, b)) and _phone_ok(m[0], judge):
            known.append((a, b))
    yield from known
    for m in _CALLED.finditer(text):
        a, b = m.span("number")
        if all(b <= x or y <= a for x, y in known) and _phone_ok(m["number"], judge):
            yield a, b
