"""Detecting and masking personal data in text: patterns with validators, as Arrow functions.

All 22 types are there. NAME goes by a list of given names, with a confidence of 0.5; ORGANIZATION, LOCATION and MISC find nothing
without an entity model (see Entities). POSTAL_CODE is looked for only where it is named. Positions are bytes of the UTF-8 text. Overlaps
go to the earlier, then the longer match, then the earlier type, patterns before names; a URL without a user that holds an email address
is not a match beside EMAIL. Spaces of Unicode count as ASCII ones; card numbers and IBANs may span one line break. Which types, from
what confidence on, whether check digits must fit and how to mask without being told are settings (config.py).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .._base import Relation, column_name, column_names, quoted, relation
from .._tables import spread, stored
from ..config import Config, active
from . import phone, pii_kinds, pii_text


def _digits(v: str) -> str:
    return re.sub(r"[^0-9]", "", v)


def _luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def _card(v: str) -> bool:
    return 13 <= len(_digits(v)) <= 19 and _luhn(_digits(v)) and _digits(v)[0] in "23456"


def _tax_id(v: str) -> bool:
    d, p = _digits(v), 10
    times = sorted((d[:10].count(c) for c in set(d[:10])), reverse=True)
    if len(d) != 11 or d[0] == "0" or times[0] not in (2, 3) or times[1] > 1:
        return False
    for c in d[:10]:
        p = ((int(c) + p) % 10 or 10) * 2 % 11
    return (11 - p) % 10 == int(d[10])


def _may_be_number(number: str) -> bool | None:
    return phone.parse(number, None)["valid"]


def _ip(v: str) -> bool:
    return all(int(x) <= 255 for x in v.split("."))


def _is_ipv6(v: str) -> bool:
    """Eight groups, one :: for some of them, an IPv4 address for the last two; one decimal digit at least (a::b is code)."""
    if ":::" in v or v.count("::") > 1 or not re.search("[0-9]", v):
        return False
    parts = [p for side in v.split("::") if side for p in side.split(":")]
    groups = len(parts)
    if parts and "." in parts[-1]:
        if not re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", parts[-1]) or not _ip(parts[-1]) or v.endswith("::"):
            return False
        parts, groups = parts[:-1], groups + 1
    return all(re.fullmatch("[0-9A-Fa-f]{1,4}", p) for p in parts) and (1 <= groups <= 7 if "::" in v else groups == 8)


def _ipv6(text: str) -> list[tuple[int, int]]:
    """(start, end) of the IPv6 addresses, with their zones; label colons and full stops beside them are left out."""
    found, at = [], 0
    if text.count(":") < 2:
        return found
    while m := _IPV6_RUN.search(text, at):
        (a, b), at = m.span(), m.end()
        run_end = b
        if m[0].count(":") < 2:
            continue
        if text[a] == ":" and text[a + 1] != ":":
            a += 1
        elif a and _ASCII_WORD.match(text, a - 1):
            continue
        while b > a and text[b - 1] == ".":
            b -= 1
        if b - a >= 2 and text[b - 1] == ":" and text[b - 2] != ":":
            b -= 1
        if _ASCII_WORD.match(text, run_end) or not _is_ipv6(text[a:b]):
            continue
        if b == run_end and (zone := _ZONE.match(text, b)):
            b = at = zone.end()
        found.append((a, b))
    return found


_IPV6_RUN, _ASCII_WORD, _ZONE = re.compile("[0-9A-Fa-f:.]{2,}"), re.compile("[A-Za-z0-9_]"), re.compile("%[A-Za-z0-9_.-]+")

#: Types in order, each with its pattern and validator.
TYPES = {
    "EMAIL": (pii_text.emails, None),
    "CREDIT_CARD": (re.compile(r"(?<![0-9.-])[0-9](?:[ .-]?[0-9]){12,18}(?![0-9-])"), _card),
    "US_SSN": (re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}([- ])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9-])"), None),
    "IBAN": (pii_text.ibans, None),
    "DE_TAX_ID": (re.compile(r"(?<![0-9])[0-9]{11}(?![0-9])"), _tax_id),
    "IP_ADDRESS": (re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"), _ip),
    "URL": (re.compile(r"\b(?:https?|ftps?)://[^\s<>\"']+[^\s<>\"'.,;:!?)]", re.IGNORECASE), None),
    "MAC_ADDRESS": (pii_text.macs, None),
    "UK_NINO": (re.compile(r"\b(?!BG|GB|NK|KN|TN|NT|ZZ)[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z] ?[0-9]{2} ?[0-9]{2} ?[0-9]{2} ?[A-D]\b"), None),
    "US_PASSPORT": (re.compile(r"(?<![A-Za-z0-9])[A-Za-z][0-9]{8}(?![A-Za-z0-9])"), None),
    "PHONE": (lambda text: pii_text.phones(text, _may_be_number), None),
    "CRYPTO_ADDRESS": (pii_kinds.crypto_addresses, None),
    "API_KEY": (pii_kinds.api_keys, None),
    "DATE_OF_BIRTH": (pii_kinds.births, None),
    "DE_SVNR": (pii_kinds.pension_numbers, None),
    "DE_KVNR": (pii_kinds.health_numbers, None),
    "DE_ID_CARD": (pii_kinds.id_cards, None),
    "POSTAL_CODE": (pii_kinds.postal_codes, None),
    "NAME": (pii_kinds.names, None),
    "ORGANIZATION": (lambda text: (), None),
    "LOCATION": (lambda text: (), None),
    "MISC": (lambda text: (), None),
}
#: Other names of types; types that are looked for only where they are named; those of an entity model.
ALIASES = {"CREDITCARD": "CREDIT_CARD", "CC": "CREDIT_CARD", "SSN": "US_SSN", "IP": "IP_ADDRESS", "STEUER_ID": "DE_TAX_ID", "GERMAN_TAX_ID": "DE_TAX_ID", "PERSON": "NAME", "PERSON_NAME": "NAME", "ORG": "ORGANIZATION", "COMPANY": "ORGANIZATION", "LOC": "LOCATION", "PLACE": "LOCATION", "GEO": "LOCATION", "MISCELLANEOUS": "MISC", "OTHER": "MISC", "PASSPORT": "US_PASSPORT", "CRYPTO": "CRYPTO_ADDRESS", "NINO": "UK_NINO", "MAC": "MAC_ADDRESS", "APIKEY": "API_KEY", "KEY": "API_KEY", "DOB": "DATE_OF_BIRTH", "BIRTH_DATE": "DATE_OF_BIRTH", "SVNR": "DE_SVNR", "RVNR": "DE_SVNR", "KVNR": "DE_KVNR", "KRANKENVERSICHERTENNUMMER": "DE_KVNR", "PERSONALAUSWEIS": "DE_ID_CARD", "POSTCODE": "POSTAL_CODE", "ZIP": "POSTAL_CODE", "PLZ": "POSTAL_CODE"}
ON_REQUEST = ("POSTAL_CODE",)
#: Types whose check digits keep unrelated numbers on two lines apart: found over a line break too.
WRAPPED = ("IBAN", "CREDIT_CARD")
#: What isn't sure: names without a model, and values whose check digits fail, where these are asked for.
NAME_CONFIDENCE, FAILED_CONFIDENCE = 0.5, 0.6
ENTITIES = ("NAME", "ORGANIZATION", "LOCATION", "MISC")
DEFAULT_TYPES = tuple(t for t in TYPES if t not in ON_REQUEST)
#: An entity model: a text to (type, start, end, confidence) in characters. None is built in.
Entities = Callable[[str], list[tuple[str, int, int, float]]]
#: Texts without any of these hold nothing but names.
_MARK = re.compile(r"[0-9@:]")
MATCH = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()), T.StructField("confidence", T.DoubleType())]))
STRATEGIES = ("redact", "asterisk", "hash", "partial", "none")


def _spans(name: str, text: str) -> list[tuple[int, int]]:
    """Of one type in a text with ASCII spaces."""
    pattern, valid = TYPES[name]
    found = list(pattern(text)) if callable(pattern) else [m.span() for m in pattern.finditer(text) if valid is None or valid(m[0])]
    return found + _ipv6(text) if name == "IP_ADDRESS" else found


def _failed(name: str, text: str) -> list[tuple[int, int]]:
    """Of the shape of a type whose check digits don't fit."""
    if name == "IBAN":
        return list(pii_text.wrong_ibans(text))
    if name == "CREDIT_CARD":
        return [m.span() for m in TYPES[name][0].finditer(text) if not _card(m[0]) and 13 <= len(_digits(m[0])) <= 19 and _digits(m[0])[0] in "3456"]
    return []


def matches(text: str, types: tuple[str, ...] | None = None, config: Config | None = None) -> list[tuple[str, int, int]]:
    """(type, start, end) in characters, without overlaps."""
    return [(name, a, b) for name, a, b, _ in judged(text, types, config)]


def judged(text: str, types: tuple[str, ...] | None = None, config: Config | None = None) -> list[tuple[str, int, int, float]]:
    """matches with their confidence. Types given go before the enabled ones of the settings."""
    config = config or Config()
    chosen = types or config.pii_enabled_types or DEFAULT_TYPES
    plain, found = pii_text.Folded(text), []
    for order, name in enumerate(TYPES):
        if name not in chosen or (name not in ENTITIES and not _MARK.search(text)):
            continue
        late, sure = name in ENTITIES, NAME_CONFIDENCE if name == "NAME" else 1.0
        spans = [plain.span(*s) for s in _spans(name, plain.text)]
        if name in WRAPPED:
            spans += pii_text.wrapped(lambda t, name=name: _spans(name, t), text, spans)
        if name == "CREDIT_CARD" and spans and "IBAN" not in chosen:
            # Where both are looked for, the account goes before its own digits: it does so where cards are looked for alone.
            accounts = [plain.span(*s) for s in _spans("IBAN", plain.text)]
            accounts += pii_text.wrapped(lambda t: _spans("IBAN", t), text, accounts)
            spans = [(a, b) for a, b in spans if not any(x <= a and b <= y for x, y in accounts)]
        spans = [(*s, sure) for s in spans]
        if not config.pii_require_checksum:
            taken = [plain.span(*s) for s in _failed(name, plain.text)]
            spans += [(a, b, FAILED_CONFIDENCE) for a, b in taken if all(b <= x or y <= a for x, y, _ in spans)]
        found += [(late, a, -b, order, name, c) for a, b, c in spans if c >= config.pii_min_confidence]
    emails = [(f[1], -f[2]) for f in found if f[4] == "EMAIL"]
    if emails:
        whole = lambda a, b: "@" not in re.split("[/?#]", text[a:b].split("://", 1)[-1], maxsplit=1)[0] and any(a <= x and y <= b for x, y in emails)
        found = [f for f in found if f[4] != "URL" or not whole(f[1], -f[2])]
    taken: list[tuple[int, int, str, float]] = []
    end = 0
    for late, a, b, _, name, sure in sorted(found):
        if late:
            if all(y <= a or -b <= x for x, y, _, _ in taken):
                taken.append((a, -b, name, sure))
        elif a >= end:
            taken.append((a, -b, name, sure))
            end = -b
    return [(name, a, b, sure) for a, b, name, sure in sorted(taken)]


def _partial(name: str, v: str) -> str:
    """At most half of the letters and digits stay."""
    n = sum(c.isalnum() for c in v)
    if name == "EMAIL":
        local, _, domain = v.partition("@")
        host, _, top = domain.rpartition(".")
        masked = local[:1] + "*" * (len(local) - 1) + "@" + re.sub("[^.]", "*", host) + "." + top
    elif name == "CREDIT_CARD":
        d = _digits(v)
        head = d[:4] if len(d) >= 16 else ""
        masked = head + "*" * (len(d) - len(head) - 4) + d[-4:]
    elif name == "PHONE":
        d = _digits(v)
        masked = ("+" if v.startswith("+") else "") + "***-***-" + (d[-4:] if len(d) >= 8 else "*" * min(4, len(d)))
    elif name == "US_SSN":
        masked = "***-**-" + v[-4:]
    elif name == "IP_ADDRESS" and ":" in v:
        first, _, rest = v.partition(":")
        masked = first + ":" + re.sub("[0-9A-Za-z]", "*", rest)
    elif name == "IP_ADDRESS":
        first, *rest = v.split(".")
        masked = ".".join([first, *("*" * len(r) for r in rest)])
    elif n <= 4:
        masked = "*" * len(v)
    else:
        keep = 2 if n >= 8 else 1
        masked = v[:keep] + "*" * (len(v) - 2 * keep) + v[-keep:]
    return masked if 2 * sum(c.isalnum() for c in masked) <= n else "*" * len(v)


def masked_value(v: str, name: str, strategy: str) -> str:
    if name in WRAPPED and strategy in ("hash", "partial"):
        # A value over two lines is the one that it is on one.
        v = pii_text.Folded(v, True).text
    if strategy == "redact":
        return f"[{name}]"
    if strategy == "asterisk":
        return "*" * len(v)
    if strategy == "hash":
        return hashlib.sha256(v.encode()).hexdigest()[:16]
    return v if strategy == "none" else _partial(name, v)


def _strategy(strategy: str | None, config: Config) -> str:
    name = (strategy or config.pii_default_mask_strategy).strip().lower()
    return name if name in STRATEGIES else "redact"


def _looked_at(text: Column, types: tuple[str, ...] | None, config: Config) -> Column:
    """Whether a text can hold a match: others never leave the JVM."""
    chosen = types or config.pii_enabled_types or DEFAULT_TYPES
    mark = text.rlike("[0-9@:]") if any(t not in ENTITIES for t in chosen) else F.lit(False)
    return mark | text.rlike(_GIVEN) if "NAME" in chosen else mark


_GIVEN = r"(?<!\w)(?:" + "|".join(sorted(pii_kinds.GIVEN_NAMES)) + r") \p{Lu}"


def _types(types) -> tuple[str, ...] | None:
    if types is None:
        return None
    names = tuple(ALIASES.get(t.strip().upper(), t.strip().upper()) for t in ([types] if isinstance(types, str) else types))
    if unknown := [t for t in names if t not in TYPES]:
        raise ValueError(f"unknown type(s): {', '.join(unknown)}")
    return names


def _found(t: str | None, chosen: tuple[str, ...] | None, config: Config) -> list[dict] | None:
    if t is None:
        return None
    out, done, octets = [], 0, 0
    for n, a, b, sure in judged(t, chosen, config):
        octets += len(t[done:a].encode())
        start, done = octets, b
        octets += len(t[a:b].encode())
        out.append({"type": n, "text": t[a:b], "start_pos": start, "end_pos": octets, "confidence": sure})
    return out


def pii_detect(text: Column, types=None, config: Config | None = None) -> Column:
    """The matches in a text; types None: those of the settings. config None: the session's settings."""
    chosen, config = _types(types), config or active()

    @F.pandas_udf(MATCH)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _found(t, chosen, config))

    look = _looked_at(text, chosen, config)
    return F.when(text.isNull(), None).when(look, run(F.when(look, text))).otherwise(F.array().cast(MATCH))


def pii_detect_batch(texts: Column, types=None, config: Config | None = None) -> Column:
    """For an array of texts the matches of each; null for a null text."""
    chosen, config = _types(types), config or active()

    @F.pandas_udf(T.ArrayType(MATCH))
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: None if ts is None else [_found(t, chosen, config) for t in ts])

    return run(texts)


def pii_detect_emails(text: Column) -> Column:
    return pii_detect(text, "EMAIL")


def pii_detect_phones(text: Column) -> Column:
    return pii_detect(text, "PHONE")


def pii_detect_credit_cards(text: Column) -> Column:
    return pii_detect(text, "CREDIT_CARD")


def pii_detect_ssns(text: Column) -> Column:
    return pii_detect(text, "US_SSN")


def pii_detect_ibans(text: Column) -> Column:
    return pii_detect(text, "IBAN")


def pii_detect_names(text: Column) -> Column:
    return pii_detect(text, "NAME")


def pii_is_valid_crypto_address(value: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else pii_kinds.is_crypto_address(v))

    return run(value)


def pii_mask(text: Column, strategy: str | None = None, types=None, config: Config | None = None) -> Column:
    """The text with its matches masked; strategy None: that of the settings."""
    config = config or active()
    chosen, how = _types(types), _strategy(strategy, config)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            out, at = [], 0
            for n, a, b in matches(t, chosen, config):
                out += [t[at:a], masked_value(t[a:b], n, how)]
                at = b
            return "".join([*out, t[at:]])

        return s.map(one)

    look = _looked_at(text, chosen, config)
    return F.when(look, run(F.when(look, text))).otherwise(text)


def pii_mask_column(text: Column, kind: str, strategy: str | None = None) -> Column:
    return pii_mask(text, strategy, kind)


def pii_redact_column(text: Column, strategy: str | None = None) -> Column:
    return pii_mask(text, strategy)


def pii_mask_value(value: Column, kind: str, strategy: str | None = None) -> Column:
    """The whole value as one match."""
    name, how = _types(kind)[0], _strategy(strategy, active())

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else masked_value(v, name, how))

    return run(value)


def pii_count(text: Column) -> Column:
    return F.when(text.isNotNull(), F.size(pii_detect(text)).cast("long"))


def pii_contains(text: Column) -> Column:
    return pii_count(text) > 0


def pii_scan_table(table: Relation, columns: str | list[str] | None = None) -> DataFrame:
    """Matches by column and type with the five smallest values as samples; columns that aren't text as skipped.

    Texts are looked through when this is called, in tasks of about as many texts each.
    """
    df = relation(table)
    names = column_names(df, columns) if columns else df.columns
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    rows = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(quoted(c)).alias("v")) for c in texts))).alias("x")).select("x.*").where("v is not null") if texts else df.sparkSession.createDataFrame([], "column_name string, v string")
    found = spread(rows).select("column_name", F.explode_outer(pii_detect(F.col("v"))).alias("m"))
    counts = rows.groupBy("column_name").agg(F.count("*").alias("values_scanned"))
    # By distinct value first, so that samples are bounded whatever the number of values.
    values = found.where("m is not null").groupBy("column_name", F.col("m.type").alias("pii_type"), F.col("m.text").alias("t")).agg(F.count("*").alias("c"))
    # Stored, so that texts are looked through once for samples, totals and columns without a match.
    values = stored(values, "pii_values")
    key = ["column_name", "pii_type"]
    # The filter on the row number keeps five rows of each group before they are sorted anywhere.
    samples = values.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy("t"))).where("nth <= 5").groupBy(*key).agg(F.array_sort(F.collect_list("t")).alias("sample_values"))
    totals = values.groupBy(*key).agg(F.sum("c").alias("match_count"))
    checked, model = F.array(*map(F.lit, DEFAULT_TYPES)), F.lit("none")
    sure = F.when(F.col("pii_type") == "NAME", NAME_CONFIDENCE).otherwise(1.0)
    out = totals.join(samples, key).join(counts, "column_name").select(*key, "match_count", "sample_values", sure.alias("confidence"), "values_scanned", F.lit("found").alias("status"), checked.alias("checked_types"), model.alias("ner_model"))
    nothing = F.array().cast("array<string>")
    every = df.sparkSession.createDataFrame([(c,) for c in texts], "column_name string").join(counts, "column_name", "left").join(totals.select("column_name").distinct(), "column_name", "left_anti")
    blank = every.select("column_name", F.lit(None).cast("string").alias("pii_type"), F.lit(0).cast("long").alias("match_count"), nothing.alias("sample_values"), F.lit(None).cast("double").alias("confidence"), F.coalesce("values_scanned", F.lit(0)).cast("long").alias("values_scanned"), F.when(F.col("values_scanned") > 0, "no_match (NER unavailable)").otherwise("no_values").alias("status"), checked.alias("checked_types"), model.alias("ner_model"))
    skipped = [(c, None, 0, [], None, 0, f"skipped ({df.schema[c].dataType.simpleString()})", None, None) for c in names if c not in texts]
    schema = "column_name string, pii_type string, match_count long, sample_values array<string>, confidence double, values_scanned long, status string, checked_types array<string>, ner_model string"
    return out.union(blank).union(df.sparkSession.createDataFrame(skipped, schema)).orderBy(*key)


def pii_audit_table(table: Relation, columns: str | list[str] | None = None, strategy: str | None = None, id_column: str | None = None) -> DataFrame:
    """One row for each match: where it stands, the value, the value masked, and the matched text. Null values have none."""
    from .._base import with_row_ids

    df = relation(table)
    names = column_names(df, columns) if columns else df.columns
    texts = [c for c in names if isinstance(df.schema[c].dataType, T.StringType)]
    ids = [F.col(quoted(column_name(df, id_column))).alias("id")] if id_column else []
    rows = with_row_ids(df.select(*ids, *(F.col(quoted(c)).alias(f"v{k}") for k, c in enumerate(texts))))
    kept = ["row_id", *(["id"] if id_column else [])]
    stacked = rows.select(*kept, F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"v{k}").alias("v")) for k, c in enumerate(texts)))).alias("x")).select(*kept, "x.*").where("v is not null")
    # Masked before matches are rows, so that each value is masked once.
    judged_once = spread(stacked).select(*kept, "column_name", F.col("v").alias("original_value"), pii_mask(F.col("v"), strategy).alias("masked_value"), pii_detect(F.col("v")).alias("ms"))
    found = judged_once.select(*kept, "column_name", "original_value", "masked_value", F.explode("ms").alias("m"))
    return found.select(*kept, "column_name", F.col("m.type").alias("pii_type"), "original_value", "masked_value", F.col("m.start_pos").alias("start_pos"), F.col("m.end_pos").alias("end_pos"), F.col("m.confidence").alias("confidence"), F.col("m.text").alias("matched_text"))
