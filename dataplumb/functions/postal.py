"""Postal addresses by rules, without training data: an approximation, flagged as such by postal_status().

Addresses are taken apart at commas and line ends. Parts are in small letters. Null gives null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Countries by the names that addresses end with.
COUNTRIES = ("germany", "deutschland", "austria", "österreich", "switzerland", "schweiz", "france", "italy", "italia", "spain", "españa", "netherlands", "belgium", "united kingdom", "uk", "england", "united states", "usa", "canada")
#: What short forms of road words stand for.
ROADS = {"st": "street", "rd": "road", "ave": "avenue", "blvd": "boulevard", "ln": "lane", "dr": "drive", "sq": "square", "ct": "court", "hwy": "highway", "pl": "place"}
_CODE = r"(?:(?:d|a|ch)-)?([0-9]{4,5}|[0-9]{4} ?[a-z]{2})"
_UK = r"[a-z]{1,2}[0-9][0-9a-z]? ?[0-9][a-z]{2}"
_US = r"^(?:(.+) )?([a-z]{2}) ([0-9]{5}(?:-[0-9]{4})?)$"


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def postal_parse_address(text: Column) -> Column:
    """struct(house_number, road, city, state, postcode, country)."""
    parts = F.filter(F.transform(F.split(F.lower(text), "[,\n]"), lambda p: F.trim(p)), lambda p: F.length(p) > 0)

    def taken(p: Column) -> Column:
        country = F.when((F.size(p) > 1) & F.element_at(p, -1).isin(*COUNTRIES), F.element_at(p, -1))
        p = F.when(country.isNotNull(), F.slice(p, 1, F.size(p) - 1)).otherwise(p)
        return F.struct(country.alias("country"), F.get(p, F.lit(0)).alias("first"), F.when(F.size(p) > 1, F.slice(p, 2, F.size(p))).otherwise(F.array().cast("array<string>")).alias("rest"))

    def read(x: Column) -> Column:
        before, after = r"^([0-9]+[a-z]?(?:-[0-9]+)?) (.+)$", r"^(.+?) ([0-9]+ ?[a-z]?(?:-[0-9]+)?)$"
        first, rest = x["first"], F.array_join(x["rest"], " ")
        house = F.coalesce(_part(first, before, 1), _part(first, after, 2))
        road = F.coalesce(_part(first, before, 2), _part(first, after, 1), first)
        ahead, behind = rf"^{_CODE} (.+)$", rf"^(?:(.+) )?({_UK})$"
        code = F.coalesce(_part(rest, _US, 3), _part(rest, behind, 2), _part(rest, ahead, 1), _part(rest, rf"^{_CODE}$", 1))
        city = F.coalesce(F.when(rest.rlike(_US), _part(rest, _US, 1)), F.when(rest.rlike(behind), _part(rest, behind, 1)), _part(rest, ahead, 2), F.when(code.isNull(), F.nullif(rest, F.lit(""))))
        return F.struct(house.alias("house_number"), road.alias("road"), city.alias("city"), _part(rest, _US, 2).alias("state"), code.alias("postcode"), x["country"].alias("country"))

    return F.when(text.isNotNull(), F.transform(F.transform(F.array(parts), taken), read)[0])


def postal_expand_address(text: Column) -> Column:
    """The text in small letters with short forms written out, and with umlauts spelled in two letters where that differs."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[,\s]+", " "), r"str\.(?=\s|$)", "straße"))
    for short, long in ROADS.items():
        out = F.regexp_replace(out, rf"(?<=\s){short}\.?(?=\s|$)", long)
    spelled = out
    for a, b in {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.items():
        spelled = F.replace(spelled, F.lit(a), F.lit(b))
    return F.when(text.isNotNull(), F.array_distinct(F.array(out, spelled)))


def postal_load_data() -> bool:
    """There is nothing to load: False."""
    return False


def postal_status() -> DataFrame:
    return SparkSession.getActiveSession().createDataFrame([(True, False, None, "approximate")], "initialized boolean, data_present boolean, data_dir string, method string")
