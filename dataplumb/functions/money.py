"""Money values: a struct of amount, decimal(18,3), and currency."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Symbol, name, subunits, whether the symbol comes first, decimal mark, thousands mark.
CURRENCIES = {
    "USD": ("$", "United States Dollar", 100, True, ".", ","),
    "EUR": ("€", "Euro", 100, False, ",", "."),
    "GBP": ("£", "British Pound", 100, True, ".", ","),
    "JPY": ("¥", "Japanese Yen", 1, True, ".", ","),
    "CAD": ("$", "Canadian Dollar", 100, True, ".", ","),
    "AUD": ("$", "Australian Dollar", 100, True, ".", ","),
    "CHF": ("CHF", "Swiss Franc", 100, False, ".", "'"),
    "CNY": ("¥", "Chinese Yuan", 100, True, ".", ","),
    "INR": ("₹", "Indian Rupee", 100, True, ".", ","),
    "BRL": ("R$", "Brazilian Real", 100, True, ",", "."),
    "PLN": ("zł", "Polish Złoty", 100, False, ",", " "),
    "SEK": ("kr", "Swedish Krona", 100, False, ",", " "),
    "DKK": ("kr.", "Danish Krone", 100, False, ",", "."),
    "NOK": ("kr", "Norwegian Krone", 100, False, ",", " "),
    "CZK": ("Kč", "Czech Koruna", 100, False, ",", " "),
    "HUF": ("Ft", "Hungarian Forint", 100, False, ",", " "),
    "RON": ("lei", "Romanian Leu", 100, False, ",", "."),
    "BGN": ("лв.", "Bulgarian Lev", 100, False, ",", " "),
    "ISK": ("kr.", "Icelandic Króna", 1, False, ",", "."),
    "TRY": ("₺", "Turkish Lira", 100, True, ",", "."),
    "RUB": ("₽", "Russian Ruble", 100, False, ",", " "),
    "UAH": ("₴", "Ukrainian Hryvnia", 100, False, ",", " "),
    "NZD": ("$", "New Zealand Dollar", 100, True, ".", ","),
    "SGD": ("$", "Singapore Dollar", 100, True, ".", ","),
    "HKD": ("$", "Hong Kong Dollar", 100, True, ".", ","),
    "KRW": ("₩", "South Korean Won", 1, True, ".", ","),
    "MXN": ("$", "Mexican Peso", 100, True, ".", ","),
    "ZAR": ("R", "South African Rand", 100, True, ".", ","),
    "ILS": ("₪", "Israeli New Shekel", 100, True, ".", ","),
    "AED": ("د.إ", "United Arab Emirates Dirham", 100, True, ".", ","),
    "SAR": ("ر.س", "Saudi Riyal", 100, True, ".", ","),
    "THB": ("฿", "Thai Baht", 100, True, ".", ","),
    "IDR": ("Rp", "Indonesian Rupiah", 100, True, ",", "."),
    "MYR": ("RM", "Malaysian Ringgit", 100, True, ".", ","),
    "PHP": ("₱", "Philippine Peso", 100, True, ".", ","),
    "TWD": ("NT$", "New Taiwan Dollar", 100, True, ".", ","),
    "KWD": ("د.ك", "Kuwaiti Dinar", 1000, True, ".", ","),
    "BHD": ("ب.د", "Bahraini Dinar", 1000, True, ".", ","),
}
MOST = "999999999999999.999"
AMOUNT = "decimal(18,3)"


def _code(c: Column | str) -> Column:
    return F.upper(F.trim(F.lit(c) if isinstance(c, str) else c))


def _by_code(code: Column, place: int) -> Column:
    entries = [x for k, v in CURRENCIES.items() for x in (F.lit(k), F.lit(v[place]))]
    return F.try_element_at(F.create_map(*entries), code)


def is_valid_currency(c: Column) -> Column:
    return _code(c).isin(list(CURRENCIES))


def currency_symbol(c: Column) -> Column:
    return _by_code(_code(c), 0)


def currency_name(c: Column) -> Column:
    return _by_code(_code(c), 1)


def _checked(amount: Column, code: Column) -> Column:
    out = amount.try_cast(AMOUNT)
    good = F.when(out.isNull() | (F.abs(out) > F.lit(MOST).cast(AMOUNT)), F.raise_error(F.lit("money amount out of range")).cast(AMOUNT)).otherwise(out)
    return F.struct(good.alias("amount"), code.alias("currency"))


def money(amount: Column, currency: Column | str) -> Column:
    """Rounded half away from zero to three places; an unknown currency is an error, null in gives null out."""
    code = _code(currency)
    known = F.when(code.isin(list(CURRENCIES)), code).otherwise(F.raise_error(F.concat(F.lit("unknown currency: "), code)).cast("string"))
    return F.when(amount.isNotNull() & code.isNotNull(), _checked(F.round(amount.cast("decimal(38,9)"), 3), known))


def money_from_cents(cents: Column, currency: Column | str) -> Column:
    units = _by_code(_code(currency), 2)
    return money(cents.cast("decimal(38,3)") / units.cast("decimal(10,0)"), currency)


def money_amount(m: Column) -> Column:
    return m["amount"]


def money_currency(m: Column) -> Column:
    return m["currency"]


def _pair(a: Column, b: Column, amount: Column) -> Column:
    clash = F.raise_error(F.concat(F.lit("currencies differ: "), a["currency"], F.lit(" and "), b["currency"])).cast("string")
    code = F.when(a["currency"] == b["currency"], a["currency"]).otherwise(clash)
    return F.when(a.isNotNull() & b.isNotNull(), _checked(amount, code))


def money_add(a: Column, b: Column) -> Column:
    return _pair(a, b, a["amount"] + b["amount"])


def money_subtract(a: Column, b: Column) -> Column:
    return _pair(a, b, a["amount"] - b["amount"])


@F.pandas_udf(T.DecimalType(18, 3))
def _times(amount: pd.Series, factor: pd.Series) -> pd.Series:
    def one(a, f):
        if a is None or f is None or f != f:
            return None
        return (a * Decimal(f)).quantize(Decimal("0.001"), ROUND_HALF_UP)

    return pd.Series([one(a, f) for a, f in zip(amount, factor, strict=True)], dtype=object)


def money_multiply(m: Column, factor: Column) -> Column:
    """Exact in decimal, rounded half away from zero; a factor that isn't finite is an error."""
    f = factor.cast("double")
    finite = F.when(F.isnan(f) | (F.abs(f) == float("inf")), F.raise_error(F.lit("factor must be finite")).cast("double")).otherwise(f)
    return F.when(m.isNotNull() & factor.isNotNull(), _checked(_times(m["amount"], finite), m["currency"]))


def money_abs(m: Column) -> Column:
    return F.when(m.isNotNull(), F.struct(F.abs(m["amount"]).alias("amount"), m["currency"].alias("currency")))


def money_is_positive(m: Column) -> Column:
    return m["amount"] > 0


def money_is_negative(m: Column) -> Column:
    return m["amount"] < 0


def money_is_zero(m: Column) -> Column:
    return m["amount"] == 0


def money_in_range(m: Column, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Compared as doubles; a null bound is none; NaN or low above high is an error."""
    a, b = (F.lit(x).cast("double") if not isinstance(x, Column) else x.cast("double") for x in (low, high))
    bad = F.coalesce(F.isnan(a), F.lit(False)) | F.coalesce(F.isnan(b), F.lit(False)) | F.coalesce(a > b, F.lit(False))
    v = m["amount"].cast("double")
    inside = F.coalesce(v >= a, F.lit(True)) & F.coalesce(v <= b, F.lit(True))
    return F.when(bad, F.raise_error(F.lit("bad range")).cast("boolean")).when(m.isNotNull(), inside)


def money_same_currency(a: Column, b: Column) -> Column:
    return a["currency"] == b["currency"]


def money_format(m: Column, style: str = "symbol") -> Column:
    """symbol: with the symbol where it belongs; long: with the name; code: with the code."""
    style = style.strip().lower()
    if style not in ("symbol", "long", "code"):
        raise ValueError("style must be 'symbol', 'long' or 'code'")
    amount, code = m["amount"], m["currency"]
    units = _by_code(code, 2)
    places = F.when(units == 1, 0).when(units == 1000, 3).otherwise(2)
    plain = F.when(places == 0, F.format_number(F.abs(amount), 0)).when(places == 3, F.format_number(F.abs(amount), 3)).otherwise(F.format_number(F.abs(F.round(amount, 2)), 2))
    # format_number writes 1,234.56; its marks become the currency's own.
    whole = F.replace(F.substring_index(plain, ".", 1), F.lit(","), _by_code(code, 5))
    text = F.when(places == 0, whole).otherwise(F.concat(whole, _by_code(code, 4), F.substring_index(plain, ".", -1)))
    sign = F.when(amount < 0, "-").otherwise("")
    if style == "code":
        return F.concat(sign, text, F.lit(" "), code)
    if style == "long":
        return F.concat(sign, text, F.lit(" "), _by_code(code, 1))
    symbol = _by_code(code, 0)
    return F.when(_by_code(code, 3), F.concat(sign, symbol, text)).otherwise(F.concat(sign, text, F.lit(" "), symbol))
