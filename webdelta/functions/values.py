"""Typed values in block texts: prices, dates, numbers, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency by sign; period by the word that follows the amount.
SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY"}
PERIODS = {
    "mo": "mo", "month": "mo", "monthly": "mo", "yr": "yr", "year": "yr", "yearly": "yr", "annual": "yr", "annually": "yr", "wk": "wk", "week": "wk", "weekly": "wk",
    "day": "day", "daily": "day", "seat": "seat", "seats": "seat", "user": "user", "users": "user",
}
#: A sign, or three capitals and white space; then the whole run of digits, commas and points, and what follows it.
_PRICE = r"^\s*(?:([$€£¥])|([A-Z]{3})[\t\n\f\r ])\s*([\d,.]*\d[\d,.]*)([\s\S]*)$"
_DATE = r"^(?:\d{4}-\d{1,2}-\d{1,2}|\d{4}/\d{1,2}/\d{1,2})$"


def price(text: Column) -> Column:
    """struct(minor, currency, period) of a text that starts with a price, else null. Minor units are hundredths, halves to even.

    An amount that is no number without its commas (1.2.3) makes no price. The period is the first word after the amount,
    behind slashes, spaces and "per"; another word, or one with a comma, gives none.
    """
    sign, code, amount, rest = (F.regexp_extract(text, _PRICE, i) for i in (1, 2, 3, 4))
    currency = code
    for s, c in SIGNS.items():
        currency = F.when(sign == s, c).otherwise(currency)
    word = F.regexp_extract(F.lower(F.trim(F.regexp_replace(rest, "^[/ ]+", ""))), r"^\s*(?:per )?\s*(\S+)", 1)
    period = F.lit(None).cast("string")
    for u, p in PERIODS.items():
        period = F.when(word == u, p).otherwise(period)
    plain = F.replace(amount, F.lit(","), F.lit(""))
    minor = F.bround(F.when(plain.rlike(r"^\d*\.?\d*$"), plain).try_cast("decimal(30,6)") * 100, 0).cast("long")
    return F.when(text.rlike(_PRICE) & minor.isNotNull(), F.struct(minor.alias("minor"), currency.alias("currency"), period.alias("period")))


def first_date(text: Column) -> Column:
    """The first word of the shape year-month-day or year/month/day, as a date; null if that word is none, whatever follows."""
    word = F.get(F.filter(F.split(text, r"(?U)\s+"), lambda w: w.rlike(_DATE)), F.lit(0))
    return F.to_date(F.try_to_timestamp(F.replace(word, F.lit("/"), F.lit("-")), F.lit("yyyy-M-d")))


def date(text: Column) -> Column:
    """first_date() of a text without a masked time."""
    from webdelta.functions.text import TIME_MARK

    return F.when(~F.contains(text, F.lit(TIME_MARK)), first_date(text))


def number(text: Column) -> Column:
    """The exact decimal of a text that is one number, grouping commas removed, as canonical text."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit(""))
    value = F.when(plain.rlike(r"^[+-]?\d+(\.\d+)?$"), plain.try_cast("decimal(38,18)"))
    return F.when(value.isNotNull(), F.regexp_replace(F.regexp_replace(value.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))


def half_up2(x: Column) -> Column:
    """Two decimals of a float, halves up, in float arithmetic."""
    return (F.floor(x.cast("float") * F.lit(100).cast("float") + F.lit(0.5).cast("float")) / F.lit(100)).cast("float")
