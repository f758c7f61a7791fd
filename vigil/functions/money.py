"""Monetary amounts: parsing, matching and display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import Text, filled

AMOUNT = rf"(?i)(({L.CURRENCIES})?\s*(\d[\d,]*(?:\.\d+)?)\s*({L.MULTIPLIER_WORDS})?\b)"
WORDED = rf"(?i)\b({'|'.join(L.NUMBER_WORDS)})\s+({L.MULTIPLIER_WORDS})\b"


def _lookup(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, float(v))])


def currency(sign: Column) -> Column:
    s = F.lower(F.trim(sign))
    return F.when(s.isin("$", "usd"), "USD").when(s.isin("€", "eur"), "EUR").when(s == "£", "GBP").otherwise("INR")


def amounts(text: Text) -> Column:
    """array<struct<value, currency, raw>>: numbers with a currency or a multiplier, then amounts in words.

    The text is searched once for each kind; the parts of a match are taken from the match, which is short.
    """
    part = lambda m, p, g: F.regexp_extract(m, p, g)
    times = lambda word: F.try_element_at(_lookup(L.MULTIPLIERS), F.lower(word))
    digits = F.transform(
        F.regexp_extract_all(filled(text), F.lit(AMOUNT), F.lit(1)),
        lambda m: F.struct(
            F.replace(part(m, AMOUNT, 3), F.lit(","), F.lit("")).cast("double") * F.coalesce(times(part(m, AMOUNT, 4)), F.lit(1.0)),
            currency(part(m, AMOUNT, 2)),
            F.trim(m),
            (part(m, AMOUNT, 2) != "") | (part(m, AMOUNT, 4) != ""),
        ),
    )
    worded = F.transform(
        F.regexp_extract_all(filled(text), F.lit(WORDED), F.lit(0)),
        lambda m: F.struct(F.try_element_at(_lookup(L.NUMBER_WORDS), F.lower(part(m, WORDED, 1))) * times(part(m, WORDED, 2)), F.lit("INR"), F.trim(m), F.lit(True)),
    )
    kind = "array<struct<value:double,currency:string,raw:string,counts:boolean>>"
    both = F.filter(F.concat(digits.cast(kind), worded.cast(kind)), lambda a: a["counts"] & (a["value"] > 0))
    return F.transform(both, lambda a: F.struct(a["value"].alias("value"), a["currency"].alias("currency"), a["raw"].alias("raw")))


def largest(parsed: Column) -> Column:
    """The amount of the highest value, the first of equals; null if none."""
    return F.reduce(parsed, F.lit(None).cast("struct<value:double,currency:string,raw:string>"), lambda top, a: F.when(top.isNull() | (a["value"] > top["value"]), a).otherwise(top))


def close_to(a: Column, b: Column, tolerance: float = 0.02) -> Column:
    same = (a["currency"] == b["currency"]) & (a["value"] > 0) & (b["value"] > 0)
    return F.coalesce(same & (F.abs(a["value"] - b["value"]) / F.greatest(a["value"], b["value"]) <= tolerance), F.lit(False))


def rupees(total: Text) -> Column:
    t = F.col(total) if isinstance(total, str) else total
    show = lambda x: F.replace(F.format_number(x, 2), F.lit(".00"), F.lit(""))
    return (
        F.when(F.coalesce(t, F.lit(0.0)) == 0, "")
        .when(t >= 1e7, F.concat(F.lit("₹"), show(t / 1e7), F.lit(" Cr")))
        .when(t >= 1e5, F.concat(F.lit("₹"), show(t / 1e5), F.lit(" Lakh")))
        .otherwise(F.concat(F.lit("₹"), F.format_number(t, 0)))
    )


def core(text: Text) -> Column:
    """For comparing claims: the numeric core without commas, else the trimmed text."""
    number = F.replace(F.regexp_extract(filled(text), r"\d[\d,]*(?:\.\d+)?", 0), F.lit(","), F.lit(""))
    return F.when(number != "", number).otherwise(F.lower(F.trim(filled(text))))
