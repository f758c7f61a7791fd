"""Dates: normalising, age, variants in text, periods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .text import Text, filled


def normalize_date(value: Text) -> Column:
    """ISO date of twelve formats in order; a month is its first day, a year its first; else the value as it was."""
    raw = F.trim(filled(value))
    iso = (F.length(raw) == 10) & (F.substring(raw, 5, 1) == "-") & (F.substring(raw, 8, 1) == "-")
    parsed = [F.date_format(F.try_to_timestamp(raw, F.lit(f)), "yyyy-MM-dd") for f in L.DATE_FORMATS]
    return F.when(iso | (raw == ""), raw).otherwise(F.coalesce(*parsed, raw))


def as_date(value: Text) -> Column:
    return F.try_to_timestamp(normalize_date(value), F.lit("yyyy-MM-dd")).cast("date")


def days_old(published: Text, as_of: Column, unknown: int = 30) -> Column:
    age = F.datediff(as_of, as_date(published))
    return F.when(age.isNull(), unknown).otherwise(F.greatest(F.lit(0), age))


def variants(date: Text) -> Column:
    """How a date may be written in a text, in lower case."""
    return spellings(as_date(date))


def spellings(d: Column) -> Column:
    forms = ["yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "dd/MM/yyyy", "dd-MM-yyyy"]
    return F.array(*[F.lower(F.date_format(d, f)) for f in forms])


def iso_week(ts: Text) -> Column:
    t = F.col(ts) if isinstance(ts, str) else ts
    return F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), t), F.weekofyear(t))


def days_away(date: Text, as_of: Column) -> Column:
    return F.datediff(as_date(date), as_of)
