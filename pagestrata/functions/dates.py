"""Dates in text, and how old they are."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config

NAMES = "|".join(config.MONTHS)
FIRST_YEAR = 1990


def month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in config.MONTHS.items() for x in pair))
    return F.try_element_at(table, name)


def _made(year: Column, month: Column, day: Column, as_of: Column) -> Column:
    """A date that exists, from the first year on and not beyond next year."""
    y = year.cast("int")
    known = y.between(F.lit(FIRST_YEAR), F.year(as_of) + 1)
    text = F.format_string("%04d-%02d-%02d", y, month.cast("int"), day.cast("int"))
    return F.when(known & month.isNotNull() & (year != ""), F.try_to_date(text, "yyyy-MM-dd"))


def text_date(text: Column, as_of: Column) -> Column:
    """The first date a short text names: ISO, month first, day first, numeric (with dots day first)."""
    t = F.lower(text)
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        t = F.replace(t, F.lit(a), F.lit(b))

    def parts(pattern: str, *order: int) -> list[Column]:
        return [F.nullif(F.regexp_extract(t, pattern, k), F.lit("")) for k in order]

    edge, end = r"(?<![a-z0-9_])", r"(?![a-z0-9_])"
    y, m, d = parts(rf"{edge}(\d{{4}})-(\d{{2}})-(\d{{2}}){end}", 1, 2, 3)
    iso = _made(y, m, d, as_of)
    name, d, y = parts(rf"{edge}({NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}}){end}", 1, 2, 3)
    month_first = _made(y, month_number(name), d, as_of)
    d, name, y = parts(rf"{edge}(\d{{1,2}})\.?\s+({NAMES})\.?,?\s+(\d{{4}}){end}", 1, 2, 3)
    day_first = _made(y, month_number(name), d, as_of)
    a, mark, b, y = parts(rf"{edge}(\d{{1,2}})([./])(\d{{1,2}})\2(\d{{4}}){end}", 1, 2, 3, 4)
    dotted = (mark == ".") | (a.cast("int") > 12)
    numeric = F.when(dotted, _made(y, b, a, as_of)).otherwise(_made(y, a, b, as_of))
    return F.coalesce(iso, month_first, day_first, numeric)


def within_last_year(at: Column, as_of: Column) -> Column:
    """Not older than a calendar year, and at most a day ahead."""
    return (at >= as_of - F.expr("INTERVAL 1 YEAR")) & (at <= as_of + F.expr("INTERVAL 1 DAY"))


def age_days(at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0), F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 86400))


def age_bucket(days: Column) -> Column:
    return F.when(days <= 1, "today").when(days <= 60, "days").when(days < 730, "months").otherwise("years")


def iso_day(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd")


def relative_label(at: Column, as_of: Column) -> Column:
    """How long ago: (unit, count)."""
    minutes = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(at)) / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    unit = F.when(minutes < 1, "now").when(minutes < 60, "minutes").when(hours < 24, "hours").otherwise("days")
    n = F.when(minutes < 1, 0).when(minutes < 60, minutes).when(hours < 24, hours).otherwise(F.floor(hours / 24 + 0.5))
    return F.struct(unit.alias("unit"), n.cast("long").alias("n"))
