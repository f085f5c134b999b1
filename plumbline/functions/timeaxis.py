"""Dates and period keys as Column expressions; period ranges on the driver."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

GRAINS = ("day", "week", "month", "quarter", "year")
# Accepted date shapes, as (pattern, Spark format); the first that matches decides.
ISO_SHAPES = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2})?", "yyyy-MM-dd"),
    (r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.MM.dd"),
)
#: What all shapes begin with.
BEGINNING = r"^\s*\d{1,4}[-/.]"
NUMERIC_SHAPE = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4})$"
NAMED_SHAPE = r"^(\d{1,2})[-/]([A-Za-z]{3})[-/](\d{2,4})$"


def parse_day(text: Column) -> Column:
    """Date of a string, null if it has none of the shapes or is no calendar day (31 February is none).

    d/m/y is read day first, unless the second field can only be a day.  Two-digit years turn at 70.  Years are 1901-2199.
    """
    s = F.trim(text)
    out = None
    for pattern, shape in ISO_SHAPES:
        found = F.try_to_date(F.substring(s, 1, 10), shape)
        out = F.when(s.rlike(pattern), found) if out is None else out.when(s.rlike(pattern), found)
    part = lambda p, i: F.regexp_extract(s, p, i)
    a, b = (part(NUMERIC_SHAPE, i).try_cast("int") for i in (1, 2))
    month_first = (a <= 12) & (b > 12)
    dmy = F.concat_ws("-", part(NUMERIC_SHAPE, 3), F.lpad(F.when(month_first, a).otherwise(b).cast("string"), 2, "0"), F.lpad(F.when(month_first, b).otherwise(a).cast("string"), 2, "0"))
    year = part(NAMED_SHAPE, 3).try_cast("int")
    full = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    named = F.concat_ws("-", full.cast("string"), F.initcap(part(NAMED_SHAPE, 2)), F.lpad(part(NAMED_SHAPE, 1), 2, "0"))
    out = out.when(s.rlike(NUMERIC_SHAPE), F.try_to_date(dmy, "yyyy-MM-dd")).when(s.rlike(NAMED_SHAPE), F.try_to_date(named, "yyyy-MMM-dd"))
    return F.when((F.year(out) > 1900) & (F.year(out) < 2200), out)


def day_of(column: Column, kind: str) -> Column:
    """Date of a column of Spark type `kind`: dates and timestamps by cast, text by parse_day."""
    return column.cast("date") if kind.startswith(("date", "timestamp")) else parse_day(column.cast("string"))


def period(day: Column, grain: str) -> Column:
    """Sortable key of the period that holds a day."""
    if grain == "day":
        return F.date_format(day, "yyyy-MM-dd")
    if grain == "week":
        return F.concat(F.lpad(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), 4, "0"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))
    if grain == "month":
        return F.date_format(day, "yyyy-MM")
    if grain == "quarter":
        return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))
    if grain == "year":
        return F.date_format(day, "yyyy")
    raise ValueError(f"no grain {grain!r}; one of {', '.join(GRAINS)}")


def period_range(key: str, grain: str) -> tuple[date, date]:
    """First and last day of a period key; raises ValueError for a key of another form."""
    if grain == "day":
        d = date.fromisoformat(key)
        return d, d
    if grain == "week" and (m := re.fullmatch(r"(\d{4})-W(\d{2})", key)):
        first = date.fromisocalendar(int(m[1]), int(m[2]), 1)
        return first, first + timedelta(days=6)
    if grain in ("month", "quarter", "year") and (m := re.fullmatch({"month": r"(\d{4})-(\d{2})", "quarter": r"(\d{4})-Q([1-4])", "year": r"(\d{4})()"}[grain], key)):
        months = {"month": 1, "quarter": 3, "year": 12}[grain]
        start = {"month": int(m[2] or 1), "quarter": 3 * int(m[2] or 1) - 2, "year": 1}[grain]
        first, past = date(int(m[1]), start, 1), start + months - 1
        return first, (date(int(m[1]) + past // 12, past % 12 + 1, 1) - timedelta(days=1))
    raise ValueError(f"{key!r} is no {grain} key")
