"""Dates and numbers that a text names, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names as they are written, and the shapes of dates in running text.
MONTH_WORDS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
_WORDS = "|".join(sorted(MONTH_WORDS, key=lambda w: (-len(w), w)))
DAY_SHAPE = r"\b(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})\b"
MONTH_SHAPE = r"\b\d{4}[-/]\d{1,2}\b(?![-/]\d)"
NAMED_SHAPE = rf"(?i)\b(?:\d{{1,2}}\s+)?(?:{_WORDS})\.?\s+(?:\d{{1,2}}(?:st|nd|rd|th)?,?\s+)?\d{{4}}\b"
QUARTER_SHAPE = r"(?i)\b(?:Q[1-4]\s+\d{4}|\d{4}\s+Q[1-4])\b"
NUMBER_SHAPE = r"-?\$?\d[\d,]*(?:\.\d+)?(?:[eE][-+]?\d+)?\s*(?:%|[KMB]\b)?"
YEARS = (1991, 2199)

SPAN = "struct<start:date,end:date>"


def _digits(text: Column, pattern: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast("int")


def _fields(year: Column, month: Column, day: Column, months: Column) -> Column:
    """The first day of a span by its numbers, and how many months it lasts; none: that day alone."""
    return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), months.alias("months"))


def _of_day(raw: Column) -> Column:
    """2024-3-5, 2024/03/05 and 2024.03.05 year first; 5/3/2024 day first, unless its second field can only be a day."""
    return F.transform(F.transform(raw, lambda r: F.split(r, "[-/.]").cast("array<int>")), _of_three)


def _of_three(p: Column) -> Column:
    a, b, c = p[0], p[1], p[2]
    iso, flip = a > 99, (a <= 12) & (b > 12)
    return _fields(F.when(iso, a).otherwise(c), F.when(iso | ~flip, b).otherwise(a), F.when(iso, c).when(flip, b).otherwise(a), F.lit(0))


def _of_month(raw: Column) -> Column:
    return F.transform(raw, lambda r: _fields(_digits(r, r"^(\d{4})"), _digits(r, r"(\d{1,2})$"), F.lit(1), F.lit(1)))


def _of_name(raw: Column) -> Column:
    """14 September 2025 and Sept. 14th, 2025 are days; September 2025 is a month."""
    names = F.create_map(*[F.lit(x) for w, m in MONTH_WORDS.items() for x in (w, m)])
    before, after = r"^(\d{1,2})\s", r"[A-Za-z.]\s+(\d{1,2})(?:st|nd|rd|th|ST|ND|RD|TH)?,?\s"
    month = lambda r: F.element_at(names, F.lower(F.regexp_extract(r, r"([A-Za-z]+)", 1)))
    read = F.transform(raw, lambda r: _fields(_digits(r, r"(\d{4})$"), month(r), F.coalesce(_digits(r, before), _digits(r, after)), F.lit(0)))
    return F.transform(read, lambda f: _fields(f["y"], f["m"], F.coalesce(f["d"], F.lit(1)), F.when(f["d"].isNull(), 1).otherwise(0)))


def _of_quarter(raw: Column) -> Column:
    return F.transform(raw, lambda r: _fields(_digits(r, r"(\d{4})"), _digits(r, r"(?i)q([1-4])") * 3 - 2, F.lit(1), F.lit(3)))


SHAPES = ((DAY_SHAPE, _of_day), (MONTH_SHAPE, _of_month), (NAMED_SHAPE, _of_name), (QUARTER_SHAPE, _of_quarter))


def date_spans(text: Column) -> Column:
    """array<struct<start, end>> of the days, months and quarters a text names: each once, by start.  A null text has none.

    A month inside a full date is not read again: its shape does not match there.  31 February is no date.  Each step is
    an array of its own, so no pattern and no date is worked out twice.
    """
    fields = F.concat(*[read(F.regexp_extract_all(text, F.lit(shape), F.lit(0))) for shape, read in SHAPES])
    # numbers that make a month, then a day of it
    month = F.filter(fields, lambda f: f["y"].between(*YEARS) & f["m"].between(1, 12))
    real = F.filter(month, lambda f: f["d"].between(1, F.dayofmonth(F.last_day(F.make_date(f["y"], f["m"], F.lit(1))))))
    first = F.transform(real, lambda f: F.struct(F.make_date(f["y"], f["m"], f["d"]).alias("start"), f["months"].alias("months")))
    last = lambda f: F.when(f["months"] == 0, f["start"]).otherwise(F.last_day(F.add_months(f["start"], F.greatest(f["months"] - 1, F.lit(0)))))
    spans = F.transform(first, lambda f: F.struct(f["start"].alias("start"), last(f).alias("end")))
    return F.coalesce(F.sort_array(F.array_distinct(spans)), F.array().cast(f"array<{SPAN}>"))


def numbers(text: Column) -> Column:
    """array<double> of the numbers of a text, in its order: 1,234.5  -12%  3.4e-5  $1.2M; a percent sign does not scale, K, M
    and B do.  A null text has none."""

    def value(s: Column) -> Column:
        scale = F.when(s.endswith("K"), 1e3).when(s.endswith("M"), 1e6).when(s.endswith("B"), 1e9).otherwise(1.0)
        return F.regexp_replace(s, r"[%KMB]$", "").try_cast("double") * scale

    # an array of its own, so that no number is stripped twice
    plain = F.transform(F.regexp_extract_all(text, F.lit(NUMBER_SHAPE), F.lit(0)), lambda raw: F.regexp_replace(raw, r"[$,\s]", ""))
    found = F.transform(plain, value)
    return F.coalesce(F.filter(found, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))), F.array().cast("array<double>"))
