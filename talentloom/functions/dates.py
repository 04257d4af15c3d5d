"""Months out of dates that people wrote by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.durations import months_between

# Names of months, what says that a period goes on, what stands for an unreadable date.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
MONTH_WORD = "^(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)$"
OPEN = ("present", "current", "till date", "ongoing")
UNREADABLE = "2020-01"
#: Times of day, and days said as ordinals, say nothing about the month.
CLOCK = r"(?:t|\b)\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?\s*(?:[ap]\.?m\b\.?|z\b)?"
ORDINAL = r"\b\d{1,2}\s*(?:st|nd|rd|th)\b"
YEAR, SHORT_YEAR, SHORT, COMPACT = r"^(?:19|20)\d{2}$", r"^'\d{2}$", r"^'?\d{1,2}$", r"^(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:\d{2})?$"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def open_ended(text: Column) -> Column:
    """Whether a text says that a period goes on."""
    return F.coalesce(F.lower(F.trim(text)).isin(*OPEN), F.lit(False))


def _full_year(n: Column, as_of_year: int) -> Column:
    """A year of two digits as the one within half a century of ``as_of_year``."""
    year = n + as_of_year // 100 * 100
    return F.when(year >= as_of_year + 50, year - 100).when(year < as_of_year - 50, year + 100).otherwise(year)


def _placed(t: Column, as_of_year: int, day_first: bool) -> Column:
    numbers, month = t["numbers"], t["month"]
    digits = lambda x: F.replace(x, F.lit("'"), F.lit("")).try_cast("int")
    year = F.get(F.filter(numbers, lambda x: x.rlike(YEAR)), F.lit(0)).try_cast("int")
    compact = F.get(F.filter(numbers, lambda x: x.rlike(COMPACT)), F.lit(0))
    short = F.filter(numbers, lambda x: x.rlike(SHORT))
    at = lambda k: digits(F.get(short, F.lit(k)))
    count = F.size(short)
    marked = digits(F.get(F.filter(short, lambda x: x.rlike(SHORT_YEAR)), F.lit(0)))
    large = F.get(F.filter(F.transform(short, digits), lambda n: n > 31), F.lit(0))
    is_month = lambda n: n.between(1, 12)
    either = lambda a, b: F.when(is_month(a), a).when(is_month(b), b)
    two = lambda n: _full_year(n, as_of_year)
    pair = either(at(1), at(0)) if day_first else either(at(0), at(1))
    leads = F.get(numbers, F.lit(0)).rlike(YEAR)
    short_leads = F.get(short, F.lit(0)).rlike(SHORT_YEAR) | (at(0) > 31)
    made = lambda y, m: F.struct(y.cast("int").alias("year"), m.cast("int").alias("month"))
    return (
        F.when(month.isNotNull(), made(F.coalesce(year, two(F.coalesce(marked, large, F.when(count >= 1, at(count - 1))))), month))
        .when(year.isNotNull() & leads, made(year, F.coalesce(either(at(0), at(1)), F.lit(1))))
        .when(year.isNotNull(), made(year, F.coalesce(F.when(count >= 2, pair).otherwise(F.when(is_month(at(0)), at(0))), F.lit(1))))
        .when(compact.isNotNull(), made(F.substring(compact, 1, 4).try_cast("int"), F.substring(compact, 5, 2).try_cast("int")))
        .when((count == 3) & short_leads, made(two(at(0)), either(at(1), at(2))))
        .when(count == 3, made(two(at(2)), pair))
        .when((count == 2) & short_leads, made(two(at(0)), F.when(is_month(at(1)), at(1))))
        .when(count == 2, made(two(at(1)), F.when(is_month(at(0)), at(0))))
        .when((count == 1) & marked.isNotNull(), made(two(marked), F.lit(1)))
    )


def written_month(text: Column, as_of_year: int, day_first: bool = False) -> Column:
    """YYYY-MM of a date within a text; null for null, empty and open-ended texts and for those that no rule reads.

    A month's name wins over numbers; its year is the first of four digits, else one with an apostrophe, else a number above 31, else the last of two digits (so "Jan 19" is
    of 2019). Without a name a year in front is followed by its month, one behind is preceded by month and day; where both could be the month, the first is (the second with
    ``day_first``). A lone year is its January. Of several dates the first counts; years of two digits lie within half a century of ``as_of_year``.
    """
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.lower(text), F.lit("’"), F.lit("'")), CLOCK, " "), ORDINAL, " ")

    def read(tokens: Column) -> Column:
        names = F.filter(tokens, lambda x: x.rlike(MONTH_WORD))
        month = F.try_divide(F.instr(F.lit(MONTHS), F.substring(F.get(names, F.lit(0)), 1, 3)) + 2, F.lit(3)).cast("int")
        kept = F.filter(tokens, lambda x: x.rlike(r"^'?\d+$"))
        return _let(F.struct(month.alias("month"), kept.alias("numbers")), lambda t: _placed(t, as_of_year, day_first))

    tokens = F.regexp_extract_all(bare, F.lit(r"('?\d+|[a-z]+)"), F.lit(1))
    found = _let(tokens, read)
    said = _let(found, lambda d: F.when(d["year"].isNotNull() & d["month"].isNotNull(), F.format_string("%04d-%02d", d["year"], d["month"])))
    return F.when(~open_ended(text), said)


def month_or_default(text: Column, as_of_year: int) -> Column:
    """``written_month`` with a fixed month for what can't be read, empty and null texts too; null only for open ends."""
    return F.when(~open_ended(text), F.coalesce(written_month(text, as_of_year), F.lit(UNREADABLE)))


def written_span(start: Column, end: Column, as_of: str) -> Column:
    """``from_date, to_date, months`` of two written dates: in order, a null end is open and counts until ``as_of`` (YYYY-MM), at least one month; null months without a start."""
    year = int(as_of[:4])
    both = F.struct(written_month(start, year).alias("a"), written_month(end, year).alias("b"))

    def ordered(x: Column) -> Column:
        swapped = x["a"] > x["b"]
        first, last = F.when(swapped, x["b"]).otherwise(x["a"]), F.when(swapped, x["a"]).otherwise(x["b"])
        return F.struct(first.alias("from_date"), last.alias("to_date"), F.when(first.isNotNull(), months_between(first, last, as_of)).cast("int").alias("months"))

    return _let(both, ordered)
