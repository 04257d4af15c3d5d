"""Work periods and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _int(text: Column) -> Column:
    return text.try_cast("int")


def months_of(text: Column) -> Column:
    """Months of "X years Y months"; a bare number counts years; 0 without any. The digits right before the unit count ("2.5 years" gives 5)."""
    years = _int(F.regexp_extract(text, r"(?i)(\d+)\s*(?:year|years|yr|yrs)", 1))
    months = _int(F.regexp_extract(text, r"(?i)(\d+)\s*(?:month|months|mo|mos)", 1))
    bare = _int(F.regexp_extract(text, r"(\d+)", 1))
    zero = F.lit(0)
    return F.when(years.isNull() & months.isNull(), F.coalesce(bare, zero) * 12).otherwise(F.coalesce(years, zero) * 12 + F.coalesce(months, zero))


def years_of(text: Column) -> Column:
    """The first number of a text as years; null without one."""
    return F.regexp_extract(text.cast("string"), r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def months_between(start: Column, end: Column, as_of: str) -> Column:
    """Months from one YYYY-MM to another, at least 1; an open end is ``as_of``; 0 where a date can't be read."""
    end = F.coalesce(F.nullif(F.trim(end), F.lit("")), F.lit(as_of))
    part = lambda d, k: _int(F.when(F.size(F.split(d, "-")) == 2, F.get(F.split(d, "-"), F.lit(k))))
    n = (part(end, 0) - part(start, 0)) * 12 + part(end, 1) - part(start, 1)
    return F.when(n.isNull(), 0).otherwise(F.greatest(F.lit(1), n))


def total_of(durations: Column) -> Column:
    """The sum of all years and months that an array of texts names, as "X years, Y months"."""
    number = r"(?i)(\d+\.?\d*)\s*"
    add = lambda unit: lambda a, x: a + F.aggregate(F.regexp_extract_all(x, F.lit(number + unit), F.lit(1)), F.lit(0.0), lambda b, n: b + n.cast("double"))
    months = F.aggregate(durations, F.lit(0.0), add(r"(?:years?|yrs?)\b")) * 12 + F.aggregate(durations, F.lit(0.0), add(r"(?:months?|mos?)\b"))
    return F.concat(F.floor(months / 12).cast("string"), F.lit(" years, "), F.rint(months % 12).cast("int").cast("string"), F.lit(" months"))


def year_month(text: Column) -> Column:
    """YYYY-MM of the usual date spellings; null for others."""
    ways = ("yyyy-MM-dd", "yyyy-MM", "yyyy/MM/dd", "MM/yyyy", "dd/MM/yyyy", "dd-MM-yyyy", "MMM yyyy", "MMMM yyyy", "yyyy")
    return F.date_format(F.coalesce(*(F.try_to_timestamp(F.trim(text), F.lit(w)) for w in ways)), "yyyy-MM")
