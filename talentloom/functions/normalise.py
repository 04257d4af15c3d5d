"""Values of one kind as one form, values that hold several fields, and fields made of others."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.ingest import amount
from talentloom.functions.text import collapsed, filled

# How durations, currencies and fields that share a value are written.
FRESHER = r"fresher|fresh|no\s*experience|entry\s*level|^0$"
YEARS, MONTHS = r"(\d+(?:\.\d+)?)\s*(?:years?|yrs?|y)", r"(\d+)\s*(?:months?|mon?|m)"
YEAR_RANGE = r"(\d+)\s*(?:-|to)\s*(\d+)\s*(?:years?|yrs?|y)"
CURRENCIES = {"INR": r"₹|rs\.?\s*\d|inr|rupee", "USD": r"\$|usd|dollar", "EUR": r"€|eur"}
SEPARATORS = (",", ";", "|", "/", "\n", "&")
ADDRESS = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
COMPOSITES = {
    "name_email": ((rf"([a-zA-Z\s]+)\s*[-(<]\s*({ADDRESS})\s*[>)-]", ("name", "email")), (rf"({ADDRESS})\s*[-(<]\s*([a-zA-Z\s]+)\s*[>)-]", ("email", "name"))),
    "name_phone": ((r"([a-zA-Z\s]+)\s*[-(<]\s*(\+?[\d\s()-]+)\s*[>)-]", ("name", "phone")), (r"(\+?[\d\s()-]+)\s*[-(<]\s*([a-zA-Z\s]+)\s*[>)-]", ("phone", "name"))),
    "location": ((r"([a-zA-Z\s]+),\s*([a-zA-Z\s]+),\s*([a-zA-Z\s]+)(?:,\s*(\d{5,6}))?", ("city", "state", "country", "pin")), (r"([a-zA-Z\s]+),\s*([a-zA-Z\s]+)(?:,\s*(\d{5,6}))?", ("city", "state", "pin")), (r"([a-zA-Z\s]+)\s*-\s*(\d{5,6})", ("city", "pin"))),
    "experience_company": ((r"(\d+(?:\.\d+)?)\s*(?:years?|yrs?)\s*(?:at|with|in)\s*(.+)", ("years", "company")), (r"(.+)\s*[-–]\s*(\d+(?:\.\d+)?)\s*(?:years?|yrs?)", ("company", "years"))),
    "education": ((r"([a-zA-Z\s.]+)\s*(?:from|in)\s*([a-zA-Z\s.]+)(?:\s*[-–]\s*(\d{4}))?", ("degree", "college", "year")), (r"([a-zA-Z\s.]+)\s*,\s*([a-zA-Z\s.]+)(?:\s*,\s*(\d{4}))?", ("degree", "college", "year"))),
    "salary": ((r"([₹$€£])\s*(\d+(?:,\d{3})*(?:\.\d{2})?)", ("currency", "amount")), (r"(\d+(?:,\d{3})*(?:\.\d{2})?)\s*([₹$€£]|INR|USD|EUR|GBP)", ("amount", "currency"))),
    "skill_rating": ((r"([a-zA-Z\s+#.]+)\s*[-–]\s*(\d+(?:\.\d+)?)\s*(?:/\s*\d+|%?)", ("skill", "rating")), (r"([a-zA-Z\s+#.]+)\s*\(\s*(\d+(?:\.\d+)?)\s*(?:/\s*\d+|%?)\s*\)", ("skill", "rating"))),
}
DATE_FORMS = ("yyyy-MM-dd", "dd/MM/yyyy", "dd-MM-yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy")


def experience(value: Column) -> Column:
    """``total_months, years, months, fresher`` of a text: none at all, a range's mean, or years and months. A bare zero counts as none only by itself."""
    low = F.lower(F.trim(value))
    n = lambda pattern, k=1: F.regexp_extract(low, pattern, k).try_cast("double")
    none = low.rlike(FRESHER)
    ranged = low.rlike(YEAR_RANGE)
    years = F.when(none, 0.0).when(ranged, (n(YEAR_RANGE, 1) + n(YEAR_RANGE, 2)) / 2).otherwise(F.coalesce(n(YEARS), F.lit(0.0)))
    months = F.when(none | ranged, 0).otherwise(F.coalesce(n(MONTHS).cast("int"), F.lit(0)))
    total = F.floor(years * 12).cast("int") + months
    return F.struct(total.alias("total_months"), F.round(total / 12, 1).alias("years"), months.alias("months"), none.alias("fresher"))


def money(value: Column) -> Column:
    """``amount, currency``: units, and the currency that is named; rupees else."""
    low, said = F.lower(value), F
    for code, pattern in CURRENCIES.items():
        said = said.when(low.rlike(pattern), F.lit(code))
    return F.struct(amount(value).alias("amount"), said.otherwise("INR").alias("currency"))


def number(value: Column) -> Column:
    """A number without commas and blanks; null where that is none."""
    return F.regexp_replace(value, r"[, ]", "").try_cast("double")


def year(value: Column, as_of_year: int) -> Column:
    """``year, is_valid``: from 1950 to ten years ahead."""
    n = F.trim(value).try_cast("int")
    return F.struct(n.alias("year"), F.coalesce(n.between(1950, as_of_year + 10), F.lit(False)).alias("is_valid"))


def date(value: Column) -> Column:
    """The date of the usual spellings; null for others."""
    return F.coalesce(*(F.try_to_timestamp(F.trim(value), F.lit(w)) for w in DATE_FORMS)).cast("date")


def listed(value: Column) -> Column:
    """The parts of a list, by the separator that makes most of them (the first of equals); trimmed, of two letters or more."""
    best = F.greatest(*(F.size(F.split(value, _quoted(s), -1)) for s in SEPARATORS))
    parts = F
    for s in SEPARATORS:
        cut = F.split(value, _quoted(s), -1)
        parts = parts.when((F.size(cut) == best), cut)
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: F.length(x) > 1)


def _quoted(s: str) -> str:
    return s if s in ",;/&\n" else "\\" + s


def email(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"\s", ""))


def phone(value: Column) -> Column:
    """Digits with a country code: ten digits are Indian, twelve that begin with 91 have theirs, a leading zero goes; others keep what they have."""
    plus, digits = F.startswith(F.trim(value), F.lit("+")), F.regexp_replace(value, r"\D", "")
    return (
        F.when(digits == "", None).when(plus, F.concat(F.lit("+"), digits)).when(F.length(digits) == 10, F.concat(F.lit("+91"), digits))
        .when((F.length(digits) == 12) & F.startswith(digits, F.lit("91")), F.concat(F.lit("+"), digits)).when((F.length(digits) == 11) & F.startswith(digits, F.lit("0")), F.concat(F.lit("+91"), F.substring(digits, 2, 10))).otherwise(digits)
    )


def composite(value: Column, kind: str) -> Column:
    """A map of the fields that one value of a kind holds, by the first of its spellings that fits; null where none does."""
    out, text = F, F.trim(value)
    for pattern, names in COMPOSITES[kind]:
        groups = [F.trim(F.regexp_extract(text, f"(?i){pattern}", k)) for k in range(1, len(names) + 1)]
        fields = F.map_filter(F.create_map(*(x for n, g in zip(names, groups) for x in (F.lit(n), g))), lambda k, v: v != "")
        out = out.when(text.rlike(f"(?i){pattern}"), fields)
    return out.otherwise(F.lit(None))


def full_name(name: Column, first: Column, last: Column) -> Column:
    """``name, first_name, last_name``: each from the others where it is missing."""
    whole = F.coalesce(filled(name), F.nullif(F.trim(F.concat_ws(" ", filled(first), filled(last))), F.lit("")))
    parts = F.split(collapsed(whole), " ")
    several = F.size(parts) >= 2
    return F.struct(whole.alias("name"), F.coalesce(filled(first), F.when(several, parts[0])).alias("first_name"), F.coalesce(filled(last), F.when(several & filled(first).isNull(), F.array_join(F.slice(parts, F.lit(2), F.size(parts)), " "))).alias("last_name"))


def location(city: Column, state: Column, country: Column) -> Column:
    return F.nullif(F.concat_ws(", ", filled(city), filled(state), filled(country)), F.lit(""))


def summaries(fields: dict[str, Column]) -> dict[str, Column]:
    """How to reach somebody, and what they do, as one line each; and the share of the important fields that are there."""
    some = {k: filled(fields[k]) for k in ("name", "email", "phone", "city", "role", "company", "experience", "skills", "education")}
    labelled = lambda label, k: F.concat(F.lit(label), some[k])
    important = [some[k] for k in ("name", "email", "phone", "experience", "role", "skills", "education")]
    return {
        "contact": F.nullif(F.concat_ws(" | ", labelled("Email: ", "email"), labelled("Phone: ", "phone"), labelled("Location: ", "city")), F.lit("")),
        "work": F.nullif(F.concat_ws(" ", some["role"], labelled("at ", "company"), F.concat(F.lit("("), some["experience"], F.lit(" experience)"))), F.lit("")),
        "completeness": sum((x.isNotNull().cast("int") for x in important), F.lit(0)) / len(important) * 100,
    }
