"""Validation of field values by kind, consistency between fields, and the five-part quality of a row."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.ingest import QUALITY_WEIGHTS, completeness
from talentloom.functions.text import any_of

# Patterns, bounds and multipliers by kind of field, and patterns that hint at a usual mistake.
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^[\+]?[\d\s\-\(\)]{10,20}$"
REQUIRED = {"name": r"^[a-zA-Z\s\.\'-]+$", "email": EMAIL, "phone": PHONE, "location": r"^[a-zA-Z\s\,\-\.]+$"}
FORBIDDEN = {"name": (r"\d+", r"""[!@#$%^&*()_+={}\[\]|\\:";,.<>?/]"""), "email": (r"\s", r"[<>()]"), "phone": (r"[a-zA-Z]",)}
LENGTHS = {"name": (2, 100), "location": (2, 100)}
RANGES = {"experience": (0, 50), "age": (16, 80), "salary": (1000, 10_000_000), "year": (1950, 2031), "percentage": (0, 100)}
MISTAKES = {
    "name": (r"^(\w+)\s+(\w+)\s+(\w+)$", r"^[A-Z]{2,}$", r"^[a-z]+$", r"\d"),
    "email": (r"^[^@]+$", r"^[^@]+@[^.]+$", r".*\s.*", r".*[,;].*"),
    "phone": (r"^\d{11,}$", r"^\d{1,9}$", r".*[a-zA-Z].*", r"^0+"),
    "experience": (r"^\d+\.\d{3,}$", r"^[5-9]\d+$", r".*[a-zA-Z].*\d+.*"),
}
KIND_OF_NAME = {"name": ("name",), "email": ("email",), "phone": ("phone",), "experience": ("experience",), "age": ("age",), "salary": ("salary",), "year": ("year",), "percentage": ("percentage", "cgpa"), "skills": ("skill",), "location": ("city", "location", "address")}
MISTAKE, TOO_LONG, TOO_MANY, BLANK_ITEMS, SHORT_ITEMS, LONG_ITEMS, REPEATS = 0.9, 0.8, 0.9, 0.95, 0.9, 0.95, 0.85
MOST_ITEMS, ITEM_LENGTHS, SHORT_SHARE = 50, (2, 50), 0.3
NO_TALLY, RELIABILITY, FIELDS_OF_A_RICH_ROW, RICHER = 0.8, 0.8, 15, 0.1


@dataclass(frozen=True)
class Rule:
    """What is wrong with a value (it is not valid then), and what lowers its score by a factor."""

    wrong: tuple[Column, ...] = ()
    lower: tuple[tuple[Column, float], ...] = ()

    def judged(self, value: Column) -> Column:
        given = value.isNotNull() & (F.trim(value.cast("string")) != "")
        score = reduce(lambda s, x: s * F.when(F.coalesce(x[0], F.lit(False)), x[1]).otherwise(1.0), self.lower, F.lit(1.0))
        return F.when(given, F.struct((~any_of(F.coalesce(x, F.lit(True)) for x in self.wrong)).alias("is_valid"), score.alias("score"))).otherwise(F.struct(F.lit(True).alias("is_valid"), F.lit(0.0).alias("score")))


def kind_of(name: str) -> str | None:
    """The kind of a field, by what its name contains."""
    return next((kind for kind, parts in KIND_OF_NAME.items() if any(p in name.lower() for p in parts)), None)


def _cased(value: Column) -> Column:
    """All letters are capitals, or none is."""
    return (F.upper(value) != F.lower(value)) & ((value == F.upper(value)) | (value == F.lower(value)))


def _number(value: Column) -> Column:
    """The digits and dots of a text as a number; null where they make none."""
    return F.regexp_replace(value, r"[^\d.]", "").try_cast("double")


def validated(value: Column, kind: str | None) -> Column:
    """``is_valid, score`` of a text by the rules of its kind; blanks are valid with a score of 0, kinds without rules with 1."""
    bare, wrong, lower = F.trim(value), [], []
    if kind in REQUIRED:
        wrong.append(~value.rlike(REQUIRED[kind]))
    wrong += [value.rlike(p) for p in FORBIDDEN.get(kind, ())]
    if kind in LENGTHS:
        wrong.append(F.length(value) < LENGTHS[kind][0])
        lower.append((F.length(value) > LENGTHS[kind][1], TOO_LONG))
    if kind in RANGES:
        n, (least, most) = _number(value), RANGES[kind]
        wrong.append(~n.between(least, most))
        lower += {"experience": [(n > 40, 0.9)], "age": [(n > 70, 0.9), (n < 18, 0.95)]}.get(kind, [])
    if kind in ("name", "location"):
        lower += [(_cased(bare), 0.9), (bare.rlike(r"\d"), 0.8)]
    if kind == "name":
        lower.append((F.length(bare) < 3, 0.7))
    if kind == "email":
        lower += [(~bare.rlike(EMAIL), 0.3), (F.contains(bare, F.lit(" ")), 0.6)]
    if kind == "phone":
        lower += [(F.regexp_count(bare, F.lit(r"\d")) < 10, 0.5), (~bare.rlike(PHONE), 0.4)]
    lower += [(value.rlike(p), MISTAKE) for p in MISTAKES.get(kind, ())]
    return Rule(tuple(wrong), tuple(lower)).judged(value)


def validated_list(items: Column) -> Column:
    """``is_valid, score`` of a list of skills: at least one, at most 50, of 2 to 50 characters each, none twice (which counts twice)."""
    bare, n = F.transform(items, lambda x: F.trim(x)), F.size(items)
    count = lambda of: F.size(F.filter(bare, of))
    twice = F.size(F.array_distinct(F.transform(bare, F.lower))) < n
    lower = ((n > MOST_ITEMS, TOO_MANY), (count(lambda x: x == "") > 0, BLANK_ITEMS), (count(lambda x: (x != "") & (F.length(x) < ITEM_LENGTHS[0])) > n * SHORT_SHARE, SHORT_ITEMS), (count(lambda x: F.length(x) > ITEM_LENGTHS[1]) > 0, LONG_ITEMS), (twice, REPEATS), (twice, REPEATS))
    return F.when(items.isNull(), F.struct(F.lit(True).alias("is_valid"), F.lit(0.0).alias("score"))).otherwise(Rule((n < 1,), lower).judged(F.lit("x")))


def consistency(fields: dict[str, Column], as_of_year: int) -> Column:
    """Product of the multipliers of the rules between fields; a rule needs all its fields (age, experience_years, graduation_year, salary, name, first_name, last_name, email, company)."""
    none = F.lit(None)
    f = {k: fields.get(k, none) for k in ("age", "experience_years", "graduation_year", "salary", "name", "first_name", "last_name", "email", "company")}
    low = {k: F.lower(f[k].cast("string")) for k in ("name", "first_name", "last_name", "email", "company")}
    domain = F.get(F.split(low["email"], "@"), F.lit(1))
    kin = F.exists(F.regexp_extract_all(low["company"], F.lit(r"\w+"), F.lit(0)), lambda w: (F.length(w) > 3) & F.contains(domain, w))
    graduated_at = f["age"] - (F.lit(as_of_year) - f["graduation_year"])
    rules = (
        (f["experience_years"] > f["age"] - 16 + 2, 0.7),
        (~graduated_at.between(16, 35), 0.9),
        (~f["salary"].between(f["experience_years"] * 200_000 * 0.5, f["experience_years"] * 2_000_000 * 2), 0.95),
        ((low["first_name"] != "") & (low["last_name"] != "") & (low["name"] != "") & (low["name"] != F.concat(low["first_name"], F.lit(" "), low["last_name"])), 0.9),
        (kin, 1.05),
    )
    return reduce(lambda s, r: s * F.when(F.coalesce(r[0].cast("boolean"), F.lit(False)), r[1]).otherwise(1.0), rules, F.lit(1.0))


def accuracy_of(results: list[Column]) -> Column:
    """Seven parts the share of valid results, three parts their mean score; without results a fixed score. Results are ``is_valid, score``, null for absent fields."""
    there = sum((r.isNotNull().cast("int") for r in results), F.lit(0))
    valid = sum((F.coalesce(r["is_valid"].cast("int"), F.lit(0)) for r in results), F.lit(0))
    scores = sum((F.coalesce(r["score"], F.lit(0.0)) for r in results), F.lit(0.0))
    return F.when(there > 0, valid / there * 0.7 + scores / there * 0.3).otherwise(NO_TALLY)


def richness(fields: list[Column], structured: list[Column] = (), lists: list[Column] = ()) -> Column:
    """Fields that are there against those of a rich row, and a tenth each for a structured one and a list of several."""
    there = sum((x.isNotNull().cast("int") for x in [*fields, *structured, *lists]), F.lit(0))
    some = any_of(x.isNotNull() for x in structured).cast("int") + any_of(F.coalesce(F.size(x) > 1, F.lit(False)) for x in lists).cast("int")
    return F.least(F.lit(1.0), F.least(F.lit(1.0), there / FIELDS_OF_A_RICH_ROW) + some * RICHER)


def quality(critical: list[Column], important: list[Column], optional: list[Column], results: list[Column], consistent: Column, rich: Column, reliability: Column | None = None) -> dict[str, Column]:
    """The five parts of a row's quality, from 0 to 1, and ``overall``, their weighted sum."""
    parts = {"completeness": completeness(critical, important, optional), "accuracy": accuracy_of(results), "consistency": consistent, "richness": rich, "reliability": F.lit(RELIABILITY) if reliability is None else reliability}
    return parts | {"overall": sum((parts[k] * w for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))}


# What stands for an absent field of a record, and what takes its place.
ABSENT = {"email": ("email_not_provided@example.com", "noemail@notprovided.com"), "name": ("Name Not Found", "null", "N/A"), "city": ("Location not specified", "City not specified")}
INSTEAD = {"email": "email.not.found@placeholder.com", "phone": "+91-0000000000", "name": "Name Not Extracted", "city": "Location Not Specified"}
PAN, COUNTRY = "^[A-Z]{5}[0-9]{4}[A-Z]$", "91"


def _or_instead(value: Column, kind: str, kept: Column) -> Column:
    """``kept`` for a value that is there, the placeholder for one that is null, empty or says that it is absent."""
    gone = value.isNull() | value.isin("", *ABSENT.get(kind, ()))
    return F.when(gone, INSTEAD[kind]).otherwise(F.coalesce(F.nullif(kept, F.lit("")), F.lit(INSTEAD[kind])))


def record_email(value: Column) -> Column:
    return _or_instead(value, "email", value)


def record_name(value: Column) -> Column:
    """Letters, dots and blanks of a name."""
    return _or_instead(value, "name", F.regexp_replace(F.regexp_replace(value, r"[^a-zA-Z\s.]", ""), r"^\s+|\s+$", ""))


def record_city(value: Column) -> Column:
    return _or_instead(value, "city", F.trim(value))


def record_phone(value: Column) -> Column:
    """Digits behind a country code; twelve digits may begin with it."""
    digits = F.regexp_replace(value, r"[^\d+]", "")
    coded = F.startswith(digits, F.lit(COUNTRY)) & (F.length(digits) == 12)
    return _or_instead(value, "phone", F.when(F.startswith(digits, F.lit("+")), digits).when(coded, F.concat(F.lit("+"), digits)).otherwise(F.concat(F.lit("+" + COUNTRY), digits)))


def record_pan(value: Column) -> Column:
    """A tax number in capitals; null for anything else."""
    said = F.upper(F.trim(value))
    return F.when(said.rlike(PAN), said)


def record_aadhaar(value: Column) -> Column:
    """The twelve digits of an identity number; null for another count of digits."""
    digits = F.regexp_replace(value, r"\D", "")
    return F.when(F.length(digits) == 12, digits)
