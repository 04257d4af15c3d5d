"""Typing, normalising, validating and grading of spreadsheet values."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType

from talentloom.functions.text import any_of, collapsed

# Patterns by type. Bare zeros count as "none at all" only when they stand alone.
CURRENCY = (
    r"(?:₹|rs\.?|inr|rupees?)\s*\d+|\d\s*(?:₹|rs\.?|inr|rupees?)",
    r"(?:\$|usd|dollars?)\s*\d+|\d\s*(?:\$|usd|dollars?)",
    r"(?:€|eur|euros?)\s*\d+|\d\s*(?:€|eur|euros?)",
    r"\d+(?:\.\d+)?\s*(?:lakh|lac|cr|crore)s?",
    r"\d+(?:\.\d+)?\s*k",
)
PLAIN_MONEY = r"^\d+(?:,\d{3})*(?:\.\d{2})?$"
EXPERIENCE = (r"\d+(?:\.\d+)?\s*(?:years?|yrs?|y)", r"\d+\s*(?:months?|mon?|m)", r"fresher|fresh|no\s*experience|entry\s*level|^0$")
DURATION = (r"\d+\s*(?:days?|d)", r"\d+\s*(?:weeks?|w)", r"\d+\s*(?:months?|mon?|m)", r"immediate|asap|^0$|zero", r"serving|in\s*notice", r"negotiable|flexible|discuss")
DATES = (r"\d{1,2}/\d{1,2}/\d{4}", r"\d{1,2}-\d{1,2}-\d{4}", r"\d{4}-\d{1,2}-\d{1,2}", r"\d{1,2}\s+\w+\s+\d{4}")
SEPARATORS = r"[,;|/\n]"
#: The order in which types win ties.
TYPES = ("email", "phone", "currency", "experience", "percentage", "date", "year", "duration", "list", "number", "text")
HEADER_PREFIXES = ("candidate_", "employee_", "person_", "user_", "applicant_")
HEADER_SUFFIXES = ("_name", "_info", "_details", "_data", "_field")
HEADER_PATTERNS = {
    "email": r".*(?:email|mail|e[-_]?mail).*",
    "phone": r".*(?:phone|mobile|contact|tel|cell|mob)(?:_?(?:no|number))?.*",
    "experience": r".*(?:exp|experience|years?)(?:_?(?:of|in))?(?:_?(?:work|job|professional))?.*",
    "salary": r".*(?:salary|ctc|compensation|pay|package).*",
    "education": r".*(?:education|qualification|degree|graduation|study|studies).*",
    "skills": r".*(?:skill|tech|technical|competenc|abilit|expertis).*",
    "name": r".*(?:name|candidate|person|applicant|employee)(?:_?name)?.*",
    "company": r".*(?:company|organization|employer|firm|workplace).*",
    "location": r".*(?:location|city|place|address|town).*",
    "date": r".*(?:date|time|year|month|day).*",
    "notice": r".*(?:notice|availability|joining)(?:_?(?:period|time|days?))?.*",
}
HEADER_AREAS = (
    (("personal", "individual", "candidate", "applicant", "person", "profile"), ("name", "first_name", "last_name", "age", "gender")),
    (("contact", "communication", "reach", "connect", "touch"), ("email", "phone", "address", "city")),
    (("professional", "work", "job", "career", "employment", "occupation"), ("current_role", "current_company", "experience")),
    (("educational", "academic", "study", "learning", "school", "college"), ("education", "degree", "college", "graduation_year")),
    (("technical", "technology", "IT", "software", "hardware", "digital"), ("skills", "technical_skills", "certifications")),
    (("financial", "money", "salary", "compensation", "pay", "package"), ("current_salary", "expected_salary")),
    (("time", "period", "duration", "date", "year", "month", "day"), ("date_of_birth", "graduation_year", "notice_period")),
)
PATTERN_SHARE, AREA_SHARE, STEALS_FROM = 0.8 * 0.9, 0.7 * 0.8 * 0.7, 1.1
QUALITY_WEIGHTS = {"completeness": 0.3, "accuracy": 0.25, "consistency": 0.2, "richness": 0.15, "reliability": 0.1}
GRADES = {"A+": 0.9, "A": 0.8, "B": 0.7, "C": 0.6, "D": 0.5}


def clean_header(name: str) -> str:
    return re.sub(r"_+", "_", re.sub(r"[^a-z0-9]", "_", name.strip().lower())).strip("_")


def kept_headers(names: list[str]) -> list[int]:
    """Places of the columns that stay: of names that are equal whatever their case and outer blanks, the first."""
    seen: set[str] = set()
    return [i for i, n in enumerate(names) if not ((k := n.strip().lower()) in seen or seen.add(k))]


def clean_headers(names: list[str]) -> list[str]:
    """Cleaned names; of different names that are equal then, the first stays as it is and later ones get a number. Repeated names are dropped before, by ``kept_headers``."""
    seen: dict[str, int] = {}
    out = []
    for n in map(clean_header, names):
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


def bare_header(name: str) -> str:
    """A header for comparison: lower case, without one usual prefix and suffix, marks as underscores."""
    out = name.strip().lower()
    out = next((out.removeprefix(x) for x in HEADER_PREFIXES if out.startswith(x)), out)
    out = next((out.removesuffix(x) for x in HEADER_SUFFIXES if out.endswith(x)), out)
    return re.sub(r"_+", "_", re.sub(r"[-\s.()\[\]]+", "_", out)).strip("_")


def header_scores(header: str, synonyms: dict[str, list[str]], least: float = 0.6) -> dict[str, float]:
    """Field -> confidence: similarity to a synonym from ``least`` on, a pattern (0.72), or a word of the field's area (0.392), whichever is highest."""
    name, out = bare_header(header), {}
    ratio = lambda a, b: SequenceMatcher(None, a, b.lower()).ratio() if a and b else 0.0
    for f, names in synonyms.items():
        if (score := max(ratio(name, x) for x in [f, *names])) >= least:
            out[f] = score
    found = [(f, PATTERN_SHARE) for f, p in HEADER_PATTERNS.items() if re.search(p, name)]
    found += [(f, AREA_SHARE) for words, fields in HEADER_AREAS for f in fields if any(w in name for w in words)]
    for f, share in found:
        out[f] = max(out.get(f, 0.0), share)
    return out


def map_headers(headers: list[str], synonyms: dict[str, list[str]], least: float = 0.6) -> dict[str, tuple[str, float]]:
    """Header -> field and confidence. Works on names, not on data.

    Headers take their best free field in turn, or one that is taken if they fit it more than a tenth better than its holder, which keeps its name for it too.
    """
    out: dict[str, tuple[str, float]] = {}
    held: dict[str, float] = {}
    for h in headers:
        for f, score in sorted(header_scores(h, synonyms, least).items(), key=lambda x: -x[1]):
            if score >= least and (f not in held or score > held[f] * STEALS_FROM):
                out[h], held[f] = (f, score), score
                break
    return out


def unmapped(headers: list[str], mapped: dict[str, tuple[str, float]], wanted: list[str]) -> tuple[list[str], list[str]]:
    """Headers without a field, and wanted fields without a header."""
    got = {f for f, _ in mapped.values()}
    return [h for h in headers if h not in mapped], [w for w in wanted if w not in got]


def confidences(value: Column, years: tuple[int, int] = (1950, 2036)) -> dict[str, Column]:
    """Confidence by type, for one trimmed value."""
    low = F.lower(value)
    like = lambda *patterns: any_of(low.rlike(p) for p in patterns)
    weak = F.lit(0.1)
    digits = F.regexp_replace(value, r"[\s\-()]", "")
    number = F.replace(value, F.lit(","), F.lit("")).try_cast("double")
    leading = F.get(F.split(value, "/"), F.lit(0)).try_cast("double")
    year = F.when(value.rlike(r"^\d{4}$"), value.try_cast("int"))
    words = F.split(value, r"\s+")
    return {
        "email": F.when(value.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"), 0.95).otherwise(weak),
        "phone": F.when(digits.rlike(r"^\+?\d{10,13}$"), 0.95).when(digits.rlike(r"^\+?\d{8,15}$"), 0.6).otherwise(weak),
        "currency": F.when(like(*CURRENCY), 0.9).when(value.rlike(PLAIN_MONEY), 0.6).otherwise(weak),
        "experience": F.when(like(*EXPERIENCE), 0.9).otherwise(weak),
        "percentage": F.when(F.contains(value, F.lit("%")), 0.95).when(value.rlike(r"^\d+(?:\.\d+)?(?:/\d+(?:\.\d+)?)?$") & leading.between(0, 100), 0.7).otherwise(weak),
        "date": F.when(like(*DATES), 0.9).otherwise(weak),
        "year": F.when(year.between(*years), 0.9).when(year.isNotNull(), 0.6).otherwise(weak),
        "duration": F.when(like(*DURATION), 0.9).otherwise(weak),
        "list": F.when(value.rlike(SEPARATORS), 0.8).when((F.size(words) >= 3) & F.forall(words, lambda w: F.length(w) >= 2), 0.6).otherwise(weak),
        "number": F.when(number.isNotNull(), 0.9).otherwise(weak),
        "text": F.lit(0.5),
    }


def detect(value: Column) -> Column:
    """The type with the highest confidence, the earlier one on ties."""
    sure = confidences(F.trim(value))
    best = F.greatest(*sure.values())
    out = F
    for kind in TYPES:
        out = out.when(sure[kind] == best, F.struct(F.lit(kind).alias("type"), best.alias("confidence")))
    return out


def amount(value: Column) -> Column:
    """Money in units: lakh, crore and k multiply."""
    low = F.lower(value)
    n = F.replace(F.regexp_extract(low, r"(\d[\d,]*(?:\.\d+)?)", 1), F.lit(","), F.lit("")).try_cast("double")
    return n * F.when(low.rlike(r"\d\s*(?:lakh|lac)"), 1e5).when(low.rlike(r"\d\s*(?:crore|cr)"), 1e7).when(low.rlike(r"\d\s*k"), 1e3).otherwise(1.0)


def percent(value: Column) -> Column:
    """Percentages as they are, fractions of their whole, and grade points of up to 10 times 10."""
    top, whole = (F.regexp_extract(value, r"(\d+(?:\.\d+)?)\s*/\s*(\d+(?:\.\d+)?)", k).try_cast("double") for k in (1, 2))
    n = F.regexp_extract(value, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
    return F.when(F.contains(value, F.lit("%")), n).when(whole > 0, top / whole * 100).when(n <= 10, n * 10).otherwise(n)


def notice_days(value: Column) -> Column:
    """Days of notice: weeks times 7, months times 30; 0 at once; -1 while serving; -2 negotiable; null else."""
    low = F.lower(F.trim(value))
    n = lambda unit: F.regexp_extract(low, rf"(\d+)\s*(?:{unit})", 1).try_cast("int")
    return (
        F.when(low.rlike(r"immediate|asap|^0$|zero"), 0).when(low.rlike(r"serving|in\s*notice"), -1).when(low.rlike("negotiable|flexible|discuss"), -2)
        .otherwise(F.coalesce(n("days?|d"), n("weeks?|w") * 7, n("months?|mon?|m") * 30))
    )


def tidy_name(value: Column) -> Column:
    """White space collapsed; names that are all upper or lower case get capitals."""
    name = collapsed(value)
    return F.when((name == F.upper(name)) | (name == F.lower(name)), F.initcap(F.lower(name))).otherwise(name)


def tidy_list(value: Column) -> Column:
    """A separated list as an array without blanks; of spellings that differ in case the first stays."""
    parts = F.filter(F.transform(F.split(value, SEPARATORS), collapsed), lambda x: x != "")
    return F.filter(parts, lambda x, i: ~F.exists(F.slice(parts, F.lit(1), i), lambda y: F.lower(y) == F.lower(x)))


def completeness(critical: list[Column], important: list[Column], optional: list[Column]) -> Column:
    share = lambda xs: sum((F.coalesce((x.isNotNull() & (x.cast("string") != "")).cast("int"), F.lit(0)) for x in xs), F.lit(0)) / len(xs)
    return share(critical) * 0.6 + share(important) * 0.3 + share(optional) * 0.1


def grade(score: Column) -> Column:
    out = F
    for name, least in GRADES.items():
        out = out.when(score >= least, F.lit(name))
    return out.otherwise("F")


def finite_rows(df: DataFrame, keys: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Not-a-number and infinities as null, strings trimmed and blank ones null; rows that are null in all columns but ``keys`` are left out. Names may hold dots."""

    def clean(name: str, kind: object) -> Column:
        value = F.col("`" + name.replace("`", "``") + "`")
        if isinstance(kind, (DoubleType, FloatType)):
            return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value).alias(name)
        return F.nullif(F.regexp_replace(value, r"^\s+|\s+$", ""), F.lit("")).alias(name) if isinstance(kind, StringType) else value.alias(name)

    out = df.select(*(clean(f.name, f.dataType) for f in df.schema))
    rest = [F.col("`" + n.replace("`", "``") + "`").isNotNull() for n in df.columns if n not in keys]
    return out.filter(any_of(rest)) if rest else out
