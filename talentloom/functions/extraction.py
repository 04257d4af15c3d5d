"""What can be read out of raw texts, and how complete a parsed profile is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.text import any_of, holds

# Fixed values.
PHONE = r"(\+?\d{1,3}[-\s]?)?\(?\d{3}\)?[-\s]?\d{3}[-\s]?\d{4}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
SPAN = r"(?i)((?:19|20)\d{2})\s*[-–]\s*((?:19|20)\d{2}|present|current)"
DEFAULT_NAME, DEFAULT_PHONE, DEFAULT_CITY = "Name Not Extracted", "+91-0000000000", "Location Not Specified"
ACCURACY = {80: 95.0, 60: 85.0, 40: 75.0}


def first_email(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({EMAIL})", 1), F.lit(""))


def first_phone(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({PHONE})", 1), F.lit(""))


def named_skills(text: Column, vocabulary: list[str]) -> Column:
    """The vocabulary's entries that the text has as whole words, in the vocabulary's order."""
    low = F.lower(text)
    return F.array_compact(F.array(*(F.when(low.rlike(r"(?<![a-z0-9])" + "".join(c if c.isalnum() else "\\" + c for c in w.lower()) + r"(?![a-z0-9])"), F.lit(w)) for w in vocabulary)))


def years_by_spans(text: Column, as_of: int) -> Column:
    """The sum of all spans of years that a text names; an open one lasts until ``as_of``."""
    starts = F.regexp_extract_all(text, F.lit(SPAN), F.lit(1))
    ends = F.regexp_extract_all(text, F.lit(SPAN), F.lit(2))
    length = F.zip_with(starts, ends, lambda a, b: F.coalesce(b.try_cast("int"), F.lit(as_of)) - a.try_cast("int"))
    return F.aggregate(length, F.lit(0), lambda s, n: s + F.greatest(F.lit(0), n))


def profile_points(fields: dict[str, Column]) -> Column:
    """Of 15 points: name, e-mail, phone, city, education, both salaries, notice and source one each; experience, total and three skills two each."""
    text = lambda k, *but: (fields[k].isNotNull() & (fields[k] != "") & ~any_of(fields[k] == b for b in but)).cast("int")
    some = lambda k: F.coalesce((fields[k] != 0).cast("int"), F.lit(0))
    parts = [
        text("name", DEFAULT_NAME), F.coalesce(holds(fields["email"], "@").cast("int"), F.lit(0)), text("phone", DEFAULT_PHONE), text("city", DEFAULT_CITY), (F.size(fields["experience"]) > 0).cast("int") * 2, (F.size(fields["education"]) > 0).cast("int"),
        (F.size(fields["skills"]) >= 3).cast("int") * 2, some("current_salary"), some("expected_salary"), text("total_experience", "0 years 0 months") * 2, text("notice"), text("source", "resume_upload"),
    ]
    return sum((F.coalesce(p, F.lit(0)) for p in parts), F.lit(0))


def accuracy(completeness: Column) -> Column:
    out = F
    for least, score in ACCURACY.items():
        out = out.when(completeness >= least, score)
    return out.otherwise(60.0)


def better(old: Column, new: Column, old_quality: Column, new_quality: Column, confidence: Column) -> Column:
    """Of two values for one field the better one; of equally good ones the new one if its mapping is sure."""
    return F.when((new_quality > old_quality) | ((new_quality == old_quality) & (confidence > 0.8)), new).otherwise(old)
