"""Cleaning of a field's text by its kind, with the steps that changed it and a score for how little had to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentloom.functions.text import collapsed, once

# Kinds with the step that each is named by, units of money, separators in the order in which they are looked for, and scores.
STEPS = {
    "name": "name_formatting", "email": "email_formatting", "phone": "phone_formatting", "skills": "skills_normalization", "experience": "experience_normalization",
    "salary": "salary_normalization", "percentage": "percentage_normalization", "location": "location_formatting",
}
WHITE_SPACE = "whitespace_normalization"
UNITS = {"lakh": 100_000.0, "lac": 100_000.0, "crore": 10_000_000.0}
THOUSANDS = r"\d\s*k\b"
SEPARATORS = (",", ";", "|", "/", "&")
INITIALS = r"\b([A-Z])\.([A-Z])\b"
ADDRESS = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CHANGED, FOR_EACH_STEP = 0.8, 0.1


def titled(text: Column) -> Column:
    """Every letter that follows no letter as a capital, where a text is in one case throughout; other texts as they are."""
    low = F.lower(text)
    parts = F.transform(F.split(low, r"(?<=\P{L})"), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2))))
    return F.when((text == low) | (text == F.upper(text)), F.array_join(parts, "")).otherwise(text)


def clean_name(text: Column, aggressive: bool = False) -> Column:
    name = titled(text)
    name = collapsed(F.regexp_replace(name, r"\d+", "")) if aggressive else name
    return F.regexp_replace(name, INITIALS, "$1. $2")


def clean_email(text: Column, aggressive: bool = False) -> Column:
    bare = F.regexp_replace(F.lower(text), r"\s+", "")
    return F.coalesce(F.nullif(F.regexp_extract(bare, ADDRESS, 0), F.lit("")), bare) if aggressive else bare


def clean_phone(text: Column, aggressive: bool = False) -> Column:
    """Digits, plus signs, brackets, hyphens and single spaces; if aggressive, numbers of ten digits with or without the country's 91 in two groups of five."""
    bare = collapsed(F.regexp_replace(text, r"[^\d+()\-\s]", ""))
    if not aggressive:
        return bare
    digits = F.regexp_replace(bare, r"[^\d+]", "")
    return F.when(digits.rlike(r"^\+?91\d{10}$"), F.regexp_replace(digits, r"^\+?91(\d{5})(\d{5})$", "+91 $1 $2")).when(digits.rlike(r"^\d{10}$"), F.regexp_replace(digits, r"^(\d{5})(\d{5})$", "$1 $2")).otherwise(bare)


def clean_location(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(titled(text), r",(?:\s*,)+", ","), r",\s*$", "")


def clean_number(text: Column, kind: str) -> Column:
    """The first number of a text; null without one. Of money, lakh, lac and crore multiply wherever they stand and k right behind a number; a percentage that is nothing but a number keeps its sign. Commas between digits are left out."""

    def read(bare: Column) -> Column:
        n = F.regexp_extract(bare, r"(\d+(?:\.\d+)?)", 1).try_cast("double")
        if kind == "percentage":
            whole = F.regexp_extract(F.replace(bare, F.lit("%"), F.lit("")), r"^\s*([+-]?\d+(?:\.\d+)?)\s*$", 1).try_cast("double")
            return F.when(F.contains(text, F.lit("%")), F.coalesce(whole, n)).otherwise(n)
        if kind != "salary":
            return n
        low, unit = F.lower(bare), F
        for word, factor in UNITS.items():
            unit = unit.when(F.contains(low, F.lit(word)), factor)
        return n * unit.when(low.rlike(THOUSANDS), 1000.0).otherwise(1.0)

    return once(F.regexp_replace(text, r"(?<=\d),(?=\d)", ""), read)


def clean_skills(text: Column, aggressive: bool = False) -> Column:
    """A list parted by the first of the separators that occurs, without entries of one character; null where none occurs, unless an aggressive cleaning takes the words of a long text."""
    out = F
    for sign in SEPARATORS:
        parts = F.transform(F.split(text, "\\" + sign), lambda x: F.trim(x))
        out = out.when(F.contains(text, F.lit(sign)), F.filter(parts, lambda x: F.length(x) >= 2))
    words = F.split(text, " ")
    return out.when((F.length(text) > 50) & (F.size(words) > 5), words) if aggressive else out


def cleaned(value: Column, kind: str, aggressive: bool = False) -> Column:
    """A struct of ``text``, ``number`` or ``items`` (two of them null), ``steps`` and ``score``.

    White space is trimmed and collapsed first. Then a kind's own rules follow: ``STEPS`` names the kinds; any other has none. Where a number or a list can't be
    read the text stays. The score is 1 where nothing changed, else 0.8 and a tenth for each step. Null and blank values stay, with score 1.
    """
    none = F.array().cast("array<string>")
    rules = {"name": clean_name, "email": clean_email, "phone": clean_phone, "location": lambda t, _: clean_location(t)}

    def read(text: Column) -> Column:
        number = clean_number(text, kind) if kind in ("experience", "salary", "percentage") else F.lit(None).cast("double")
        items = clean_skills(text, aggressive) if kind == "skills" else F.lit(None).cast("array<string>")
        said = rules[kind](text, aggressive) if kind in rules else text
        return F.struct(text.alias("text"), number.alias("number"), items.alias("items"), said.alias("said"))

    def stepped(x: Column) -> Column:
        own = F.when(x["number"].isNotNull() | x["items"].isNotNull() | (x["said"] != value), F.lit(STEPS[kind])) if kind in STEPS else F.lit(None).cast("string")
        return F.array_compact(F.array(F.when(x["text"] != value, F.lit(WHITE_SPACE)), own))

    def changed(x: Column, steps: Column) -> Column:
        score = F.when(F.size(steps) == 0, 1.0).otherwise(F.least(F.lit(1.0), CHANGED + FOR_EACH_STEP * F.size(steps)))
        return F.struct(F.when(x["number"].isNull() & x["items"].isNull(), x["said"]).alias("text"), x["number"].alias("number"), x["items"].alias("items"), steps.alias("steps"), score.alias("score"))

    as_it_is = F.struct(value.alias("text"), F.lit(None).cast("double").alias("number"), F.lit(None).cast("array<string>").alias("items"), none.alias("steps"), F.lit(1.0).alias("score"))
    parts = lambda text: once(read(text), lambda x: once(stepped(x), lambda steps: changed(x, steps)))
    return once(collapsed(value), lambda text: F.when(value.isNull() | (text == ""), as_it_is).otherwise(parts(text)))


def cleaned_fields(df: DataFrame, keys: list[str], kinds: dict[str, str], aggressive: bool = False) -> DataFrame:
    """``keys, field, kind, text, number, items, steps, score``: a row for each field of ``kinds`` of each row, cleaned; its mean score says how clean a row was. Fields are text columns whose names may hold dots."""
    named = lambda c: F.col("`" + c.replace("`", "``") + "`")
    each = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(k).alias("kind"), cleaned(named(c), k, aggressive).alias("c")) for c, k in kinds.items()))
    return df.select(*map(named, keys), F.inline(each)).select(*map(named, keys), "field", "kind", "c.*")
