"""Text rules as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,7}\b"
PHONE = r"\b\d{10}\b|\b(?:\d{3}-){2}\d{4}\b|\b\(\d{3}\) \d{3}-\d{4}\b"
EMAIL_MASK, PHONE_MASK = "****@****.***", "***-***-****"
COMMON_WORDS = ("resume", "cv", "curriculum", "vitae", "email", "phone", "address", "experience", "education", "skills", "projects", "objective", "summary", "references", "available", "upon", "request")
SKILL_STOP_WORDS = ("others", "and", "in", "of", "the", "with", "using", "etc", "various")
RESUME_WORDS = {
    "contact": ("email", "@", "phone", "mobile", "contact"),
    "experience": ("experience", "work", "employment", "job", "position", "role"),
    "education": ("education", "degree", "university", "college", "school", "graduated"),
    "skills": ("skills", "technologies", "expertise", "proficient"),
}
CATEGORIES = {
    "programming_languages": ("python", "java", "javascript", "js", "typescript", "php", "c#", "c++", "go", "rust", "ruby"),
    "web_technologies": ("html", "css", "react", "angular", "vue", "jquery", "bootstrap"),
    "backend_frameworks": ("django", "flask", "spring", "express", "laravel", "rails"),
    "databases": ("sql", "mysql", "postgresql", "mongodb", "redis", "elasticsearch", "oracle"),
    "cloud_devops": ("aws", "azure", "gcp", "docker", "kubernetes", "jenkins", "git", "cicd"),
    "data_science": ("pandas", "numpy", "tensorflow", "pytorch", "sklearn", "tableau", "powerbi"),
    "mobile_development": ("android", "ios", "swift", "kotlin", "flutter"),
    "tools_software": ("jira", "confluence", "slack", "figma", "photoshop", "excel", "linux"),
}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it names several times, with the value worked out once for each row: within lambdas and generators Spark works out every mention anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def holds(text: Column, *words: str) -> Column:
    """Whether the text contains one of the words, whatever their case."""
    if len(words) == 1:
        return F.contains(F.lower(text), F.lit(words[0].lower()))
    return F.lower(text).rlike("|".join(re.escape(w.lower()) for w in words)) if words else F.lit(False)


def mask_pii(text: Column) -> Column:
    """E-mail addresses and phone numbers replaced by asterisks."""
    return F.regexp_replace(F.regexp_replace(text, EMAIL, EMAIL_MASK), PHONE, PHONE_MASK)


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def comparable(text: Column) -> Column:
    """What near-copies are compared by: lower-case letters, without the usual section words (also inside other words)."""
    text = F.regexp_replace(F.lower(text), "[^a-z]+", " ")
    for word in COMMON_WORDS:  # as patterns they take less time than with F.replace
        text = F.regexp_replace(text, word, " ")
    return F.trim(F.regexp_replace(text, " {2,}", " "))


def preview(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def split_skills(text: Column) -> Column:
    """A free list of skills as an array: 2 to 50 characters, no numbers, no stop words."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?i)[,;|/&]|\sand\s|\sor\s")
    clean = F.transform(parts, lambda x: collapsed(F.regexp_replace(x, r"^[:\-\s]+|[:\-\s]+$", "")))
    return F.filter(clean, lambda x: F.length(x).between(2, 50) & ~x.rlike(r"^\d+$") & ~F.lower(x).isin(*SKILL_STOP_WORDS))


def resume_like(text: Column) -> Column:
    """Contact words, and words of experience, education or skills."""
    has = {k: holds(text, *words) for k, words in RESUME_WORDS.items()}
    return has["contact"] & (has["experience"] | has["education"] | has["skills"])


def category(skill: Column) -> Column:
    """The first category one of whose words the skill contains."""
    out = F
    for name, words in CATEGORIES.items():
        out = out.when(holds(skill, *words), F.lit(name))
    return out.otherwise("other")


def clean_prefix(prefix: str) -> str:
    """What a user typed, without signs that names of skills and titles lack."""
    return re.sub(r"[^\w\s\-\+\#\.]", "", prefix).strip()


def matches_typed(text: Column, typed: str) -> Column:
    """Whether the text contains what was typed, cleaned; a dot and a plus work as in a pattern, unless no pattern comes of it."""
    pattern = clean_prefix(typed)
    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return text.rlike("(?i)" + pattern)


def starts(text: Column, prefix: str) -> Column:
    return F.startswith(F.lower(text), F.lit(prefix.lower()))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(?i)\b{re.escape(word)}\b")


def word_gap(text: Column, phrase: str) -> Column:
    """All words of the phrase in their order, whatever lies between."""
    return text.rlike("(?i)" + ".*".join(re.escape(w) for w in phrase.split()))


def subsequence(text: Column, prefix: str) -> Column:
    """All characters of the prefix in their order."""
    return F.replace(F.lower(text), F.lit(" "), F.lit("")).rlike(".*".join(re.escape(c) for c in prefix.lower()))


def city_of(address: Column) -> Column:
    """The part of an address behind its first comma, up to the next."""
    found = F.trim(F.regexp_extract(address, r",\s+([^,]+)", 1))
    return F.when(found != "", found).otherwise(F.nullif(F.trim(F.get(F.split(address, ","), F.lit(1))), F.lit("")))


def filled(value: Column) -> Column:
    """Null for null, blank and the sentinel for absent."""
    return F.nullif(F.nullif(F.trim(value), F.lit("")), F.lit("N/A"))


def json_object(text: Column) -> Column:
    """The outermost braces of a text that an assistant wrapped in prose or fences."""
    return F.nullif(F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1), F.lit(""))
