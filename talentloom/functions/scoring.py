"""Scores of profiles against requests. Request values are literals; profile columns are those of ``plans.profiles``."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.durations import months_of, years_of
from talentloom.functions.loose_json import tolerant_json
from talentloom.functions.text import any_of, holds

# Levels of education, in the order in which they are looked for.
CRITERIA_LEVELS = {"10th": 1, "ssc": 1, "12th": 2, "hsc": 2, "inter": 2, "intermediate": 2, "diploma": 3, "iti": 3, "associate": 3, "bachelor": 4, "degree": 4, "graduate": 4, "btech": 4, "be": 4, "bsc": 4, "ba": 4, "bcom": 4, "master": 5, "post graduate": 5, "mtech": 5, "me": 5, "msc": 5, "ma": 5, "mcom": 5, "mba": 5, "phd": 6, "doctorate": 6}
RANKING_LEVELS = {"phd": 6, "doctorate": 6, "master": 5, "mba": 5, "ms": 5, "me": 5, "mtech": 5, "bachelor": 4, "btech": 4, "be": 4, "bsc": 4, "ba": 4, "bcom": 4, "diploma": 3, "12th": 2, "intermediate": 2, "10th": 1}
CITIES = ("mumbai", "delhi", "bangalore", "chennai", "kolkata", "pune", "hyderabad", "ahmedabad", "surat", "jaipur", "noida", "gurgaon")
RANKING_WEIGHTS = {"skills": 0.40, "experience": 0.30, "education": 0.15, "location": 0.10, "salary": 0.05}
PRIORITY_WEIGHTS = {"designation": 0.4, "location": 0.3, "skills": 0.15, "experience": 0.1, "salary": 0.05}
REJECTED_BELOW = 40


@dataclass(frozen=True)
class Criteria:
    titles: tuple[str, ...] = ()
    skills: tuple[str, ...] = ()
    education: tuple[str, ...] = ()
    locations: tuple[str, ...] = ()
    min_months: int = 0
    max_months: int | None = None
    min_salary: float | None = None
    max_salary: float | None = None


@dataclass(frozen=True)
class Job:
    titles: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    preferred: tuple[str, ...] = ()
    education: tuple[str, ...] = ()
    years: float = 0
    extra: dict = field(default_factory=dict)


def total(items: Column, value) -> Column:
    """Sum of ``value(item)`` over an array; 0 for null."""
    return F.aggregate(F.coalesce(items, F.array().cast("array<string>")) if isinstance(items, str) else items, F.lit(0), lambda a, x: a + value(x))


def hits(low: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text in lower case contains."""
    out = F.lit(0)
    for w in words:
        out = out + F.contains(low, F.lit(w.lower())).cast("int")
    return out


def all_hits(items: Column | str, words: tuple[str, ...]) -> Column:
    """How many of the words the texts of an array contain, summed."""
    return F.aggregate(F.transform(items, F.lower), F.lit(0), lambda a, x: a + hits(x, words))


def first_level(text: Column, levels: dict[str, int]) -> Column:
    out = F
    for name, level in levels.items():
        out = out.when(F.contains(text, F.lit(name)), level)
    return out.otherwise(0)


def highest_level(text: Column, levels: dict[str, int]) -> Column:
    return F.greatest(*(F.when(F.contains(text, F.lit(k)), v).otherwise(0) for k, v in levels.items()))


def all_skills() -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.coalesce("skills", none), F.coalesce("may_also", none))


def salary() -> Column:
    return F.when(F.coalesce("expected_salary", F.lit(0.0)) > 0, F.col("expected_salary")).otherwise(F.col("current_salary"))


def criteria_facts(c: Criteria) -> dict[str, Column]:
    """What the score is made of, each read once from a profile: matches by criterion, levels of education, months, salary."""
    return {
        "n_titles": all_hits(F.transform("experience", lambda e: F.coalesce(e["title"], F.lit(""))), c.titles),
        "n_skills": F.size(F.array_intersect(F.transform(all_skills(), F.lower), F.array(*(F.lit(w.lower()) for w in c.skills)).cast("array<string>"))),
        "n_education": all_hits("education", c.education),
        "levels": F.aggregate(F.transform("education", F.lower), F.lit(0), lambda a, e: a + hits(e, c.education) * first_level(e, CRITERIA_LEVELS)) if c.education else F.lit(0),
        "months": months_of(F.col("total_experience")),
        "city": hits(F.lower(F.coalesce("current_city", F.lit(""))), c.locations),
        "wishes": all_hits("looking_for", c.locations),
        "pay": salary(),
    }


def criteria_score(c: Criteria, facts: dict[str, Column] | None = None) -> dict[str, Column]:
    """Points by criterion, fields matched, single matches, and the score out of 100 with its bonus for diversity. ``facts`` may be columns that hold them already."""
    n_titles, n_skills, n_education, levels, months, city, wishes, pay = (facts or criteria_facts(c)).values()
    ranged = c.min_months > 0 or c.max_months is not None
    in_range = (months >= c.min_months) & ((months <= c.max_months) if c.max_months is not None else F.lit(True)) if ranged else F.lit(False)
    close = (months >= c.min_months * 0.8) if ranged else F.lit(False)
    asked = c.min_salary is not None or c.max_salary is not None
    paid = (pay > 0) & (pay >= c.min_salary if c.min_salary is not None else F.lit(True)) & (pay <= c.max_salary if c.max_salary is not None else F.lit(True)) if asked else F.lit(False)
    paid = F.coalesce(paid, F.lit(False))
    points = {
        "titles": F.when(n_titles > 0, F.least(F.lit(25.0), n_titles * 8.0 + (n_titles - 1) * 2.0)).otherwise(0.0),
        "skills": F.when(n_skills > 0, F.least(F.lit(25.0), n_skills * 6.0 + (n_skills - 1) * 1.5)).otherwise(0.0),
        "education": F.when(levels > 0, F.least(F.lit(15.0), levels * 2.5)).otherwise(0.0),
        "experience": F.when(in_range, 10.0).when(close, 5.0).otherwise(0.0),
        "location": F.least(F.lit(15.0), (city * 3 + wishes * 2) * 2.0),
        "salary": F.when(paid, 10.0).otherwise(0.0),
    }
    matched = sum((x.cast("int") for x in (n_titles > 0, n_skills > 0, levels > 0, in_range, city + wishes > 0, paid)), F.lit(0))
    base = sum(points.values(), F.lit(0.0))
    return {
        "base_score": F.round(base, 2),
        "fields_matched": matched,
        "match_score": F.round(F.least(F.lit(100.0), base + F.least(F.lit(10), matched * 2)), 2),
        "single_matches": n_titles + n_skills + n_education + city + wishes + in_range.cast("int") + paid.cast("int"),
    }


def recalled(c: Criteria) -> Column:
    """Whether any criterion is met at all; everything is where nothing is asked."""
    some = []
    if c.titles:
        some.append(F.exists("experience", lambda e: holds(e["title"], *c.titles)))
    if c.skills:
        some.append(F.exists(all_skills(), lambda s: holds(s, *c.skills)))
    if c.education:
        some.append(F.exists("education", lambda e: holds(e, *c.education)))
    if c.locations:
        some += [holds(F.col("current_city"), *c.locations), F.exists("looking_for", lambda x: holds(x, *c.locations))]
    return F.coalesce(any_of(some), F.lit(False)) if some else F.lit(True)


def _weighed(parts: dict[str, Column]) -> dict[str, Column]:
    score = sum((parts[k] * w for k, w in PRIORITY_WEIGHTS.items()), F.lit(0.0))
    said = F.concat_ws("; ", *(F.when(parts[k] > 0, F.lit(f"{k.capitalize()} match")) for k in PRIORITY_WEIGHTS))
    return {"priority": score, "reason": F.when(said == "", "Basic vector similarity").otherwise(said)}


def priority_score(query: str, cities: tuple[str, ...] = CITIES) -> dict[str, Column]:
    """Weighted parts of a free query: designation, location, skills, experience, salary; and the reasons. The query is read once, on the driver."""
    query = query.lower()
    words = tuple(w for w in query.split() if len(w) > 2)
    role = F.transform(F.slice("experience", 1, 3), lambda e: F.lower(F.coalesce(e["title"], F.lit(""))))
    says = lambda x: any_of(F.contains(x, F.lit(w)) for w in words)
    same = F.exists(F.slice("experience", 1, 3), lambda e: says(F.lower(F.coalesce(e["title"], F.lit("")))) & (e == F.get("experience", F.lit(0))))
    parts = {"designation": F.when(same, 1.0).when(F.exists(role, says), 0.8).when(F.exists("labels", lambda x: says(F.lower(x))), 0.7).otherwise(0.0)}
    asked = [c for c in cities if c in query]
    here = any_of(F.contains(F.lower("current_city"), F.lit(c)) for c in asked)
    there = F.exists("looking_for", lambda x: any_of(F.contains(F.lower(x), F.lit(c)) for c in asked))
    parts["location"] = F.when(here, 1.0).when(there, 0.8).otherwise(0.0)
    parts["skills"] = F.when(F.exists(all_skills(), lambda x: says(F.lower(x))), 1.0).otherwise(0.0)
    parts["experience"], parts["salary"] = F.lit(0.0), F.lit(0.0)
    if found := re.search(r"(\d+)\s*(?:year|yr|yrs|years|exp|experience)", query):
        target, own = float(found[1]), years_of(F.col("total_experience"))
        parts["experience"] = F.when(F.abs(own - target) <= 1, 1.0).when(F.abs(own - target) <= 2, 0.8).when(own >= target * 0.8, 0.6).otherwise(0.0)
    if found := re.search(r"(\d+(?:\.\d+)?)\s*(?:lakh|lac|l)", query):
        target, pay = float(found[1]), F.coalesce("expected_salary", F.lit(0.0))
        pay = F.when(pay > 1_000_000, pay / 100_000).otherwise(pay)
        parts["salary"] = F.when(pay <= target, 1.0).when(pay <= target * 1.2, 0.8).otherwise(0.0)
    return _weighed(parts)


def query_facts(query: Column, cities: tuple[str, ...] = CITIES) -> dict[str, Column]:
    """What a free query asks for: its words from three characters, places, years and lakhs. A long text's words are dear: work them out once for a query, not for each row it meets."""
    low = F.lower(query)
    return {
        "words": F.array_distinct(F.filter(F.split(low, r"\s+"), lambda w: F.length(w) > 2)),
        "places": F.filter(F.array(*map(F.lit, cities)).cast("array<string>"), lambda c: F.contains(low, c)),
        "target": F.regexp_extract(low, r"(\d+)\s*(?:year|yr|yrs|years|exp|experience)", 1).try_cast("double"),
        "lakhs": F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*(?:lakh|lac|l)", 1).try_cast("double"),
    }


def priority_of(asked: dict[str, Column]) -> dict[str, Column]:
    """``priority_score`` for queries that are a column, such as the texts of job files; ``asked`` are columns of ``query_facts``."""
    words, places, target, lakhs = asked.values()
    says = lambda x: F.exists(words, lambda w: F.contains(x, w))
    recent = F.transform(F.slice("experience", 1, 3), lambda e: F.lower(F.coalesce(e["title"], F.lit(""))))
    same = F.exists(F.slice("experience", 1, 3), lambda e: (e == F.get("experience", F.lit(0))) & says(F.lower(F.coalesce(e["title"], F.lit("")))))
    parts = {"designation": F.when(same, 1.0).when(F.exists(recent, says), 0.8).when(F.exists("labels", lambda x: says(F.lower(x))), 0.7).otherwise(0.0)}
    within = lambda x: F.exists(places, lambda c: F.contains(F.lower(x), c))
    parts["location"] = F.when(within(F.col("current_city")), 1.0).when(F.exists("looking_for", within), 0.8).otherwise(0.0)
    parts["skills"] = F.when(F.exists(all_skills(), lambda x: says(F.lower(x))), 1.0).otherwise(0.0)
    own, pay = years_of(F.col("total_experience")), F.coalesce("expected_salary", F.lit(0.0))
    parts["experience"] = F.when(F.abs(own - target) <= 1, 1.0).when(F.abs(own - target) <= 2, 0.8).when(own >= target * 0.8, 0.6).otherwise(0.0)
    pay = F.when(pay > 1_000_000, pay / 100_000).otherwise(pay)
    parts["salary"] = F.when(pay <= lakhs, 1.0).when(pay <= lakhs * 1.2, 0.8).otherwise(0.0)
    return _weighed(parts)


def blend(priority: Column, similarity: Column) -> Column:
    """Seven parts priority, three parts similarity, out of 100; the similarity alone where there is no priority."""
    return F.when(priority > 0, priority * 0.7 + similarity * 0.3).otherwise(similarity) * 100


def as_percent(score: Column) -> Column:
    return F.round(F.when(score <= 1, score * 100).otherwise(score), 2)


def either_way(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


#: What a model's answer about a job holds. Fixed names.
REQUIREMENTS = "required_skills array<string>, preferred_skills array<string>, experience_years string, job_titles array<string>, education_requirements array<string>"


def requirements(answer: Column) -> Column:
    """A job's requirements out of a model's answer: ``required, preferred, titles, education`` (texts) and ``years``. What the answer lacks is empty, and so is all of it without an object in the answer."""
    said = F.from_json(tolerant_json(answer), REQUIREMENTS)
    none = F.array().cast("array<string>")
    listed = lambda name: F.array_compact(F.coalesce(said[name], none))
    return F.struct(
        listed("required_skills").alias("required"), listed("preferred_skills").alias("preferred"), listed("job_titles").alias("titles"),
        listed("education_requirements").alias("education"), F.coalesce(years_of(said["experience_years"]), F.lit(0.0)).alias("years"),
    )


def _bare(items: Column) -> Column:
    return F.transform(items, lambda x: F.lower(F.trim(x)))


def _level(items: Column) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, e: F.greatest(a, highest_level(F.lower(e), RANKING_LEVELS)))


def ranking_facts() -> dict[str, Column]:
    """What every match of a profile is made of, whatever the job: skills and titles as they are compared, years, level of education, points for location and salary."""
    now, then = F.coalesce("current_salary", F.lit(0.0)), F.coalesce("expected_salary", F.lit(0.0))
    hike = (then - now) / F.nullif(now, F.lit(0.0)) * 100
    return {
        "own": _bare(all_skills()),
        "held": F.transform("experience", lambda e: F.lower(F.trim(e["title"]))),
        "years": F.coalesce(years_of(F.col("total_experience")), F.lit(0.0)),
        "level": _level(F.col("education")),
        "schools": F.size("education"),
        "location": F.when(F.size("looking_for") > 0, 100.0).when(F.coalesce("current_city", F.lit("")) != "", 80.0).otherwise(50.0),
        "pay": F.when((then > 0) & (now > 0), F.when(hike <= 30, 100.0).when(hike <= 50, 80.0).otherwise(60.0)).when((then > 0) | (now > 0), 70.0).otherwise(90.0),
    }


def job_facts(job: Job | Column) -> dict[str, Column]:
    """What a match compares profiles with: required and all wanted skills, titles, level of education, years. Literals for a ``Job``; for a struct of ``requirements`` columns, to be worked out once for a job."""
    if isinstance(job, Job):
        low = lambda xs: F.array(*(F.lit(x.lower().strip()) for x in xs)).cast("array<string>")
        needed = max((v for r in job.education for k, v in RANKING_LEVELS.items() if k in r.lower()), default=0)
        return {"required": low(job.required), "wanted": low(job.required + job.preferred), "titles": low(job.titles), "needed": F.lit(needed), "least": F.lit(float(job.years))}
    required = _bare(job["required"])
    return {"required": required, "wanted": F.concat(required, _bare(job["preferred"])), "titles": _bare(job["titles"]), "needed": _level(job["education"]), "least": job["years"]}


def ranking(asked: dict[str, Column], facts: dict[str, Column] | None = None) -> dict[str, Column]:
    """A profile's match with a job (``job_facts``): skills, experience, education, location, salary, overall, verdict, missing skills.

    A job that asks for nothing gives no points for skills, all for education, and those for experience to whom its titles fit: no one. ``facts`` may be columns that hold ``ranking_facts`` already.
    """
    own, held, years, level, schools, location, pay = (facts or ranking_facts()).values()
    required, wanted, titles, needed, least = asked.values()
    met = F.filter(wanted, lambda s: F.exists(own, lambda c: either_way(s, c)))
    skills = F.size(met) / F.greatest(F.lit(1), F.size(wanted)) * 100
    missing = F.filter(required, lambda s: ~F.array_contains(met, s))
    fits = F.exists(titles, lambda t: F.exists(held, lambda e: either_way(t, e)))
    relevant = F.when(fits & (years > 0), years * 0.7).otherwise(0.0)
    experience = F.when(least > 0, F.least(F.lit(100.0), relevant / F.nullif(least, F.lit(0.0)) * 100)).when(relevant > 0, 100.0).otherwise(0.0)
    education = F.when(needed == 0, 100.0).when(schools == 0, 0.0).when(level >= needed, 100.0).otherwise(level / F.greatest(F.lit(1), needed) * 100)
    parts = {"skills": F.round(skills, 2), "experience": F.round(experience, 2), "education": education, "location": location, "salary": pay}
    overall = sum((parts[k] * w for k, w in RANKING_WEIGHTS.items()), F.lit(0.0))
    band = F.when(overall >= 80, "Excellent match").when(overall >= 60, "Good match").when(overall >= REJECTED_BELOW, "Partial match").otherwise("Poor match")
    return {f"{k}_score": v for k, v in parts.items()} | {"overall": overall, "band": band, "status": F.when(overall >= REJECTED_BELOW, "accepted").otherwise("rejected"), "missing": F.concat_ws(",", missing)}
