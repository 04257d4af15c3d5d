"""Graded relevance of profiles to a request in free words. The request is read once, on the driver; profiles are scored by expressions."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.durations import years_of
from talentloom.functions.scoring import CITIES, PRIORITY_WEIGHTS, all_skills, either_way
from talentloom.functions.text import any_of

# Words of domains and skills, places, degrees, and how requests put numbers.
DOMAINS = {
    "fmcg": ("fmcg", "fast moving consumer goods", "consumer goods", "retail", "fmcg sales"),
    "it": ("it", "information technology", "software", "tech", "programming", "development"),
    "finance": ("finance", "banking", "accounting", "financial", "investment"),
    "healthcare": ("healthcare", "medical", "pharmaceutical", "pharma", "hospital"),
    "manufacturing": ("manufacturing", "production", "industrial", "factory"),
    "education": ("education", "teaching", "academic", "training", "university"),
    "sales": ("sales", "marketing", "business development", "account management"),
    "hr": ("hr", "human resources", "recruitment", "talent acquisition"),
    "operations": ("operations", "logistics", "supply chain", "procurement"),
}
SKILLS = (
    "python", "java", "javascript", "react", "angular", "node.js", "sql", "aws", "azure",
    "b2b sales", "b2c sales", "lead generation", "crm", "sales management",
    "digital marketing", "seo", "content marketing", "social media", "ppc",
    "financial analysis", "budgeting", "forecasting", "excel", "tally",
    "team management", "project management", "leadership", "strategy",
)
PLACES = (*CITIES, "kochi", "trivandrum")
DEGREES = ("mba", "bba", "engineering", "btech", "mtech", "bcom", "mcom", "graduate", "diploma")
NUMBER = r"(\d+(?:\.\d+)?)"
YEARS_FROM_TO = (rf"(?:between|from)\s+{NUMBER}\s*(?:to|-)\s*{NUMBER}\s*years?", rf"{NUMBER}\s*(?:to|-)\s*{NUMBER}\s*years?")
YEARS_AT_LEAST = (rf"minimum\s+{NUMBER}\s*years?", rf"at least\s+{NUMBER}\s*years?", rf"{NUMBER}\+\s*years?")
YEARS_ABOUT = (rf"{NUMBER}\s*years?\s*(?:of\s+)?(?:experience|exp)",)
LAKH_UP_TO = (rf"(?:salary|budget|package|ctc).*?(?:is|of|around|upto|up to)\s+{NUMBER}\s*lakh", rf"{NUMBER}\s*lakh.*?(?:salary|budget|package|ctc)")
LAKH_FROM_TO = (rf"{NUMBER}\s*(?:to|-)\s*{NUMBER}\s*lakh",)
ROLES = (
    r"(?:looking for|need|want|hire|hiring)\s+(?:a\s+)?([a-z\s]+?)(?:\s+with|\s+in|\s+having|$)",
    r"([a-z\s]+?)\s+(?:executive|manager|developer|analyst|specialist)",
    r"(?:position|role|job)\s+(?:of|for)\s+([a-z\s]+?)(?:\s+with|\s+in|$)",
)


@dataclass(frozen=True)
class Request:
    role: str | None = None
    domain: str | None = None
    skills: tuple[str, ...] = ()
    location: str | None = None
    min_years: float | None = None
    max_years: float | None = None
    max_lakh: float | None = None
    min_lakh: float | None = None
    education: tuple[str, ...] = ()
    notice: str | None = None


def _numbers(query: str, patterns: tuple[str, ...]) -> list[float]:
    for p in patterns:
        if found := re.search(p, query):
            return [float(x) for x in found.groups()]
    return []


def read_request(query: str) -> Request:
    """What a request asks for, as far as it can be told."""
    q = query.lower()
    said: dict = {}
    for p in ROLES:
        role = re.sub(r"\b(?:a|an|the|for|with|in|having)\b", "", found[1]).strip() if (found := re.search(p, q)) else ""
        if len(role) > 2:
            said["role"] = role
            break
    said["domain"] = next((d for d, words in DOMAINS.items() if any(w in q for w in words)), None)
    listed = re.search(r"(?:with|having|knows?|experience in|skilled in)\s+([a-z\s,&+-]+?)(?:\s+(?:experience|skills?)|$|[.\n])", q)
    labelled = re.search(r"skills?\s*[:\-]\s*([a-z\s,&+-]+?)(?:\n|$|[.])", q)
    own = [part for found in (listed, labelled) if found for part in re.split(r"[,&+]|\s+and\s+", found[1])]
    said["skills"] = tuple(dict.fromkeys([s for s in SKILLS if s in q] + [s.strip() for s in own if len(s.strip()) > 1]))
    if len(span := _numbers(q, YEARS_FROM_TO)) == 2:
        said["min_years"], said["max_years"] = span
    elif least := _numbers(q, YEARS_AT_LEAST):
        said["min_years"] = least[0]
    elif about := _numbers(q, YEARS_ABOUT):
        said["min_years"], said["max_years"] = about[0] - 0.5, about[0] + 0.5
    if most := _numbers(q, LAKH_UP_TO):
        said["max_lakh"] = most[0]
    elif len(span := _numbers(q, LAKH_FROM_TO)) == 2:
        said["min_lakh"], said["max_lakh"] = span
    said["location"] = next((p for p in PLACES if p in q), None)
    said["education"] = tuple(d.upper() for d in DEGREES if d in q)
    if found := re.search(r"(?:notice period|joining)\s+(?:of\s+)?(\d+\s*(?:days?|weeks?|months?))", q):
        said["notice"] = found[1]
    elif re.search(r"immediate|ready to join|can join", q):
        said["notice"] = "immediate"
    return Request(**said)


def expanded(r: Request) -> str:
    """The request as words for a text search: role, domain with its words, skills, place."""
    return " ".join(x for x in (r.role, r.domain, *DOMAINS.get(r.domain or "", ()), *r.skills, r.location, *r.education) if x)


def facts() -> dict[str, Column]:
    """What a relevance is made of, whatever the request, each read once from a profile: titles, labels, skills and what jobs say in lower case, places, years, salary."""
    pay = F.coalesce("expected_salary", F.lit(0.0))
    said = F.flatten(F.transform("experience", lambda e: F.array(*(F.lower(F.coalesce(e[k], F.lit(""))) for k in ("title", "company", "from_date", "until")))))
    return {
        "titles": F.transform("experience", lambda e: F.lower(F.coalesce(e["title"], F.lit("")))),
        "labels": F.transform("labels", F.lower),
        "own": F.transform(all_skills(), F.lower),
        "said": said,
        "city": F.lower("current_city"),
        "wishes": F.transform("looking_for", F.lower),
        "years": years_of(F.col("total_experience")),
        "pay": F.when(pay > 1_000_000, pay / 100_000).otherwise(pay),
    }


def _designation(r: Request, domain_words: tuple[str, ...], at: dict[str, Column]) -> Column:
    titles = at["titles"]
    parts = {}
    if r.role:
        whole, words = (lambda x: F.contains(x, F.lit(r.role))), r.role.split()
        some = lambda x: any_of(F.contains(x, F.lit(w)) for w in words)
        latest, recent = F.get(titles, F.lit(0)), F.slice(titles, 1, 3)
        parts["role"] = (
            F.when(F.coalesce(whole(latest) | some(latest), F.lit(False)), 1.0).when(F.exists(recent, whole), 0.8).when(F.exists(at["labels"], whole), 0.7)
            .when(F.exists(recent, some), 0.6).when(F.exists(at["own"], some), 0.4).otherwise(0.0)
        )
    if r.domain:
        said = F.concat(at["said"], at["own"], at["labels"])
        hits = F.aggregate(said, F.lit(0), lambda a, x: a + sum((F.contains(x, F.lit(w)).cast("int") for w in domain_words), F.lit(0)))
        parts["domain"] = F.least(F.lit(1.0), hits / max(1, len(domain_words)))
    if len(parts) == 2:
        return parts["role"] * 0.6 + parts["domain"] * 0.4
    return next(iter(parts.values()), F.lit(0.0))


def _experience(r: Request, own: Column) -> Column:
    low, high = r.min_years, r.max_years
    below = lambda: F.greatest(F.lit(0.0), 1 - (low - own) / low)
    if low and high:
        graded = F.when(own.between(low, high), 1.0).when(own < low, below()).when(own - high <= 2, 0.9).otherwise(0.7)
    elif low:
        graded = F.when(own >= low, 1.0).otherwise(below())
    elif high:
        graded = F.when(own <= high, 1.0).otherwise(F.greatest(F.lit(0.3), 1 - (own - high) / high))
    else:
        return F.lit(0.0)
    return F.when(own.isNull(), 0.0).otherwise(graded)


def _skills(r: Request, at: dict[str, Column]) -> Column:
    if not r.skills:
        return F.lit(0.0)
    words = F.filter(F.flatten(F.transform(at["said"], lambda x: F.split(x, r"\s+"))), lambda w: F.length(w) > 2)
    held = F.concat(at["own"], at["labels"])
    fits = lambda s: F.exists(held, lambda c: either_way(s, c)) | F.exists(words, lambda c: either_way(s, c))
    return sum((fits(F.lit(s)).cast("int") for s in r.skills), F.lit(0)) / len(r.skills)


def _salary(r: Request, pay: Column) -> Column:
    if not r.max_lakh:
        return F.lit(0.0)
    return F.when(pay == 0, 0.0).when(pay <= r.max_lakh, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (pay - r.max_lakh) / r.max_lakh))


def relevance(r: Request, similarity: Column | None = None, domains: dict[str, tuple[str, ...]] = DOMAINS, at: dict[str, Column] | None = None) -> dict[str, Column]:
    """Parts from 0 to 1, and their weighted sum with a share of the similarity; the similarity alone where nothing fits. ``at`` may be columns that hold ``facts`` already."""
    at = at or facts()
    similarity = F.lit(0.0) if similarity is None else similarity
    place = F.lit(r.location or "")
    located = F.when(F.contains(at["city"], place), 1.0).when(F.exists(at["wishes"], lambda x: F.contains(x, place)), 0.8).otherwise(0.0) if r.location else F.lit(0.0)
    parts = {"designation": _designation(r, domains.get(r.domain or "", ()), at), "location": located, "skills": _skills(r, at), "experience": _experience(r, at["years"]), "salary": _salary(r, at["pay"])}
    total = sum((parts[k] * w for k, w in PRIORITY_WEIGHTS.items()), F.lit(0.0))
    score = F.when(total > 0, F.when(similarity > 0, total * 0.7 + similarity * 0.3).otherwise(total)).otherwise(similarity)
    return parts | {"relevance": F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))}
