"""What rules read out of a resume's text, several readings merged, and experience added up."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from talentloom.functions.extraction import EMAIL
from talentloom.functions.text import holds, once

# Defaults, section heads, and how names, cities, titles, degrees and dates are written.
NO_EMAIL, NO_PHONE, NO_NAME, NO_CITY, NO_TITLE, NO_COLLEGE = "noemail@notprovided.com", "+91-0000000000", "Name Not Found", "City not specified", "Position not specified", "Institution not specified"
PHONE = r"(?:\+?\d{1,3}[-.\s]?)?\(?\d{3,4}\)?[-.\s]?\d{3,4}[-.\s]?\d{3,4}"
CITIES = (r"(?i)(?:city|location|address):\s*([A-Za-z\s,]+)", r"(?i)\b([A-Za-z]+(?:\s+[A-Za-z]+)*),\s*(?:India|IN)\b", r"(?i)\b([A-Za-z]+(?:\s+[A-Za-z]+)*)\s*-\s*\d{6}\b")
WORK_HEADS, WORK_WORDS = "EXPERIENCE|WORK|EMPLOYMENT|PROFESSIONAL", ("EXPERIENCE", "WORK", "EMPLOYMENT")
STUDY_WORDS, SKILL_WORDS = ("EDUCATION", "ACADEMIC", "QUALIFICATION"), ("SKILLS", "TECHNOLOGIES", "EXPERTISE", "PROFICIENT")
TITLES = ("engineer", "developer", "manager", "analyst", "consultant")
DEGREE = r"(?i)(?:B\.?Tech|Bachelor|B\.?E\.?|M\.?Tech|Master|MBA|M\.?S\.?|Ph\.?D\.?|Diploma|Certificate)[^\n]*"
DATE = r"(?i)\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4}\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b|\b\d{4}\b"
DATE_FORMS = ("MMMM yyyy", "MMM yyyy", "MM/yyyy", "yyyy-MM-dd", "dd/MM/yyyy", "yyyy", "MM-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "dd-MM-yyyy", "MMM d,yyyy", "MM/yy")
SPANS = (r"(\w+\s+\d{4})\s*[-–]\s*(\w+\s+\d{4}|present|current)", r"(\d{1,2}/\d{4})\s*[-–]\s*(\d{1,2}/\d{4}|present|current)", r"(?<![A-Za-z.][ \t])(?<![/\d])(\d{4})\s*[-–]\s*(\d{4}|present|current)")
OPEN_ENDS = ("present", "current", "now")
LEAST_ENTRY, SECTION_LINES = 20, 10


def shape(form: str) -> str:
    """A pattern that every text fits which a form of date reads; some others may fit it too."""
    parts = {"M": lambda n: r"\p{L}+" if n > 2 else r"\d{2}", "y": lambda n: r"[+-]?\d{4,}" if n > 2 else r"\d{2}", "d": lambda n: r"\d{2}" if n > 1 else r"[+-]?\d+"}
    return "^" + "".join(parts[x[0]](len(x)) if x[0] in parts else re.escape(x) for x in re.findall(r"M+|y+|d+|.", form)) + "$"


def day(text: Column, as_of: str) -> Column:
    """A date of one of twelve spellings, or ``as_of`` for one that means now; null for others. Only forms whose shape a text has are tried, as a failure to read costs far more than a look."""

    def read(said: Column) -> Column:
        found = F.coalesce(*(F.when(said.rlike(shape(w)), F.try_to_timestamp(said, F.lit(w))) for w in DATE_FORMS)).cast("date")
        return F.when(F.lower(said).isin(*OPEN_ENDS), F.to_date(F.lit(as_of))).otherwise(found)

    return once(F.trim(text), read)


def whole_months(start: Column, end: Column) -> Column:
    """Full months from one day to another, 0 at least."""
    return F.greatest(F.lit(0), F.floor(F.months_between(end, start)).cast("int"))


def months_of_entry(duration: Column, start: Column, end: Column, as_of: str) -> Column:
    """Months of a job: from its duration in words, else from its dates, else from a start some time ago."""
    said, begun = F.lower(F.coalesce(duration, F.lit(""))), F.lower(F.coalesce(start, F.lit("")))
    n = lambda text, unit: F.coalesce(F.regexp_extract(text, rf"(\d+)\s*(?:{unit})", 1).try_cast("int"), F.lit(0))
    told = F.when(~said.rlike("present|current"), n(said, "year|yr|y") * 12 + n(said, "month|mon|m")).otherwise(0)
    dated = F.coalesce(whole_months(day(start, as_of), F.coalesce(day(end, as_of), F.to_date(F.lit(as_of)))), F.lit(0))
    amount = F.regexp_extract(begun, r"(\d+)", 1).try_cast("int")
    ago = F.when(F.contains(begun, F.lit("ago")), F.when(F.contains(begun, F.lit("year")), amount * 12).when(F.contains(begun, F.lit("month")), amount))
    return F.when(told > 0, told).when(dated > 0, dated).otherwise(F.coalesce(ago, F.lit(0)))


def spelled_out(months: Column) -> Column:
    """"2 years and 1 month"; "No experience" for none."""
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s")))
    years, rest = F.floor(months / 12).cast("int"), (months % 12).cast("int")
    return F.when(months > 0, F.concat_ws(" and ", part(years, "year"), part(rest, "month"))).otherwise("No experience")


def months_by_spans(text: Column, as_of: str) -> Column:
    """Months summed over the spans of dates that the section on experience names, or the whole text where there is none; each span counts once."""

    def added(said: Column) -> Column:
        total = F.lit(0)
        for pattern in SPANS:
            starts, ends = (F.regexp_extract_all(said, F.lit(f"(?i){pattern}"), F.lit(k)) for k in (1, 2))
            months = F.zip_with(starts, ends, lambda a, b: F.coalesce(whole_months(day(a, as_of), day(b, as_of)), F.lit(0)))
            total = total + F.aggregate(months, F.lit(0), lambda s, m: s + m)
        return total

    section = F.regexp_extract(text, r"(?is)(?:EXPERIENCE|EMPLOYMENT)(.+?)(?=EDUCATION|SKILLS|PROJECTS|$)", 1)
    return once(F.initcap(F.lower(once(section, lambda x: F.when(x != "", x).otherwise(text)))), added)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def contact(text: Column) -> Column:
    """``email, phone, name, city`` with defaults: the first of each; the name from the first lines, the city from its usual places."""
    email = F.regexp_extract(text, rf"\b({EMAIL})\b", 1)
    digits = F.regexp_replace(F.regexp_extract(text, f"({PHONE})", 1), r"[^\d+]", "")
    says = lambda x: holds(x, "email", "phone", "address", "@")
    named = F.filter(F.transform(F.slice(_lines(text), 1, 5), lambda x: F.trim(x)), lambda x: ~says(x) & x.rlike(r"^[A-Za-z\s]{2,50}$") & (F.size(F.split(x, r"\s+")) <= 4))
    city = F.coalesce(*(F.nullif(F.trim(F.regexp_replace(F.regexp_extract(text, p, 1), r"^\s+|\s+$", "")), F.lit("")) for p in CITIES), F.lit(NO_CITY))
    return F.struct(
        F.when(email != "", email).otherwise(NO_EMAIL).alias("email"),
        F.when(digits == "", NO_PHONE).when(F.startswith(digits, F.lit("+")), digits).otherwise(F.concat(F.lit("+91"), digits)).alias("phone"),
        F.coalesce(F.get(named, F.lit(0)), F.lit(NO_NAME)).alias("name"), city.alias("city"),
    )


def _job(entry: Column, as_of: str) -> Column:
    def read(e: Column) -> Column:
        lines, at, dash = e["lines"], e["at"], e["dash"]
        below = F.get(F.filter(F.slice(lines, 2, 2), lambda x: holds(x, *TITLES)), F.lit(0))
        start, end = F.get(e["months"], F.lit(0)), F.get(e["months"], F.lit(1))
        two = F.size(at) > 1
        return F.struct(
            F.trim(F.when(two, at[0]).when(F.size(dash) > 1, dash[1]).otherwise(F.coalesce(below, F.lit(NO_TITLE)))).alias("title"),
            F.trim(F.when(two, at[1]).otherwise(dash[0])).alias("company"),
            F.coalesce(start, F.lit("2020-01")).alias("from_date"), end.alias("until"), end.isNull().alias("is_current"),
        )

    first = F.trim(F.substring_index(entry, "\n", 1))
    dates = F.slice(F.regexp_extract_all(entry, F.lit(DATE), F.lit(0)), 1, 2)
    months = F.transform(dates, lambda x: F.date_format(day(x, as_of), "yyyy-MM"))
    return once(F.struct(_lines(entry).alias("lines"), F.split(first, " at ").alias("at"), F.split(first, " - ").alias("dash"), months.alias("months")), read)


def jobs(text: Column, as_of: str) -> Column:
    """The jobs that sections on work list: title and company of an entry's first line, its first two dates. Entries of under 20 characters, and heads, are passed over."""
    sections = F.filter(F.split(text, rf"(?i)\n(?=\s*(?:{WORK_HEADS}))"), lambda x: holds(x, *WORK_WORDS))
    bodies = F.transform(sections, lambda x: F.regexp_replace(x, rf"(?i)^\s*(?:(?:{WORK_HEADS})\s*)+:?[ \t]*(?=\n|$)", ""))
    entries = F.flatten(F.transform(bodies, lambda x: F.split(x, r"\n[ \t]*\n\s*(?=\w)")))
    entries = F.filter(F.transform(entries, lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.length(x) >= LEAST_ENTRY)
    return F.transform(entries, lambda x: _job(x, as_of))


def _section(text: Column, words: tuple[str, ...]) -> Column:
    """The first line with one of the words and the nine after it; empty without."""
    lines = _lines(text)
    flags = F.transform(lines, lambda x: holds(x, *words))
    at = F.array_position(flags, True).cast("int")
    return F.when(at > 0, F.array_join(F.slice(lines, at, F.lit(SECTION_LINES)), "\n")).otherwise("")


def degrees(text: Column, as_of_year: int) -> Column:
    """``education, college, pass_year`` of every line of the section on education that names a degree."""
    found = F.regexp_extract_all(_section(text, STUDY_WORDS), F.lit(DEGREE), F.lit(0))
    last_year = lambda x: F.element_at(F.concat(F.array(F.lit(str(as_of_year))), F.regexp_extract_all(x, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0))), -1)
    return F.transform(found, lambda x: F.struct(x.alias("education"), F.lit(NO_COLLEGE).alias("college"), last_year(x).cast("int").alias("pass_year")))


def skills(text: Column, vocabulary: tuple[str, ...]) -> Column:
    """The parts of the section on skills (2 to 29 characters), and the vocabulary's entries that the text contains; capitalised, each once, in order."""
    body = F.regexp_replace(_section(text, SKILL_WORDS), r"(?i)^\s*(?:skills?|technologies?|expertise):?\s*", "")
    parts = F.transform(F.split(body, r"[,;|/•\n\t]+"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"[^\w\s+#.-]", "")))
    listed = F.transform(F.filter(parts, lambda x: F.length(x).between(2, 29)), lambda x: F.initcap(x))
    named = F.array_compact(F.array(*(F.when(holds(text, w), F.initcap(F.lit(w))) for w in vocabulary))) if vocabulary else F.array().cast("array<string>")
    return F.array_sort(F.array_union(listed, named))


def merged_skills(*methods: Column) -> Column:
    """The union of what several methods found; null is nothing."""
    out = F.array().cast("array<string>")
    for m in methods:
        out = F.array_union(out, F.coalesce(m, F.array().cast("array<string>")))
    return F.array_sort(out)


def merged_jobs(*methods: Column) -> Column:
    """The jobs of several methods, in the methods' order; of those with the same company and title, whatever their case, the first."""
    name = lambda x: F.struct(F.lower(F.trim(x["company"])).alias("company"), F.lower(F.trim(x["title"])).alias("title"))
    firsts = lambda named: F.filter(named["jobs"], lambda x, i: F.array_position(named["names"], F.get(named["names"], i)) == i + 1)
    return once(F.flatten(F.array(*methods)), lambda every: once(F.struct(every.alias("jobs"), F.transform(every, name).alias("names")), firsts))


def merged_contact(*methods: Column) -> Column:
    """The contact of the first method that has one."""
    return F.coalesce(*methods)


def skill_gaps(wanted: Column, own: Column) -> Column:
    """``matched, missing, additional``: wanted skills that some own one contains or is contained in, the others, and own ones that fit none."""
    low = lambda xs: F.transform(xs, lambda x: F.lower(F.trim(x)))
    wanted, own = low(wanted), low(own)
    fits = lambda x, ys: F.exists(ys, lambda y: F.contains(x, y) | F.contains(y, x))
    return F.struct(F.filter(wanted, lambda x: fits(x, own)).alias("matched"), F.filter(wanted, lambda x: ~fits(x, own)).alias("missing"), F.filter(own, lambda x: ~fits(x, wanted)).alias("additional"))


def highlights(years: Column, own: Column, expected: Column, wanted: tuple[str, ...], least: float | None, most: float | None, lakhs: float | None) -> Column:
    """What of a profile meets a request: experience against its bounds, skills with their share, and the salary in lakhs against its limit."""
    fit = F.lit(None).cast("string")
    if least and most:
        fit = F.when(years.between(least, most), "PERFECT_MATCH").otherwise("OUT_OF_RANGE")
    elif least:
        fit = F.when(years >= least, "MEETS_MINIMUM").otherwise("BELOW_MINIMUM")
    asked = F.array(*map(F.lit, wanted)).cast("array<string>")
    matched = F.filter(asked, lambda s: F.exists(own, lambda c: F.contains(F.lower(s), F.lower(c)) | F.contains(F.lower(c), F.lower(s))))
    pay = F.when(expected > 1_000_000, expected / 100_000).otherwise(expected)
    return F.struct(
        years.alias("experience_years"), F.when(years.isNotNull(), fit).alias("experience_match"), matched.alias("matched_skills"), (F.size(matched) / max(1, len(wanted))).alias("skills_match_ratio"),
        pay.alias("expected_lakhs"), (pay <= lakhs if lakhs else F.lit(None).cast("boolean")).alias("within_budget"),
    )
