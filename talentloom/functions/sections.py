"""The sections of a profile's text, as tables for ``nested.rendered`` and ``nested.sectioned``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talentloom.functions.nested import First, Joined, Section, Unless, rendered, title_case


def _labels(*fields: str) -> tuple[str, ...]:
    return tuple(f"{f.replace('_', ' ').title()}: {{{f}}}" for f in fields)


# Titles, labels and order of the sections of a spreadsheet row's text, and what ends it.
OF_A_ROW = (
    Section("PERSONAL INFORMATION", (First(("{name}", "{display_name}")), Joined(("{email}", "{phone}")), Joined(_labels("age", "gender", "marital_status"), only=True))),
    Section("CONTACT INFORMATION", (*_labels("email", "phone", "alternate_phone", "address"),)),
    Section("PROFESSIONAL SUMMARY", (First(("{professional_summary}", Joined((
        First(("Currently working as {current_role} at {current_company}", "Currently working as {current_role}", "Associated with {current_company}")),
        First(("with {experience} of professional experience", "with {experience_years} years of professional experience")),
    ), ". ", "."))),)),
    Section("WORK EXPERIENCE", (
        Joined(("Current Role: {current_role}", "Company: {current_company}", First(("Total Experience: {experience.formatted}", Unless("experience", "Total Experience: {experience_years} years")))), split=True, needs=("current_role", "current_company")),
        "Previous Company: {previous_company}",
    )),
    Section("SKILLS & EXPERTISE", (First(("Technical Skills: {technical_skills}", "Skills: {skills}")), "Soft Skills: {soft_skills}")),
    Section("EDUCATION", (First(("Highest Qualification: {highest_qualification}", "Education: {education}", "Degree: {degree}")), "College/University: {college}", Joined(("Year: {graduation_year}", "Grade: {percentage}")))),
    Section("SALARY & PREFERENCES", (Joined(_labels("current_salary", "expected_salary", "last_salary"), split=True), Joined(_labels("notice_period", "preferred_location", "work_mode"), split=True))),
    Section("ADDITIONAL INFORMATION", _labels("languages", "certifications", "projects", "achievements", "hobbies", "references")),
)
FOOTER = "\n\n---\nProfile generated from Excel data"

# The same for a stored profile, whose absent fields are shown.
ABSENT = "N/A"
OF_A_PROFILE = (
    Section("RESUME", ()),
    Section("PERSONAL INFORMATION", (
        "Name: {contact_details.name}", "Contact Details:", "  Email: {contact_details.email}", "  Phone: {contact_details.phone}", "  Alternative Phone: {contact_details.alternative_phone}", "  Current City: {contact_details.current_city}",
        "  Looking for jobs in: {contact_details.looking_for_jobs_in}", "  Gender: {contact_details.gender}", "  Age: {contact_details.age}", "  PAN Card: {contact_details.pan_card}", "  Aadhar Card: {contact_details.aadhar_card}",
    ), rule=19),
    Section("PROFESSIONAL SUMMARY", (
        "Total Experience: {total_experience} years", "Notice Period: {notice_period} days", "Current Salary: {currency} {current_salary} ({pay_duration})", "Expected Salary: {currency} {expected_salary} ({pay_duration})", "Hike Expected: {hike}%", "Last Working Day: {last_working_day}", "Exit Reason: {exit_reason}",
    ), rule=19),
    Section("SKILLS", ("Primary Skills: {skills}", "Additional Skills: {may_also_known_skills}", "Labels: {labels}"), rule=6),
    Section("PROFESSIONAL EXPERIENCE", ("Company: {company}", "Title: {title}", "Duration: {from_date} to {until:Present}"), each="experience", rule=22),
    Section("EDUCATION", ("Degree: {education}", "College: {college}", "Pass Year: {pass_year}"), each="academic_details", rule=9),
    Section("ADDITIONAL INFORMATION", ("Tier 1 MBA: {is_tier1_mba:No}", "Tier 1 Engineering: {is_tier1_engineering:No}", "Comments: {comment}"), rule=21),
    Section("PROFESSIONAL LINKS", ("Naukri Profile: {contact_details.naukri_profile}", "LinkedIn Profile: {contact_details.linkedin_profile}", "Portfolio: {contact_details.portfolio_link}"), rule=17),
)

# Sections of a row as JSON, name -> field.
JSON_SECTIONS = {title: {name: name for name in names.split()} for title, names in {
    "personal_information": "name display_name first_name last_name age date_of_birth gender marital_status",
    "contact_information": "email phone alternate_phone address city state country pincode location",
    "professional_summary": "current_role current_company experience experience_years",
    "work_experience": "current_role current_company previous_company experience_years",
    "skills_expertise": "technical_skills skills soft_skills skills_count",
    "education": "highest_qualification education degree college graduation_year percentage",
    "salary_preferences": "current_salary expected_salary last_salary notice_period preferred_location work_mode",
    "additional_information": "languages certifications projects achievements hobbies references",
}.items()}
JSON_SECTIONS["professional_summary"] = {"summary": "professional_summary"} | JSON_SECTIONS["professional_summary"]
JSON_SECTIONS["work_experience"] |= {"total_experience": "experience"}


def row_text(schema: StructType, style: str = "comprehensive") -> Column:
    """The text of a spreadsheet row with usual field names: runs of blanks and of blank lines as one, names capitalised, addresses in lower case. Empty for a row without fields."""
    text = F.coalesce(rendered(schema, OF_A_ROW, style, forms={"name": title_case, "email": F.lower}), F.lit(""))
    for pattern, to in ((r"\n\s*\n\s*\n", "\n\n"), (r"[ \t]+", " "), (r"\n[ \t]+", "\n"), (r"^\s+|\s+$", "")):
        text = F.regexp_replace(text, pattern, to)
    return F.concat(text, F.when(text != "", FOOTER).otherwise("")) if style == "comprehensive" else text


def profile_text(schema: StructType) -> Column:
    """The text of a stored profile, all sections."""
    return F.concat(F.lit("\n"), rendered(schema, OF_A_PROFILE, absent=ABSENT), F.lit("\n"))
