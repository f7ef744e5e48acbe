"""Field extraction from free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .normalize import blank_to_null, unique_ci

EMAIL = r"(?i)[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}"
PHONE = r"\+?[0-9][0-9\s().-]{7,}[0-9]"
URL = r"(?i)(?:https?://)?(?:www\.)?[a-z0-9.-]+\.[a-z]{2,}/[^\s,;|)]+"
NAME = r"^[A-Za-z][A-Za-z .'-]+$"


def extract_all(text: Column, pattern: str) -> Column:
    """All matches, trimmed, unique without case, in order; an empty array for null."""
    return unique_ci(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0)), lambda x: F.trim(x)))


def urls(text: Column) -> Column:
    """Addresses with a path, ``https://`` put before those without a scheme."""
    return unique_ci(F.transform(extract_all(text, URL), lambda u: F.when(F.rlike(u, F.lit(r"(?i)^https?://")), u).otherwise(F.concat(F.lit("https://"), u))))


def labeled(text: Column, *labels: str) -> Column:
    """What follows the first ``label:`` on its line, wherever it stands; labels in turn."""
    one = lambda label: blank_to_null(F.trim(F.regexp_extract(text, rf"(?iu){label}\s*:\s*([^\n\r]+)", 1)))
    return F.coalesce(*[one(x) for x in labels])


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


def first_name_line(text: Column) -> Column:
    return F.get(F.filter(lines(text), lambda x: (F.length(x) <= 80) & F.rlike(x, F.lit(NAME))), F.lit(0))


def platform(url: Column) -> Column:
    u = F.lower(url)
    return F.when(F.contains(u, F.lit("linkedin.com")), "linkedin").when(F.contains(u, F.lit("github.com")), "github").otherwise("portfolio")


#: A date range or one trailing date opens a job.
_DATE = r"(?:(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Sept|Oct|Nov|Dec)[a-z]*\.? )?(?:19|20)[0-9]{2}"
JOB_HEADER = rf"(?i)^(.*?)\s*\(?({_DATE})\s*(?:-|–|—|to)\s*({_DATE}|present|current|now)\)?\s*$"
BULLET = r"^[-•*–]\s*"
