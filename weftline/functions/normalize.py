"""Scalar normalizers as native expressions: null where the value cannot be normalized."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..config import CITIES, COUNTRIES, DEGREES, MONTH_SHORT, MONTHS, SKILLS
from .phones import in_plan


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def clean(c: Column) -> Column:
    """Control characters dropped, trimmed."""
    return F.trim(F.regexp_replace(c, r"[\x00-\x1F]", ""))


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def title_case(c: Column) -> Column:
    return F.initcap(collapsed(c))


def email(c: Column) -> Column:
    e = F.lower(clean(c))
    return F.when(F.rlike(e, F.lit(r"^[^\s@]+@[^\s@]+\.[^\s@]+\z")), e)


def phone_e164(c: Column) -> Column:
    """``+`` and 8 to 15 digits after separators go, with a calling code and as many digits as its numbers have; a leading 00 counts as ``+``."""
    digits = F.regexp_replace(F.regexp_replace(clean(c), r"^00", "+"), r"[\s().-]", "")
    return once(digits, lambda p: F.when(F.rlike(p, F.lit(r"^\+[0-9]{8,15}\z")) & in_plan(p), p))


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once; inside lambda functions Spark computes an expression as often as it is written."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


# The number of each month's whole and short names.
MONTH_NUMBERS = {n: f"{i:02d}" for i, name in enumerate(MONTHS, 1) for n in (name, *MONTH_SHORT.get(name, (name[:3],)))}


def date_ym(c: Column) -> Column:
    """YYYY-MM from YYYY-MM, YYYY, M/YYYY or a month name (whole or short, without a dot) and year."""

    def read(d: Column) -> Column:
        slash = F.regexp_extract(d, r"^([0-9]{1,2})/[0-9]{4}$", 1)
        number = F.try_element_at(_map(MONTH_NUMBERS), F.regexp_extract(d, r"^([a-z]+) ([0-9]{4})$", 1))
        return (
            F.when(F.rlike(d, F.lit(r"^[0-9]{4}-[0-9]{2}$")), d)
            .when(F.rlike(d, F.lit(r"^[0-9]{4}$")), F.concat(d, F.lit("-01")))
            .when(slash != "", F.concat(F.substring(d, -4, 4), F.lit("-"), F.lpad(slash, 2, "0")))
            .otherwise(F.concat(F.substring(d, -4, 4), F.lit("-"), number))
        )

    return once(F.lower(collapsed(clean(c))), read)


def _aliased(c: Column, aliases: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(aliases), F.lower(collapsed(c))), otherwise)


def skill(c: Column) -> Column:
    return _aliased(clean(c), SKILLS, title_case(clean(c)))


def city(c: Column) -> Column:
    return _aliased(clean(c), CITIES, title_case(clean(c)))


def country(c: Column) -> Column:
    return _aliased(clean(c), COUNTRIES, F.upper(collapsed(clean(c))))


def company(c: Column) -> Column:
    return collapsed(clean(c))


def degree(c: Column) -> Column:
    return _aliased(clean(c), DEGREES, collapsed(clean(c)))


def free_text(c: Column) -> Column:
    """Control characters are dropped without a space in their place."""
    return blank_to_null(collapsed(clean(c)))


def url(c: Column) -> Column:
    """Scheme added, scheme and host in lower case, default port and one trailing slash dropped."""

    def read(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z]+)://", 1))
        host = F.lower(F.regexp_extract(u, r"^[A-Za-z]+://([^/?#]*)", 1))
        port = F.when(scheme == "http", r":80").otherwise(":443")
        host = F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
        rest = F.regexp_extract(u, r"^[A-Za-z]+://[^/?#]*(.*)$", 1)
        rest = F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))
        whole = F.concat(scheme, F.lit("://"), host, rest)
        return F.when(F.rlike(host, F.lit(r"^[^\s]+$")), F.regexp_replace(whole, "/$", ""))

    return once(once(clean(c), lambda u: F.when(F.rlike(u, F.lit(r"(?i)^https?://")), u).otherwise(F.concat(F.lit("https://"), u))), read)


def safely(normalizer, c: Column) -> Column:
    """The normalized value, or the original where it cannot be normalized."""
    return F.coalesce(normalizer(c), c)


def split_values(c: Column) -> Column:
    """Parts between ; , and |, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, r"[;,|]"), lambda x: F.trim(x)), lambda x: x != "")


def unique_ci(a: Column) -> Column:
    """First spelling of each value, compared without case, in order; sorted once, not compared in pairs."""
    keyed = F.array_sort(F.transform(a, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = F.flatten(F.transform(F.array(keyed), lambda s: F.filter(s, lambda e, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(e["k"]))))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


#: Which normalizer serves which field.
BY_FIELD = {
    "contactInfo.phone": phone_e164, "contactInfo.email": email, "experience.startDate": date_ym, "experience.endDate": date_ym,
    "education.startDate": date_ym, "education.endDate": date_ym, "skill.name": skill, "location.city": city, "location.region": city,
    "location.formatted": city, "location.country": country, "experience.employer": company, "education.institution": company,
    "socialLink.url": url, "education.degree": degree,
}


#: What a normalization is logged as.
NAMES = {
    phone_e164: "PhoneNormalizer", email: "EmailNormalizer", date_ym: "DateNormalizer", skill: "SkillNormalizer", city: "LocationNormalizer", country: "LocationNormalizer",
    company: "CompanyNormalizer", url: "UrlNormalizer", degree: "EducationNormalizer",
}


def field(name: str, c: Column) -> Column:
    """The value of a named field, normalized where that can be done, else as it is."""
    if name not in BY_FIELD:
        raise KeyError(f"no normalizer for field {name!r}")
    return safely(BY_FIELD[name], c)
