"""Normalization with a log of what was done."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType

from ..functions import normalize

OPERATION = "array<struct<field:string,normalizer:string,original:string,normalized:string>>"


def _of_one(field: str, name: str, normalizer: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.struct(F.lit(field).alias("field"), F.lit(name).alias("normalizer"), x.alias("original"), normalizer(x).alias("normalized"))


def _or_itself(normalizer: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(normalizer(x), x)


def logged(rows: DataFrame, applied: list[tuple[str, str, str, Callable[[Column], Column]]], log: str = "operations") -> DataFrame:
    """Normalizes columns in place and adds ``log``, the operations in the order of ``applied``.

    ``applied``: (column, field, normalizer's name, normalizer); a column is a text or a list of texts. A value that
    cannot be normalized stays as it is and leaves no operation; neither does null or a value that is normal already.
    """
    parts, changed = [], {}
    for column, field, name, normalizer in applied:
        c = F.col(column)
        many = isinstance(rows.schema[column].dataType, ArrayType)
        values = F.coalesce(c, F.array().cast("array<string>")) if many else F.array(c)
        parts.append(F.filter(F.transform(values, _of_one(field, name, normalizer)), lambda x: x["normalized"] != x["original"]).cast(OPERATION))
        changed[column] = F.transform(c, _or_itself(normalizer)) if many else _or_itself(normalizer)(c)
    return rows.withColumn(log, F.concat(*parts)).withColumns(changed)


def of_record() -> Column:
    """The operations that normalizing a whole record (:func:`weftline.operators.records.normalized`) takes, from its columns before: places, contacts, links, skills, jobs,
    schools, in this order. A value that is normal already, or cannot be normalized, leaves none."""

    def one(field: str, x: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), F.lit(normalize.NAMES[normalize.BY_FIELD[field]]).alias("normalizer"), x.alias("original"), normalize.field(field, x).alias("normalized"))

    def each(entries: str, parts: dict[str, str]) -> Column:
        return F.flatten(F.transform(entries, lambda x: F.array(*[one(field, x[name]) for field, name in parts.items()])))

    place = F.array(*[one(f"location.{n}", F.col("location")[n]) for n in ("city", "region", "country", "formatted")])
    contacts = F.transform("contacts", lambda c: F.when(c["kind"] == "email", one("contactInfo.email", c["value"])).when(c["kind"] == "phone", one("contactInfo.phone", c["value"])))
    skills = F.transform("skills", lambda s: one("skill.name", s))
    jobs = each("experiences", {"experience.employer": "employer", "experience.startDate": "start", "experience.endDate": "end"})
    schools = each("education", {"education.institution": "institution", "education.degree": "degree", "education.endDate": "end"})
    every = [F.coalesce(p.cast(OPERATION), F.array().cast(OPERATION)) for p in (place, contacts, each("links", {"socialLink.url": "url"}), skills, jobs, schools)]
    return F.filter(F.concat(*every), lambda x: x["normalized"] != x["original"])


def as_rows(rows: DataFrame, ids: list[str], log: str = "operations") -> DataFrame:
    """(ids, ord, field, normalizer, original, normalized): the log in long form."""
    return rows.select(*ids, F.posexplode(log).alias("ord", "_o")).select(*ids, "ord", "_o.*")
