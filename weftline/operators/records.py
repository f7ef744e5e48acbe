"""Whole records: what names them, normalization of all they hold, their sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SOURCE_PRIORITY
from ..functions import normalize
from ..functions.ids import det_id
from .generic import serialized

VERSION = "1.0.0"


def _given(*parts: Column) -> Column:
    return F.filter(F.array(*parts), lambda x: F.trim(x) != "")


def display_name(full: Column, first: Column, middle: Column, last: Column) -> Column:
    """The full name, else first, middle and last name; null without any."""
    parts = _given(first, middle, last)
    return F.when(full != "", full).when(F.size(parts) > 0, F.array_join(parts, " "))


def primary_employer(experiences: Column) -> Column:
    """The employer of the first current job, else of the first job."""
    current = F.get(F.filter(experiences, lambda x: x["is_current"]), F.lit(0))
    return F.coalesce(current["employer"], F.get(experiences, F.lit(0))["employer"])


def location_fingerprint(location: Column, fields: tuple[str, ...] = ("formatted", "city", "region", "country")) -> Column:
    """A place's filled fields joined by bars; null without any."""
    parts = _given(*[location[f] for f in fields])
    return F.when(F.size(parts) > 0, F.array_join(parts, "|"))


def unique_by(a: Column, key: Callable[[Column], Column]) -> Column:
    """The first entry of each key, in order: entries are sorted by key once, not compared in pairs."""
    keyed = F.array_sort(F.transform(a, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))), lambda p, q: _by(p, q))
    first = F.flatten(F.transform(F.array(keyed), lambda s: F.filter(s, lambda e, j: (j == 0) | ~F.get(s, j - 1)["k"].eqNullSafe(e["k"]))))
    return F.transform(F.array_sort(first, lambda p, q: (p["i"] - q["i"])), lambda e: e["x"])


def _by(p: Column, q: Column) -> Column:
    k = F.when(p["k"].eqNullSafe(q["k"]), 0).when(p["k"].isNull(), 1).when(q["k"].isNull(), -1).when(p["k"] < q["k"], -1).otherwise(1)
    return F.when(k != 0, k).otherwise(p["i"] - q["i"])


def unique_contacts(contacts: Column) -> Column:
    return unique_by(contacts, lambda c: F.concat(c["kind"], F.lit(":"), F.lower(c["value"])))


def unique_links(links: Column) -> Column:
    return unique_by(links, lambda x: F.concat(x["platform"], F.lit(":"), F.lower(x["url"])))


def normalized(records: DataFrame) -> DataFrame:
    """Records with every field normalized, nested ones too, and contacts, links and skills each once.

    A value that cannot be normalized stays as it is. E-mails and phones go by their kind, other contacts stay; jobs'
    and schools' dates become months; titles, descriptions and fields of study are free text.
    """
    safe = normalize.safely
    contact = lambda c: c.withField("value", F.when(c["kind"] == "email", safe(normalize.email, c["value"])).when(c["kind"] == "phone", safe(normalize.phone_e164, c["value"])).otherwise(c["value"]))
    link = lambda x: x.withField("url", safe(normalize.url, x["url"]))

    def fields(x: Column, **how: Callable[[Column], Column]) -> Column:
        out = x  # read from the given record: a field of a changed one would carry the change along in its expression
        for name, normalizer in how.items():
            out = out.withField(name, safe(normalizer, x[name]) if normalizer is not normalize.free_text else normalizer(x[name]))
        return out

    job = lambda x: fields(x, employer=normalize.company, start=normalize.date_ym, end=normalize.date_ym, title=normalize.free_text, description=normalize.free_text)
    if "skills" in records.schema["experiences"].dataType.elementType.names:
        plain_job, job = job, lambda x: plain_job(x).withField("skills", unique_by(F.transform(x["skills"], lambda s: safe(normalize.skill, s)), F.lower))
    school = lambda x: fields(x, institution=normalize.company, degree=normalize.degree, end=normalize.date_ym, field=normalize.free_text)
    place = F.when(F.col("location").isNotNull(), fields(F.col("location"), city=normalize.city, region=normalize.city, formatted=normalize.city, country=normalize.country))
    texts = {c: normalize.free_text(F.col(c)) for c in ("first_name", "last_name", "full_name", "headline", "summary")}
    return records.withColumns(
        {
            **texts,
            "location": place,
            "contacts": unique_contacts(F.transform("contacts", contact)),
            "links": unique_links(F.transform("links", link)),
            "experiences": F.transform("experiences", job),
            "education": F.transform("education", school),
            "skills": unique_by(F.transform("skills", lambda s: safe(normalize.skill, s)), F.lower),
        }
    )


SOURCE = ("source_id", "source_type", "source_name", "file_name", "mime_type", "received_at", "parser", "extractor", "metadata")


def source_record_id() -> Column:
    """The id that a source's nine attributes name, metadata as JSON."""
    return det_id("source-record", *[F.col(c) for c in SOURCE])


def source_registry(sources: DataFrame, group: str = "group_ix", order: str = "candidate_ix") -> tuple[DataFrame, DataFrame]:
    """(registry, ids): each group's distinct sources under their stable ids, with ``ord`` the first place of each; and the stable id of each old one.

    ``sources``: group, order, id and the attributes ``SOURCE``. A null attribute counts as empty.
    """
    s = sources.withColumn("stable_id", source_record_id())
    attributes = F.struct(*SOURCE).alias("x")
    registry = s.groupBy(group, "stable_id").agg(F.min(order).alias("ord"), F.min_by(attributes, order).alias("x")).select(group, F.col("stable_id").alias("id"), "ord", "x.*")
    return registry, s.select(group, F.col("id").alias("old_id"), "stable_id").distinct()


def best_source(sources: Column) -> Column:
    """The first source of the best rank of array<struct<rank, id>>."""
    return F.array_min(F.transform(sources, lambda s, i: F.struct(s["rank"].alias("rank"), i.alias("i"), s["id"].alias("id"))))["id"]


def primary_source(provenance: Column, source_ids: Column) -> Column:
    """The first winner of the first entry that has winners, else the first entry's source, else the record's first source."""
    won = F.get(F.filter(provenance, lambda p: F.size(p["winners"]) > 0), F.lit(0))
    return F.coalesce(F.get(won["winners"], F.lit(0)), F.get(provenance, F.lit(0))["source"], F.get(source_ids, F.lit(0)))


def contact_value(path: Column, contacts: Column, other: Column) -> Column:
    """The value that a history entry about a contact path speaks of: the first contact of its kind; else ``other``."""
    of = lambda kind: F.get(F.filter(contacts, lambda c: c["kind"] == kind), F.lit(0))["value"]
    return F.when(path == "contactInfo.email", of("email")).when(path == "contactInfo.phone", of("phone")).otherwise(other)


def candidate_metadata(candidate_id: Column, sources: Column, fields: Column, updated_at: Column) -> Column:
    """struct<candidate_id, versions, processing times, merged_sources, totals>; processing begins and ends at the last update, so it takes no time."""
    versions = [F.lit(VERSION).alias(f"{x}_version") for x in ("pipeline", "schema", "projection")]
    return F.struct(
        candidate_id.alias("candidate_id"), *versions, updated_at.alias("started_at"), updated_at.alias("ended_at"), F.lit(0).cast("long").alias("duration_ms"),
        sources.alias("merged_sources"), F.size(sources).cast("long").alias("total_sources"), fields.cast("long").alias("total_fields"),
    )


def rank_of(source_type: Column) -> Column:
    """A source type's place in the order of trust."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in SOURCE_PRIORITY]), source_type), F.lit(0).cast("long")) - 1, F.lit(len(SOURCE_PRIORITY)).cast("long")).cast("int")


def as_text(rows: DataFrame, column: str) -> Column:
    """A column of any type as comparable text."""
    return serialized(F.col(column), rows.schema[column].dataType)
