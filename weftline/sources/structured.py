"""Structured files to person records: delimited rows with differing headers, and nested JSON records.

Records have the columns of ``RECORD``; what a source does not give is null or an empty array.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.normalize import blank_to_null, split_values
from .files import MAX_BYTES, contents

CONTACTS = "array<struct<kind:string,value:string,is_primary:boolean>>"
LINKS = "array<struct<platform:string,url:string>>"
JOBS = "array<struct<employer:string,title:string,description:string,start:string,end:string,is_current:boolean,skills:array<string>>>"
SCHOOLS = "array<struct<institution:string,degree:string,field:string,end:string>>"
LOCATION = "struct<raw:string,city:string,region:string,country:string,formatted:string>"
RECORD = ("first_name", "last_name", "full_name", "headline", "summary", "location", "contacts", "links", "experiences", "education", "skills")

# Header names of a field, in order of preference.
HEADERS = {
    "full_name": ("full_name", "fullname", "name", "candidate_name"),
    "email": ("email", "emails", "email_address"),
    "phone": ("phone", "phone_number", "mobile", "contact_number"),
    "skills": ("skills", "skill", "technologies"),
    "city": ("city", "location_city"),
    "region": ("region", "state", "location_region"),
    "country": ("country", "location_country"),
    "linkedin": ("linkedin", "linkedin_url"),
    "github": ("github", "github_url"),
    "portfolio": ("portfolio", "website", "personal_site"),
    "company": ("current_company", "company", "employer"),
    "title": ("headline", "title", "current_title"),
    "school": ("school", "institution", "university", "college"),
    "degree": ("degree",),
    "field": ("field", "major", "field_of_study"),
    "graduated": ("grad_year", "graduation_year", "end_year"),
    "start": ("start", "start_date", "current_start"),
    "end": ("end", "end_date", "current_end"),
    "summary": ("summary", "profile_summary", "notes"),
}


def _rows_of(text: str | None) -> Iterator[tuple[int | None, list[tuple[str, str]], str | None]]:
    """(row number, cells, error) of one delimited file; an error is one row without cells."""
    csv.field_size_limit(MAX_BYTES)
    try:
        rows = [r for r in csv.reader(io.StringIO((text or "").strip(), newline=""), strict=True) if any(c.strip() for c in r)]
    except csv.Error as e:
        yield None, [], f"malformed: {e}"
        return
    header = [h.strip() for h in rows[0]] if rows else []
    if not header or "" in header:
        yield None, [], "malformed: empty headers"
    elif len(set(header)) < len(header):
        yield None, [], "malformed: duplicate headers"
    elif any(len(r) != len(header) for r in rows):
        yield None, [], "malformed: rows of differing lengths"
    else:
        for i, r in enumerate(rows[1:]):
            yield i, [(h, c.strip()) for h, c in zip(header, r, strict=True)], None


def csv_rows(files: DataFrame) -> DataFrame:
    """(path, row_no, cells MAP, error) of delimited files, or of their :func:`weftline.sources.files.contents`. Files are parsed one at a time; admission bounds their size."""

    def batch(batches):
        for b in batches:
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = list(_rows_of(text))
                kinds = [pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
                columns = [[path] * len(rows), *map(list, zip(*rows, strict=True))] if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "row_no", "cells", "error"])

    return contents(files).filter("parser = 'CsvParser' and text is not null").select("path", "text").mapInArrow(batch, "path string, row_no long, cells map<string,string>, error string")


def _compact(*items: tuple[Column, Column]) -> Column:
    """An array of the items whose condition holds."""
    return F.filter(F.array(*[F.when(c, x) for c, x in items]), lambda x: x.isNotNull())


def _contacts(emails: Column, phones: Column) -> Column:
    one = lambda kind, first: lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), ((i == 0) & first).alias("is_primary"))
    return F.concat(F.transform(emails, one("email", F.lit(True))), F.transform(phones, one("phone", F.size(emails) == 0))).cast(CONTACTS)


def _links(linkedin: Column, github: Column, portfolio: Column) -> Column:
    given = (("linkedin", linkedin), ("github", github), ("portfolio", portfolio))
    return _compact(*[(u.isNotNull(), F.struct(F.lit(p).alias("platform"), u.alias("url"))) for p, u in given]).cast(LINKS)


def _or_empty(a: Column) -> Column:
    return F.coalesce(a, F.array().cast("array<string>"))


def csv_records(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Adds the record columns to rows of header-to-cell maps; headers match without case, blank cells count as missing."""
    # two headers that differ in case only: the first one stands
    first = F.filter(F.map_entries(cells), lambda e: blank_to_null(e["value"]).isNotNull())
    names = F.transform(first, lambda e: F.lower(F.trim(e["key"])))
    once = F.filter(first, lambda e, i: F.array_position(names, F.lower(F.trim(e["key"]))) == i + 1)
    lowered = F.map_from_entries(F.transform(once, lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))))
    read = rows.withColumn("_cells", lowered)
    of = {field: F.coalesce(*[F.col("_cells")[name] for name in names_]) for field, names_ in HEADERS.items()}
    emails, phones = (_or_empty(split_values(of[x])) for x in ("email", "phone"))
    place = F.concat_ws(", ", of["city"], of["region"], of["country"])
    location = F.when(place != "", F.struct(F.lit(None).alias("raw"), of["city"].alias("city"), of["region"].alias("region"), of["country"].alias("country"), place.alias("formatted")).cast(LOCATION))
    job = F.struct(of["company"].alias("employer"), of["title"].alias("title"), F.lit(None).alias("description"), of["start"].alias("start"), of["end"].alias("end"), of["end"].isNull().alias("is_current"), F.array().cast("array<string>").alias("skills"))
    school = F.struct(of["school"].alias("institution"), of["degree"].alias("degree"), of["field"].alias("field"), of["graduated"].alias("end"))
    columns = {
        "first_name": F.lit(None).cast("string"), "last_name": F.lit(None).cast("string"), "full_name": of["full_name"], "headline": of["title"], "summary": of["summary"], "location": location,
        "contacts": _contacts(emails, phones), "links": _links(of["linkedin"], of["github"], of["portfolio"]),
        "experiences": _compact((of["company"].isNotNull(), job)).cast(JOBS), "education": _compact((of["school"].isNotNull(), school)).cast(SCHOOLS), "skills": _or_empty(split_values(of["skills"])),
    }
    return read.withColumns(columns).drop("_cells")


def present(v: Column, *keys: str) -> Column:
    """The first of the keys that is there and not null, as VARIANT; a blank one counts as there."""
    got = [F.try_variant_get(v, f"$.{k}", "variant") for k in keys]
    return F.coalesce(*[F.when(~F.is_variant_null(x), x) for x in got])


def _is(v: Column, kind: str) -> Column:
    return F.startswith(F.schema_of_variant(v), F.lit(kind))


def text(v: Column) -> Column:
    """A string that is not blank, trimmed; numbers and the rest give null."""
    return blank_to_null(F.trim(F.when(_is(v, "STRING"), F.try_variant_get(v, "$", "string"))))


def texts(v: Column) -> Column:
    """Strings of an array, or the parts of a string between ; , and |."""
    items = F.filter(F.transform(F.try_variant_get(v, "$", "array<variant>"), text), lambda x: x.isNotNull())
    return _or_empty(F.when(_is(v, "ARRAY"), items).otherwise(split_values(text(v))))


def _objects(v: Column) -> Column:
    return F.coalesce(F.filter(F.when(_is(v, "ARRAY"), F.try_variant_get(v, "$", "array<variant>")), lambda x: _is(x, "OBJECT")), F.array().cast("array<variant>"))


def truthy(v: Column) -> Column:
    """False for what is missing, false, zero or an empty string."""
    no = (_is(v, "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == F.lit(False))) | (_is(v, "STRING") & (F.try_variant_get(v, "$", "string") == "")) | F.coalesce(F.try_variant_get(v, "$", "double") == 0, F.lit(False))
    return v.isNotNull() & ~F.coalesce(no, F.lit(False))


def json_candidates(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds the record columns to rows with a VARIANT object."""
    v = F.col(record)

    def nested(*keys: str) -> Column:
        each = [F.try_variant_get(v, f"$.{k}", "variant") for k in keys]
        return F.coalesce(*[F.when(_is(x, "OBJECT"), x) for x in each])

    d = records.withColumns({"_place": nested("location", "address"), "_links": nested("links", "profiles", "urls"), "_first": text(present(v, "firstName", "first_name")), "_last": text(present(v, "lastName", "last_name"))})
    place, links = F.col("_place"), F.col("_links")
    given = F.coalesce(text(present(v, "location")), text(present(v, "address")))
    location = F.when(
        place.isNotNull() | given.isNotNull(),
        F.struct(
            given.alias("raw"), text(present(place, "city")).alias("city"), text(present(place, "region", "state")).alias("region"), text(present(place, "country")).alias("country"),
            F.coalesce(text(present(place, "formatted")), text(present(v, "location"))).alias("formatted"),
        ).cast(LOCATION),
    )
    link = lambda name, *more: text(F.coalesce(present(links, name), present(v, name, *more)))
    job = lambda x: F.struct(
        F.coalesce(text(present(x, "company", "employer", "organization")), F.lit("Unknown Employer")).alias("employer"), text(present(x, "title", "role")).alias("title"),
        text(present(x, "summary", "description")).alias("description"), text(present(x, "start", "startDate")).alias("start"), text(present(x, "end", "endDate")).alias("end"), truthy(present(x, "isCurrent", "current")).alias("is_current"),
        texts(present(x, "skills")).alias("skills"),
    )
    school = lambda x: F.struct(
        F.coalesce(text(present(x, "institution", "school", "university")), F.lit("Unknown Institution")).alias("institution"), text(present(x, "degree")).alias("degree"),
        text(present(x, "field", "major", "fieldOfStudy")).alias("field"), text(present(x, "endYear", "graduationYear", "endDate")).alias("end"),
    )
    columns = {
        "first_name": F.col("_first"), "last_name": F.col("_last"), "full_name": F.coalesce(text(present(v, "fullName", "full_name")), blank_to_null(F.concat_ws(" ", "_first", "_last"))),
        "headline": text(present(v, "headline", "title")), "summary": text(present(v, "summary", "profileSummary")), "location": location,
        "contacts": _contacts(texts(present(v, "email", "emails")), texts(present(v, "phone", "phones"))), "links": _links(link("linkedin"), link("github"), link("portfolio", "website")),
        "experiences": F.transform(_objects(present(v, "experience", "experiences", "jobs")), job).cast(JOBS), "education": F.transform(_objects(present(v, "education", "schools")), school).cast(SCHOOLS),
        "skills": texts(present(v, "skills")),
    }
    return d.withColumns(columns).drop("_place", "_links", "_first", "_last")
