"""Sources to records: who reads what, recruiter notes, evidence, and all four extractors in one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ExtractionError
from ..functions import normalize, patterns
from ..hooks import Hooks, completed
from ..operators import resume
from ..operators.tables import written
from . import files as readers
from .structured import CONTACTS, JOBS, LINKS, LOCATION, RECORD, SCHOOLS, csv_records, csv_rows, json_candidates

EMPTY = {"contacts": CONTACTS, "links": LINKS, "experiences": JOBS, "education": SCHOOLS, "skills": "array<string>"}


def extractor(parser: Column, source_type: Column, name: Column) -> Column:
    """The first extractor that takes a source: rows, applicant exports, résumés, notes; null if none does."""
    n = F.lower(name)
    text = parser.isin("TextParser", "PdfParser", "DocxParser")
    return (
        F.when(parser == "CsvParser", "CsvExtractor")
        .when((parser == "JsonParser") & (source_type == "ats"), "AtsJsonExtractor")
        .when(text & ((source_type == "resume") | F.contains(n, F.lit("resume"))), "ResumeExtractor")
        .when(text & ((source_type == "manual") | F.contains(n, F.lit("notes")) | F.contains(n, F.lit("recruiter"))), "RecruiterNotesExtractor")
    )


def _list(kind: str, *items: tuple[Column, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(there, x) for there, x in items])).cast(kind)


def note_records(notes: DataFrame, text: str = "text") -> DataFrame:
    """Adds the record columns to recruiter notes of labeled lines; a place is split at its commas, a company is a current job."""
    t = F.coalesce(F.col(text), F.lit(""))
    of = lambda *labels: patterns.labeled(t, *labels)
    d = notes.withColumns({"_email": of("email"), "_phone": of("phone"), "_place": of("location", "address"), "_company": of("company", "current company"), "_title": of("title", "current title"), "_school": of("school", "education")})
    email, phone, place, company, title, school = (F.col(f"_{x}") for x in ("email", "phone", "place", "company", "title", "school"))
    parts = F.filter(F.transform(F.split(place, ","), lambda x: F.trim(x)), lambda x: x != "")
    contact = lambda kind, v, first: F.struct(F.lit(kind).alias("kind"), v.alias("value"), first.alias("is_primary"))
    link = lambda p, *labels: (of(*labels).isNotNull(), F.struct(F.lit(p).alias("platform"), of(*labels).alias("url")))
    none = F.lit(None).cast("string")
    columns = {
        "first_name": none, "last_name": none, "full_name": of("name"), "headline": title, "summary": of("summary", "notes"),
        "location": F.when(place.isNotNull(), F.struct(place.alias("raw"), F.get(parts, F.lit(0)).alias("city"), F.get(parts, F.lit(1)).alias("region"), F.get(parts, F.lit(2)).alias("country"), place.alias("formatted"))).cast(LOCATION),
        "contacts": _list(CONTACTS, (email.isNotNull(), contact("email", email, F.lit(True))), (phone.isNotNull(), contact("phone", phone, email.isNull()))),
        "links": _list(LINKS, link("linkedin", "linkedin"), link("github", "github"), link("portfolio", "portfolio", "website")),
        "experiences": _list(JOBS, (company.isNotNull(), F.struct(company.alias("employer"), title.alias("title"), none.alias("description"), none.alias("start"), none.alias("end"), F.lit(True).alias("is_current"), F.array().cast("array<string>").alias("skills")))),
        "education": _list(SCHOOLS, (school.isNotNull(), F.struct(school.alias("institution"), none.alias("degree"), none.alias("field"), none.alias("end")))),
        "skills": F.coalesce(normalize.split_values(of("skills")), F.array().cast("array<string>")),
    }
    return d.withColumns(columns).drop("_email", "_phone", "_place", "_company", "_title", "_school")


def resume_records(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Adds the record columns to résumé texts; ``key`` names a text and is not null."""
    f = resume.fields(texts, text)
    told = resume.experiences(f, [key]).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("job", F.struct("employer", "title", "description", "start", "end", "is_current").alias("x")))).alias("_jobs"))
    f = f.join(told, key, "left")
    contact = lambda kind, first: lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), ((i == 0) & first).alias("is_primary"))
    contacts = F.concat(F.transform("emails", contact("email", F.lit(True))), F.transform("phones", contact("phone", F.size("emails") == 0)))
    place = F.col("location")
    whole = F.when(place.isNotNull(), F.struct(place["raw"].alias("raw"), place["city"].alias("city"), place["region"].alias("region"), place["country"].alias("country"), place["raw"].alias("formatted")))
    columns = {
        "first_name": F.lit(None).cast("string"), "last_name": F.lit(None).cast("string"), "location": whole.cast(LOCATION), "contacts": contacts.cast(CONTACTS), "links": F.col("links").cast(LINKS),
        "experiences": F.coalesce(F.transform("_jobs", lambda j: j["x"].withField("skills", F.array().cast("array<string>"))), F.array()).cast(JOBS), "education": F.col("schools").cast(SCHOOLS),
    }
    return f.withColumns(columns).drop("_jobs", "emails", "phones", "schools", "experience_text")


def extracted(files: DataFrame, strict: bool = False, hooks: Hooks | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of admitted files (:func:`weftline.sources.files.read`), written tables.

    Records: path, row_no, source_type, extractor and the record columns, from all four extractors; row_no counts the rows or objects of a file.
    Rejects: path and reason, one for each file that is not admitted, cannot be read, holds no record or has no extractor; strict runs end with the first.
    A file that cannot be read costs its own records only. Every file is decoded and parsed once. A hook may fill what text sources leave empty.
    """
    f = files.withColumn("extractor", extractor(F.col("parser"), F.col("source_type"), F.col("name")))
    keys = ["path", "row_no", "source_type", "extractor"]
    admitted = f.filter("reject_reason is null and extractor is not null")
    about = admitted.select("path", "source_type", "extractor")
    texts = written(readers.contents(admitted).join(about, "path"), "source-texts")
    rows = written(csv_rows(texts), "source-rows")
    from_rows = csv_records(rows.filter("error is null")).join(about, "path").select(*keys, *RECORD)
    objects = readers.json_records(texts.filter("extractor = 'AtsJsonExtractor'"))
    from_json = json_candidates(objects).join(about, "path").select(*keys, *RECORD)
    told = texts.filter("text != ''").withColumn("row_no", F.lit(0).cast("long"))
    from_resumes = resume_records(told.filter("extractor = 'ResumeExtractor'"), "path").select(*keys, *RECORD)
    from_notes = note_records(told.filter("extractor = 'RecruiterNotesExtractor'")).select(*keys, *RECORD)
    from_texts = from_resumes.unionByName(from_notes)
    if hooks and hooks.serve("extraction"):
        from_texts = completed(from_texts, told.filter("extractor in ('ResumeExtractor', 'RecruiterNotesExtractor')"), hooks).select(*keys, *RECORD)
    records = written(from_rows.unionByName(from_json).unionByName(from_texts), "extracted-records")
    refused = f.filter("reject_reason is not null").select("path", F.col("reject_reason").alias("reason"))
    nobody = f.filter("reject_reason is null and extractor is null").select("path", F.lit("no extractor").alias("reason"))
    unread = texts.filter("error is not null").select("path", F.col("error").alias("reason")).unionByName(rows.filter("error is not null").select("path", F.col("error").alias("reason")))
    seen = records.select("path").unionByName(unread.select("path")).distinct()
    blank = F.coalesce(F.trim("text") == "", F.lit(False))
    empty = texts.join(seen, "path", "left_anti").select("path", F.when(blank, "empty input").otherwise("malformed or empty").alias("reason"))
    rejects = written(refused.unionByName(nobody).unionByName(unread).unionByName(empty), "rejected-files")
    if strict and (first := rejects.orderBy("path").first()):
        raise ExtractionError(f"{first['path']}: {first['reason']}")
    return records, rejects
