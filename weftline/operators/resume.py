"""Résumé text to fields: sections, headline, place, jobs and schools, in native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..config import MONTHS
from ..functions import patterns
from ..functions.normalize import blank_to_null, collapsed, unique_ci
from ..functions.patterns import lines

# Headings of a section.
SECTIONS = {
    "summary": ("summary", "profile", "professional summary", "about"),
    "skills": ("skills", "technical skills", "core competencies", "technologies"),
    "experience": ("experience", "work experience", "professional experience", "employment"),
    "education": ("education", "academic background", "qualifications"),
    "projects": ("projects",),
    "clubs": ("clubs and communities", "clubs", "communities"),
    "extra": ("extra-curricular", "extracurricular", "achievements"),
}
_ANY_HEADING = "|".join(re.escape(h) for hs in SECTIONS.values() for h in hs)
# Forms of bullets, places, degrees, and first words that no employer has.
BULLET = r"^(?:[•*-]\s+|â€¢\s*)"
BULLET_MARK = r"^(?:[•*-]\s*|â€¢\s*)"
PLACE = r"^[A-Za-z .'-]+,\s*[A-Za-z .'-]+(?:,\s*[A-Za-z .'-]+)?\z"
TITLE_PLACE = r"(?i)^(.+?)\s+([A-Za-z .'-]+,\s*[A-Za-z .'-]+(?:,\s*[A-Za-z .'-]+)?|Remote|Hybrid)\z"
DEGREE = r"(?i)\b(Ph\.?\s*D\.?|M\.?\s*S\.?|M\.?\s*Tech|M\.?\s*B\.?\s*A\.?|B\.?\s*S\.?|B\.?\s*Tech|B\.?\s*E\.?|Bachelor[^,|-]*|Master[^,|-]*|Diploma[^,|-]*)"
NO_EMPLOYER = r"(?i)^(?:shipped|and|low-|needs|users|export|design|worked|gained|developed|built|optimized|researched|collaborated)\b"
_DATE = rf"(?:(?:{'|'.join(m[:3] for m in MONTHS)})[a-z]*\s+[0-9]{{4}}|[0-9]{{4}})"
# a range anywhere in a line, whatever follows it; else one date at its end: what stands before is the employer
RANGE = rf"(?i)^(.*?)({_DATE})\s*(?:-|to|–|—|â€“)\s*(present|current|now|{_DATE})"
SINGLE = rf"(?i)^(.*?)({_DATE})\z"
NOW = r"(?i)^(?:present|current|now)\z"


def _group(c: Column, pattern: str, i: int) -> Column:
    """A group of the first match, trimmed; null if there is none or it is blank."""
    return blank_to_null(F.trim(F.regexp_extract(c, pattern, i)))


def section(text: Column, name: str) -> Column:
    """What follows the first heading of the section that has content, up to the next heading."""
    one = lambda h: _group(text, rf"(?is)(?:^|\n)\s*{re.escape(h)}\s*[:\n\r]+(.*?)(?=\n\s*(?:{_ANY_HEADING})\s*:?\r?\n|\z)", 1)
    return F.coalesce(*[one(h) for h in SECTIONS[name]])


def is_heading(line: Column) -> Column:
    return F.lower(line).isin(*[h for hs in SECTIONS.values() for h in hs])


def skills(part: Column) -> Column:
    """Skills of a section: split, bullets and group labels dropped, unique without case."""
    items = F.flatten(F.transform(F.split(F.coalesce(part, F.lit("")), r"[,\n|;]+"), lambda x: F.split(x, r"\s{2,}")))
    bare = F.transform(items, lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"^[-*]\s*", ""), r"(?i)^(technical stack|tools|soft skills|languages)\s*:\s*", "")))
    return unique_ci(F.filter(bare, lambda x: (F.length(x) > 1) & ~F.rlike(x, F.lit(r"(?i)^(skills?|tools?|languages?)\z"))))


def headline(ls: Column, name: Column) -> Column:
    """The first line under the name and above any heading that is no contact line."""
    at = F.array_position(F.transform(ls, is_heading), True)
    head = F.when(at > 0, F.slice(ls, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int"))).otherwise(ls)
    plain = lambda x, i: (i > 0) & ~x.eqNullSafe(name) & (F.length(x) <= 120) & ~F.rlike(x, F.lit(rf"[@⋄◆]|(?i:linkedin\.com|github\.com|^https?://)|{patterns.PHONE}"))
    return F.get(F.filter(head, plain), F.lit(0))


def place(raw: Column) -> Column:
    """struct<raw, city, region, country> of comma-separated parts; null for null."""
    parts = F.filter(F.transform(F.split(raw, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(raw.isNotNull(), F.struct(raw.alias("raw"), F.get(parts, F.lit(0)).alias("city"), F.get(parts, F.lit(1)).alias("region"), F.get(parts, F.lit(2)).alias("country")))


def location(ls: Column) -> Column:
    """``City, Region`` among the first six lines, or the first labeled line."""
    segments = F.transform(F.flatten(F.transform(F.slice(ls, 1, 6), lambda x: F.split(x, r"\s*[⋄◆]\s*"))), lambda x: F.trim(x))
    found = F.get(F.filter(segments, lambda x: F.rlike(x, F.lit(PLACE)) & ~F.rlike(x, F.lit(r"(?i)linkedin\.com|github\.com"))), F.lit(0))
    labeled = F.get(F.filter(ls, lambda x: F.rlike(x, F.lit(r"(?i)(?:location|address)\s*:"))), F.lit(0))
    return place(F.regexp_replace(F.coalesce(found, labeled), r"(?i)^(?:location|address)\s*:\s*", ""))


def schools(part: Column) -> Column:
    """array<struct<institution, degree, field, end>>, one per line with a school or a degree; the line's last year becomes its January.

    A number in a school's name may look like a year, and a longer one may hold it: years are whole words, and the first that equals the year goes from the name.
    """

    def one(line: Column) -> Column:
        year = F.regexp_extract(line, r"(?s)^.*\b((?:19|20)\d{2})\b", 1)
        parts = F.transform(F.split(line, ","), lambda x: F.trim(x))
        first, second = F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
        degree = F.regexp_extract(first, DEGREE, 0)
        cut = lambda c, what: F.when(F.instr(c, what) > 0, F.concat(F.substring(c, F.lit(1), F.instr(c, what) - 1), F.substring(c, F.instr(c, what) + F.length(what), F.length(c)))).otherwise(c)
        unexpected = F.regexp_replace(second, r"(?i)\bExpected\b", "")
        undated = F.when(year != "", F.regexp_replace(unexpected, F.concat(F.lit(r"(?s)^(.*?)\b"), year, F.lit(r"\b")), F.lit("$1"))).otherwise(unexpected)
        at_school = F.trim(F.regexp_replace(undated, r"[|-]+", " "))
        return F.struct(
            F.coalesce(blank_to_null(at_school), blank_to_null(degree)).alias("institution"), blank_to_null(degree).alias("degree"),
            F.trim(F.regexp_replace(cut(first, degree), r"(?i)^\s+in\s+", "")).alias("field"), F.when(year != "", F.concat(year, F.lit("-01"))).alias("end"),
        )

    bare = F.filter(F.transform(lines(F.coalesce(part, F.lit(""))), lambda x: F.trim(F.regexp_replace(x, r"^[-*]\s*", ""))), lambda x: (x != "") & ~F.rlike(x, F.lit(r"(?i)^gpa\s*:")))
    return F.filter(F.transform(bare, one), lambda s: s["institution"].isNotNull())


def title_and_place(line: Column) -> Column:
    """struct<title, place>: ``Title City, Region``, or a title before a place, Remote or Hybrid; the last two are no place."""
    parts = F.filter(F.transform(F.split(line, ","), lambda x: F.trim(x)), lambda x: x != "")
    words = F.filter(F.split(F.get(parts, F.lit(0)), r"\s+"), lambda x: x != "")
    city = F.get(words, F.size(words) - 1)
    with_comma = F.struct(F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ").alias("title"), place(F.concat_ws(", ", city, F.get(parts, F.lit(1)), F.get(parts, F.lit(2)))).alias("place"))
    title, where = _group(line, TITLE_PLACE, 1), _group(line, TITLE_PLACE, 2)
    other = F.struct(F.coalesce(title, line).alias("title"), place(F.when(~F.lower(where).isin("remote", "hybrid"), where)).alias("place"))
    return F.when(F.contains(line, F.lit(",")) & (F.size(words) >= 2) & (F.size(parts) >= 2), with_comma).otherwise(other)


def jobs(docs: DataFrame, ids: list[str], part: str) -> DataFrame:
    """(ids, job, employer, title, place, start, end, is_current, description) of an experience section.

    A line with a date range or one trailing date opens a job if what precedes the date may be an employer; later lines belong to it.
    """
    x = docs.select(*ids, F.posexplode(lines(F.col(part))).alias("pos", "line")).withColumn("bullet", F.rlike("line", F.lit(BULLET)))
    ranged = F.regexp_extract("line", RANGE, 2) != ""
    employer = F.when(ranged, _group(F.col("line"), RANGE, 1)).otherwise(_group(F.col("line"), SINGLE, 1))
    start = F.when(ranged, _group(F.col("line"), RANGE, 2)).otherwise(_group(F.col("line"), SINGLE, 2))
    x = x.withColumns({"employer": employer, "start": start, "end": F.when(ranged, _group(F.col("line"), RANGE, 3)).otherwise(start)})
    plausible = F.length("employer").between(2, 120) & ~F.rlike("employer", F.lit(BULLET)) & ~F.rlike("employer", F.lit(r"[.!?]\z")) & ~F.rlike("employer", F.lit(NO_EMPLOYER))
    x = x.withColumn("header", F.coalesce(~F.col("bullet") & F.col("start").isNotNull() & plausible, F.lit(False)))
    x = x.withColumn("job", F.sum(F.col("header").cast("int")).over(Window.partitionBy(*ids).orderBy("pos"))).filter("job > 0")
    detail = F.when(~F.col("header"), F.struct("pos", "bullet", "line"))
    of_header = lambda c: F.max(F.when(F.col("header"), F.col(c))).alias(c)
    g = x.groupBy(*ids, "job").agg(of_header("employer"), of_header("start"), of_header("end"), F.array_sort(F.collect_list(detail)).alias("d"))
    title = F.get(F.filter("d", lambda y: ~y["bullet"]), F.lit(0))["line"]
    first_bullet = F.get(F.filter("d", lambda y: y["bullet"]), F.lit(0))["pos"]
    begins = F.coalesce(first_bullet, F.get("d", F.lit(0))["pos"] + 1)
    told = F.transform(F.filter("d", lambda y: y["pos"] >= begins), lambda y: F.trim(F.regexp_replace(y["line"], BULLET_MARK, "")))
    current = F.rlike("end", F.lit(NOW))
    g = g.withColumn("_title", title_and_place(title)).withColumn("_told", told)
    return g.select(
        *ids, "job", "employer", F.col("_title.title").alias("title"), F.col("_title.place").alias("place"), "start",
        F.when(~current, F.col("end")).alias("end"), current.alias("is_current"), blank_to_null(collapsed(F.array_join("_told", " "))).alias("description"),
    )


def undated_jobs(part: Column) -> Column:
    """array<struct<employer, title, description>> of entries without usable headers: they begin at lines that hold ``at``, a bar or a hyphen."""
    entries = F.filter(F.transform(F.split(F.coalesce(part, F.lit("")), r"\n(?=\S.+(?:\b(?i:at)\b|\||-).+)"), lambda x: F.trim(x)), lambda x: x != "")

    def one(entry: Column) -> Column:
        ls = F.transform(F.split(entry, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"^[-*]\s*", "")))
        head = F.trim(F.regexp_replace(F.get(ls, F.lit(0)), rf"(?i)({_DATE})\s*(?:-|to|–)\s*({_DATE}|present|current|now)", ""))
        parts = F.filter(F.transform(F.split(head, r"(?i)\s+(?:at|@)\s+|\s+[|]\s+|\s+-\s+"), lambda x: F.trim(x)), lambda x: x != "")
        several = F.size(parts) > 1
        employer = F.when(several, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " - ")).otherwise(F.get(parts, F.lit(0)))
        rest = F.filter(F.slice(ls, F.lit(2), F.size(ls)), lambda x: x != "")
        return F.struct(employer.alias("employer"), F.when(several, F.get(parts, F.lit(0))).alias("title"), blank_to_null(F.array_join(rest, " ")).alias("description"))

    return F.filter(F.transform(entries, one), lambda s: F.length(s["employer"]).between(1, 120))


def fields(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the fields of each text that need no grouping: names, headline, place, contacts, links, sections, skills and schools."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({"lines": lines(t), "full_name": patterns.first_name_line(t), "experience_text": section(t, "experience"), "summary": section(t, "summary")})
    urls = F.transform(patterns.extract_all(t, patterns.URL), lambda u: F.when(F.rlike(u, F.lit(r"(?i)^https?://")), u).otherwise(F.concat(F.lit("https://"), u)))
    return d.withColumns(
        {
            "headline": headline(F.col("lines"), F.col("full_name")), "location": location(F.col("lines")), "emails": patterns.extract_all(t, patterns.EMAIL), "phones": patterns.extract_all(t, patterns.PHONE),
            "links": F.transform(urls, lambda u: F.struct(patterns.platform(u).alias("platform"), u.alias("url"))), "skills": skills(section(t, "skills")), "schools": schools(section(t, "education")),
        }
    ).drop("lines")


def experiences(docs: DataFrame, ids: list[str], part: str = "experience_text") -> DataFrame:
    """Dated jobs, and for texts without any the undated ones; ``ids`` name a text and are not null."""
    kept = docs.select(*ids, part).filter(F.col(part).isNotNull())
    dated = jobs(kept, ids, part)
    none = kept.join(dated.select(*ids).distinct(), ids, "left_anti").select(*ids, F.posexplode(undated_jobs(F.col(part))).alias("i", "j"))
    more = none.select(*ids, (F.col("i") + 1).cast("long").alias("job"), F.col("j.employer").alias("employer"), F.col("j.title").alias("title"), F.col("j.description").alias("description"), F.lit(False).alias("is_current"))
    return dated.unionByName(more, allowMissingColumns=True)
