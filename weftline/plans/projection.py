"""The projection language: a configuration compiled once to a select list.

``fields`` are names, dotted paths, ``a[0]`` indexes, ``a[].b`` wildcards or dicts with
``path``, ``from`` and ``normalize``. ``exclude`` drops by source or output path, ``rename``
maps sources to output paths, dotted output paths nest, ``missing`` is ``omit``, ``null`` or ``error``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StringType, StructType

from ..config import DEGREE_RANKS, SKILLS
from ..functions import normalize

# The fields of a projection that names none; such a projection shows missing values as null.
DEFAULT_FIELDS = (
    {"path": "candidate_id"}, {"path": "full_name"}, {"path": "emails", "type": "string[]"}, {"path": "phones", "type": "string[]", "normalize": "E164"},
    {"path": "location", "type": "object"}, {"path": "links", "type": "object"}, {"path": "headline"}, {"path": "years_experience"},
    {"path": "skills", "from": "ats_skills", "type": "object[]", "normalize": "canonical"}, {"path": "experience", "from": "ats_experience", "type": "object[]"},
    {"path": "education", "from": "ats_education", "type": "object[]"}, {"path": "provenance", "from": "ats_provenance", "type": "object[]"}, {"path": "overall_confidence"},
)
FORBIDDEN = {"__proto__", "prototype", "constructor", ""}


class ProjectionError(ValueError):
    """A configuration that cannot be compiled."""


@dataclass(frozen=True)
class Config:
    fields: tuple = ()
    exclude: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=dict)
    computed: tuple[str, ...] = ()
    missing: str = "omit"
    formats: dict[str, dict] = field(default_factory=dict)
    #: The year at which open jobs are taken to end; None: the current one.
    as_of_year: int | None = None
    #: Add the scores and histories of each projected path, as maps from the output path to its entries, and the source records.
    include_confidence: bool = False
    include_provenance: bool = False
    include_source_records: bool = False


# Outer names of inner fields.
OUTPUT_FIELDS = {"id": "candidate_id", "fullName": "full_name", "contactInfo": "emails/phones", "socialLinks": "links", "experiences": "experience", "skills": "skills", "confidence": "overall_confidence"}


def _first_of(a: Column, holds: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(a, holds), F.lit(0))


def _source_name(entry: Column) -> Column:
    """The name an entry carries, else that of its source record."""
    return F.coalesce(entry["source_name"], _first_of(F.col("source_records"), lambda r: r["id"] == entry["source_record_id"])["name"])


def _named(names: Column) -> Column:
    return F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "")))


def _links() -> Column:
    url = lambda p: _first_of(F.col("links"), lambda x: x["platform"] == p)["url"].alias(p)
    known = ("linkedin", "github", "portfolio")
    other = F.transform(F.filter("links", lambda x: ~x["platform"].isin(*known)), lambda x: x["url"])
    return F.struct(*[url(p) for p in known], other.alias("other"))


def _years(as_of_year: int | None) -> Column:
    """Years between start and end over all jobs with a start year, overlaps counted twice; null without any."""
    now = F.year(F.current_date()) if as_of_year is None else F.lit(as_of_year)
    year = lambda c: F.try_to_number(F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit("")), F.lit("9999")).cast("int")
    dated = F.filter("experiences", lambda x: year(x["start"]) > 0)
    until = lambda x: F.when(x["is_current"] | x["end"].isNull() | (x["end"] == ""), now).otherwise(F.coalesce(year(x["end"]), year(x["start"])))
    total = F.aggregate(dated, F.lit(0), lambda a, x: a + F.greatest(F.lit(0), until(x) - year(x["start"])))
    return F.when(F.size(dated) > 0, total.cast("double"))


def _ats_skill(s: Column) -> Column:
    own = _named(F.transform(s["provenance"], _source_name))
    of_field = _named(F.transform(F.filter(F.transform("provenance", lambda p, i: F.struct(p["field"].alias("field"), F.get("provenance_names", i).alias("name"))), lambda p: p["field"] == "skills"), lambda p: p["name"]))
    every = F.transform("source_records", lambda r: r["name"])
    return F.struct(s["name"].alias("name"), F.get(s["confidence"], F.lit(0)).alias("confidence"), F.when(F.size(own) > 0, own).when(F.size(of_field) > 0, of_field).otherwise(every).alias("sources"))


def _ats_job(x: Column) -> Column:
    return F.struct(x["employer"].alias("company"), x["title"].alias("title"), x["start"].alias("start"), F.when(~F.coalesce(x["is_current"], F.lit(False)), x["end"]).alias("end"), x["description"].alias("summary"))


def _ats_school(x: Column) -> Column:
    return F.struct(x["institution"].alias("institution"), x["degree"].alias("degree"), x["field"].alias("field"), F.substring(x["end"], 1, 4).alias("end_year"))


def _ats_entry(p: Column, name: Column) -> Column:
    outer = F.create_map(*[F.lit(x) for pair in OUTPUT_FIELDS.items() for x in pair])
    method = F.coalesce(p["normalizer"], p["strategy"], p["extractor"], F.lit("deterministic"))
    return F.struct(F.coalesce(F.try_element_at(outer, p["field"]), p["field"]).alias("field"), name.alias("source"), method.alias("method"))


def _ats_provenance(p: Column, i: Column) -> Column:
    return _ats_entry(p, F.get("provenance_names", i))


def _overall() -> Column:
    """The record's own score, else the mean of its fields' scores at four digits, else 0."""
    own = _first_of(F.col("confidence"), lambda s: s["field"] == "overall")["value"]
    total = F.aggregate("confidence", F.lit(0.0), lambda a, s: a + s["value"])
    return F.coalesce(own, F.when(F.size("confidence") > 0, F.floor(total / F.size("confidence") * 10000 + 0.5) / 10000), F.lit(0.0))


#: Columns whose scores and histories go by another name; derived columns share those of what they are derived from.
KNOWN_AS = {
    "first_name": "firstName", "middle_name": "middleName", "last_name": "lastName", "full_name": "fullName", "contacts": "contactInfo", "emails": "contactInfo", "phones": "contactInfo", "links": "socialLinks",
    "additional_data": "additionalData", "skill_details": "skills", "ats_skills": "skills", "ats_experience": "experiences", "ats_education": "education", "overall_confidence": "overall",
}


def _under(entries: str, source: str) -> Column:
    """The entries about a source path or a part of it."""
    head, *rest = re.split(r"(?=[.\[])", source, maxsplit=1)
    names = dict.fromkeys([source, "".join([KNOWN_AS.get(head, head), *rest])])
    return F.filter(entries, lambda s: reduce(lambda a, b: a | b, [(s["field"] == n) | F.startswith(s["field"], F.lit(f"{n}.")) for n in names]))


def _completion() -> Column:
    """The filled share of eight fields, at two digits."""
    text = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("full_name", "headline", "summary")]
    lists = [F.coalesce(F.size(c) > 0, F.lit(False)) for c in ("contacts", "experiences", "education", "skills")]
    filled = F.lit(0)
    for x in (*text, F.col("location").isNotNull(), *lists):
        filled = filled + x.cast("int")
    return F.floor(filled / 8 * 100 + 0.5) / 100


def virtual(name: str, as_of_year: int | None = None) -> Column | None:
    """Fields that are not stored but derived from contacts, links, experiences, education, detailed skills and provenance."""
    contacts = lambda kind: F.transform(F.filter("contacts", lambda c: c["kind"] == kind), lambda c: c["value"])
    made = {
        "emails": lambda: contacts("email"),
        "phones": lambda: contacts("phone"),
        "links": _links,
        "years_experience": lambda: _years(as_of_year),
        "ats_skills": lambda: F.transform("skill_details", _ats_skill),
        "ats_experience": lambda: F.transform("experiences", _ats_job),
        "ats_education": lambda: F.transform("education", _ats_school),
        "ats_provenance": lambda: F.transform("provenance", _ats_provenance),
        "overall_confidence": _overall,
    }
    return made[name]() if name in made else None


def resolve(path: str, as_of_year: int | None = None) -> Column:
    """A column for a source path; an index out of range is null."""
    m = re.fullmatch(r"(\w+)(?:\[(\d*)\])?(?:\.(.+))?", path)
    if not m:
        raise ProjectionError(f"unreadable path {path!r}")
    head, index, rest = m.groups()
    c = None if head == "links" and index is not None else virtual(head, as_of_year)  # links[...] are the stored ones
    c = F.col(head) if c is None else c
    if index == "":
        inner = [x for x in (rest or "").split(".") if x]

        def pick(x: Column) -> Column:
            for name in inner:
                x = x[name]
            return x

        return F.filter(F.transform(c, pick), lambda x: x.isNotNull())
    if index is not None:
        c = F.get(c, F.lit(int(index)))
    for name in (rest or "").split("."):
        c = c[name] if name else c
    return c


def primary(kind: str) -> Column:
    own = F.filter("contacts", lambda c: c["kind"] == kind)
    return F.coalesce(F.get(F.filter(own, lambda c: c["is_primary"]), F.lit(0)), F.get(own, F.lit(0)))["value"]


def best_degree(degrees: Column) -> Column:
    """The first degree of the best rank; unranked ones come last."""

    def rank(d: Column) -> Column:
        out = F.lit(len(DEGREE_RANKS))
        for i, name in reversed(list(enumerate(DEGREE_RANKS))):
            out = F.when(F.contains(F.lower(d), F.lit(name)), i).otherwise(out)
        return out

    return F.get(F.array_sort(F.transform(degrees, lambda d, i: F.struct(rank(d).alias("r"), i.alias("i"), d.alias("d")))), F.lit(0))["d"]


COMPUTED: dict[str, Callable[[], Column]] = {
    "primary_email": lambda: primary("email"),
    "primary_phone": lambda: primary("phone"),
    "skills_count": lambda: F.size("skills").cast("long"),
    "experience_count": lambda: F.size("experiences").cast("long"),
    "profile_completion": _completion,
    "highest_degree": lambda: best_degree(F.filter(F.transform("education", lambda e: e["degree"]), lambda d: d.isNotNull())),
}


def _dated(c: Column, form: str) -> Column:
    """``yyyy``, ``mm/yyyy`` or an ISO instant of a date string in UTC; what is no date stays as it is."""
    shapes = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]X", "yyyy-MM-dd", "yyyy-MM", "yyyy", "MMMM yyyy", "MMM yyyy")
    at = F.coalesce(*[F.try_to_timestamp(c, F.lit(x)) for x in shapes])
    at = F.to_utc_timestamp(at, F.current_timezone())
    wanted = {"yyyy": "yyyy", "mm/yyyy": "MM/yyyy"}.get(form, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.coalesce(F.date_format(at, wanted), c)


def canonical_name(c: Column) -> Column:
    """A skill's name by its alias, else with capitals; spelled-out aliases of the normalization stage are not among these."""
    spelled = ("java script", "ecmascript")
    names = F.create_map(*[F.lit(x) for p in SKILLS.items() if p[0] not in spelled for x in p])
    return F.coalesce(F.try_element_at(names, F.lower(normalize.collapsed(c))), normalize.title_case(c))


# Members of an object that stand for it in joined text, first come first.
SHOWN_AS = ("name", "value", "label", "title", "employer")


def shown(x: Column, kind: DataType) -> Column:
    """A list's entry as text: text itself, numbers without a vanishing fraction, objects by their first filled member of ``SHOWN_AS``, else as JSON; null is ``null``."""
    text = lambda k: isinstance(k, StringType)
    if isinstance(kind, StructType):
        named = [F.nullif(x[f], F.lit("")) for f in SHOWN_AS if f in kind.names and text(kind[f].dataType)]
        return F.coalesce(*named, F.to_json(x), F.lit("null"))
    if isinstance(kind, (ArrayType, MapType)):
        return F.coalesce(F.to_json(x), F.lit("null"))
    if isinstance(kind, (DoubleType, FloatType)):
        return F.coalesce(F.when((x == F.floor(x)) & (F.abs(x) < 1e15), F.floor(x).cast("string")), x.cast("string"), F.lit("null"))
    return F.coalesce(x.cast("string"), F.lit("null"))


def formatted(c: Column, how: dict, kind: DataType) -> Column:
    """The first format that applies to a value of that type: canonical names, E.164, a place, a phone, a date, a joined list. Null stays null.

    Canonical names and E.164 apply to text and to lists, in which what is no text stays; places to objects; phones and dates to text; joining to lists.
    """
    is_text, is_list = isinstance(kind, StringType), isinstance(kind, ArrayType)
    texts = is_list and isinstance(kind.elementType, StringType)
    digits = lambda x: F.regexp_replace(x, r"[^0-9+]", "")
    for wanted, change in (("canonical", canonical_name), ("e164", digits)):
        if str(how.get("normalize", "")).replace("E164", "e164") == wanted and (is_text or is_list):
            return F.transform(c, change) if texts else c if is_list else change(c)
    if how.get("location") and isinstance(kind, StructType):
        parts = {p: c[p] if p in kind.names else F.lit(None).cast("string") for p in ("city", "region", "country")}
        place = F.concat_ws(", ", *[F.nullif(x, F.lit("")) for x in parts.values()])
        return parts["country"] if how["location"] == "iso-country" else F.when(c.isNotNull(), place)
    if how.get("phone") and is_text:
        return digits(c) if how["phone"] == "e164" else c
    if how.get("date") and is_text:
        return _dated(c, how["date"])
    if is_list and ("join" in how or how.get("array") == "comma-separated"):
        return F.array_join(F.transform(c, lambda x: shown(x, kind.elementType)), how.get("join", how.get("joinWith", ", ")))
    return c


def compile_plan(config: Config, df: DataFrame | None = None) -> list[tuple[str, Column]]:
    """(output path, column) in order; duplicates and excluded paths dropped. Formats go by the types that the columns have in ``df``; without it none is applied."""
    if config.missing not in ("omit", "null", "error"):
        raise ProjectionError(f"unknown missing-value policy {config.missing!r}")
    by_default = not config.fields and not config.computed
    wanted = [*(DEFAULT_FIELDS if by_default else config.fields), *config.computed]
    out, seen = [], set()
    for w in wanted:
        spec = {"from": w, "path": config.rename.get(w, w)} if isinstance(w, str) else {"from": w.get("from", w["path"]), **w}
        source, path = spec["from"], spec["path"]
        if FORBIDDEN & set(path.split(".")):
            raise ProjectionError(f"output path {path!r} is not allowed")
        if source in config.exclude or path in config.exclude or (source, path) in seen:
            continue
        seen.add((source, path))
        if isinstance(w, str) and w in config.computed and w not in COMPUTED:
            raise ProjectionError(f"unknown computed field {w!r}")
        c = COMPUTED[source]() if source in COMPUTED else resolve(source, config.as_of_year)
        how = {**config.formats.get(source, {}), **config.formats.get(path, {})} | ({"normalize": spec["normalize"]} if "normalize" in spec else {})
        if how and df is not None:
            c = formatted(c, how, df.select(c.alias("x")).schema["x"].dataType)
        if config.missing == "error" and not by_default:
            c = F.when(c.isNull(), F.raise_error(F.lit(f"missing field {path}"))).otherwise(c)
        out.append((path, c))
    for wanted_too, name in ((config.include_confidence, "confidence"), (config.include_provenance, "provenance")):
        if wanted_too:
            paths = {path: source for source, path in sorted(seen)}
            about = F.map_from_arrays(F.array(*[F.lit(p) for p in paths]), F.array(*[_under(name, source) for source in paths.values()]))
            out = [(p, c) for p, c in out if p != name] + [(name, about)]
    if config.include_source_records:
        out.append(("source_records", F.col("source_records")))
    return out


def project(df: DataFrame, config: Config) -> DataFrame:
    """Select the plan's columns, dotted output paths as nested structs. A record's id and name also go by ``candidate_id`` and ``full_name``.

    ``provenance_names``: the names of the sources of ``provenance``, entry by entry; where it is missing they are looked up in each record's own sources.
    """
    for name, other in (("candidate_id", "id"), ("full_name", "fullName")):
        if name not in df.columns and other in df.columns:
            df = df.withColumn(name, F.col(other))
    if "provenance_names" not in df.columns and {"provenance", "source_records"} <= set(df.columns):
        df = df.withColumn("provenance_names", F.transform("provenance", _source_name))
    tree: dict = {}
    for path, c in compile_plan(config, df):
        *above, last = path.split(".")
        at = tree
        for name in above:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[last] = c

    def build(node: dict) -> list[Column]:
        return [(F.struct(*build(v)) if isinstance(v, dict) else v).alias(re.sub(r"\W", "_", k)) for k, v in node.items()]

    return df.select(*build(tree))


def listed(entries: DataFrame) -> DataFrame:
    """(id, place, field, source, method): the entries that ``ats_provenance`` lists in a record's row, as rows of their own, so that no record's list has to fit into one.
    A record's rows ordered by ``place`` are its list; entries of one place are equal. ``entries``: (id, place, x, name) of :func:`weftline.engine.entries`."""
    return entries.select("id", F.col("place").dropFields("id").alias("place"), _ats_entry(F.col("x"), F.col("name")).alias("p")).select("id", "place", "p.*")


def as_json(df: DataFrame, config: Config, name: str = "record") -> DataFrame:
    """One column of JSON records. Under ``omit`` missing fields are left out of each record, under ``null`` they are written as
    null; a projection that names no fields shows them as null."""
    shown = config.missing != "omit" or not (config.fields or config.computed)
    out = project(df, config)
    return out.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(not shown).lower()}).alias(name))
