"""Rules for records of any type, declared by field and compiled to one expression that names every breach by its path.

A rule is a function from a value (VARIANT; SQL null where the field is missing) and its path (a text column) to an array of problems. Types are
dictionaries of rules; they nest. A document is checked in one pass over its columns, without a schema of its own and without a join.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, functions as F

from .contract import KINDS, PLATFORMS, UUID

Rule = Callable[[Column, Column], Column]
PROBLEM = "array<struct<path:string,problem:string>>"
# What a source, a skill's level and an instant may look like.
SOURCE_TYPES = ("resume", "job-board", "ats", "social-profile", "manual", "other")
LEVELS = ("beginner", "intermediate", "advanced", "expert")
INSTANT = r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])\z"
ADDRESS = r"^(https?://[^\s/?#]+|(?!https?:)[A-Za-z][A-Za-z0-9+.-]*:\S)"


def _none() -> Column:
    return F.array().cast(PROBLEM)


def _one(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"))).cast(PROBLEM)


def _is(v: Column, *kinds: str) -> Column:
    found = F.lit(False)
    for k in kinds:
        found = found | F.startswith(F.schema_of_variant(v), F.lit(k))
    return F.coalesce(found, F.lit(False))


def _scalar(kinds: tuple[str, ...], as_: str, expected: str, holds: Callable[[Column], Column], otherwise: str) -> Rule:
    def rule(v: Column, path: Column) -> Column:
        right = F.coalesce(holds(F.try_variant_get(v, "$", as_)), F.lit(False))
        return F.when(v.isNull(), _one(path, "missing")).when(~_is(v, *kinds), _one(path, f"no {expected}")).when(~right, _one(path, otherwise)).otherwise(_none())

    return rule


def text(pattern: str | None = None, otherwise: str = "empty") -> Rule:
    return _scalar(("STRING",), "string", "text", lambda s: F.rlike(s, F.lit(pattern)) if pattern else s != "", otherwise)


def any_text() -> Rule:
    return _scalar(("STRING",), "string", "text", lambda s: s.isNotNull(), "empty")


def one_of(*values: str) -> Rule:
    return _scalar(("STRING",), "string", "text", lambda s: s.isin(*values), "not one of the known")


def number(low: float | None = None, high: float | None = None, whole: bool = False) -> Rule:
    def holds(n: Column) -> Column:
        out = n.isNotNull()
        for wanted in (None if low is None else n >= low, None if high is None else n <= high, n == F.floor(n) if whole else None):
            out = out if wanted is None else out & wanted
        return out

    return _scalar(("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "double", "number", holds, "out of range")


def truth() -> Rule:
    return _scalar(("BOOLEAN",), "boolean", "truth value", lambda b: b.isNotNull(), "no truth value")


def maybe(rule: Rule) -> Rule:
    """The field may be missing; null is not missing."""
    return lambda v, path: F.when(v.isNull(), _none()).otherwise(rule(v, path))


def each(rule: Rule) -> Rule:
    """A list, whose entries are checked under their places; it may be missing."""

    def checked(v: Column, path: Column) -> Column:
        entries = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, i: rule(x, F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        return F.when(v.isNull(), _none()).when(~_is(v, "ARRAY"), _one(path, "no list")).otherwise(F.coalesce(F.flatten(entries), _none()))

    return checked


def anything() -> Rule:
    """An object with any fields; it may be missing."""
    return lambda v, path: F.when(v.isNull() | _is(v, "OBJECT"), _none()).otherwise(_one(path, "no object"))


def record(**fields: Rule) -> Rule:
    """An object whose fields keep their rules; other fields may stand beside them."""

    def checked(v: Column, path: Column) -> Column:
        inner = [rule(F.try_variant_get(v, f"$.{name}", "variant"), F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))) for name, rule in fields.items()]
        return F.when(v.isNull(), _one(path, "missing")).when(~_is(v, "OBJECT"), _one(path, "no object")).otherwise(F.concat(*inner))

    return checked


@cache
def types() -> dict[str, Rule]:
    """The fourteen types of records. Their fields and what these may hold."""
    uuid, instant, share, name = text(UUID, "no id"), text(INSTANT, "no instant"), number(0, 1), maybe(text())
    history = dict(
        id=uuid, sourceRecordId=uuid, fieldPath=text(), sourcePriority=maybe(number(0, whole=True)), timestamp=maybe(instant), resolvedAt=maybe(instant), winningSourceRecordIds=each(uuid), candidateSourceRecordIds=each(uuid), discardedValues=each(text()),
        **{f: name for f in ("extractedValue", "extractor", "notes", "originalValue", "normalizedValue", "selectedValue", "sourceName", "normalizer", "mergeStrategy")},
    )
    score = dict(
        id=uuid, fieldPath=text(), value=share, reason=name, sourceRecordId=maybe(uuid), calculatedAt=maybe(instant), strategy=name, fieldWeight=maybe(number(0)),
        **{f: maybe(share) for f in ("sourceWeight", "agreementScore", "completenessScore", "validationScore")},
    )
    known = dict(provenance=each(record(**history)), confidence=each(record(**score)))
    place = dict(id=uuid, **{f: name for f in ("raw", "city", "region", "country", "postalCode", "formatted")}, **known)
    skill = dict(id=uuid, name=text(), category=name, level=maybe(one_of(*LEVELS)), yearsOfExperience=maybe(number(0)), **known)
    contact = dict(id=uuid, kind=one_of(*KINDS), value=text(), label=name, isPrimary=maybe(truth()), isVerified=maybe(truth()), **known)
    link = dict(id=uuid, platform=one_of(*PLATFORMS), url=text(ADDRESS, "no address"), username=name, **known)
    job = dict(id=uuid, employer=text(), title=name, description=name, startDate=name, endDate=name, isCurrent=maybe(truth()), location=maybe(record(**place)), skills=each(record(**skill)), **known)
    school = dict(id=uuid, institution=text(), degree=name, fieldOfStudy=name, grade=name, startDate=name, endDate=name, location=maybe(record(**place)), **known)
    source = dict(id=uuid, sourceId=text(), sourceType=one_of(*SOURCE_TYPES), sourceName=text(), fileName=text(), mimeType=text(), receivedAt=instant, parser=text(), extractor=text(), metadata=anything())
    operation = dict(field=text(), normalizer=text(), originalValue=any_text(), normalizedValue=any_text(), timestamp=instant)
    about = dict(
        candidateId=uuid, pipelineVersion=text(), engineVersion=text(), mergeStrategyVersion=text(), processingStartedAt=instant, processingCompletedAt=instant, processingDurationMs=number(0),
        mergedSources=each(text()), totalSources=number(0, whole=True), totalFields=number(0, whole=True),
    )
    partial = dict(
        **{f: name for f in ("firstName", "middleName", "lastName", "fullName", "headline", "summary")}, location=maybe(record(**place)), contactInfo=each(record(**contact)), socialLinks=each(record(**link)), experiences=each(record(**job)),
        education=each(record(**school)), skills=each(record(**skill)), sourceRecords=each(record(**source)), tags=each(text()), additionalData=anything(),
    )
    whole = dict(**partial, id=uuid, provenance=each(record(**history)), confidence=each(record(**score)), candidateMetadata=maybe(record(**about)), createdAt=instant, updatedAt=instant)
    declared = {
        "Provenance": history, "ConfidenceScore": score, "Location": place, "Skill": skill, "ContactInfo": contact, "SocialLink": link, "Experience": job, "Education": school, "SourceRecord": source,
        "NormalizationOperation": operation, "CandidateMetadata": about, "PartialCandidate": partial, "NormalizedPartialCandidate": dict(**partial, normalizationOperations=each(record(**operation))), "CanonicalCandidate": whole,
    }
    return {n: record(**fields) for n, fields in declared.items()}


def breaches(documents: DataFrame, key: str, rule: Rule | str, document: str = "document") -> DataFrame:
    """(key, path, problem) of every breach of a rule, or of a type by name, in JSON texts. A document that is no JSON, or null, is one breach at the empty path."""
    rule = types()[rule] if isinstance(rule, str) else rule
    v = F.try_parse_json(document)
    found = documents.withColumn("_v", v).select(key, F.when(F.col("_v").isNull(), _one(F.lit(""), "no document")).otherwise(rule(F.col("_v"), F.lit(""))).alias("_found"))
    return found.select(key, F.inline("_found"))
