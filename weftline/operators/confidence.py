"""Scores of canonical records: each field's from its source, agreement, completeness and validity, each entry's, and the record's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..config import FIELD_WEIGHTS
from . import generic, merge, score
from .records import candidate_metadata, primary_source

#: Columns of canonical records and the fields they are scored as.
FIELDS = {
    "first_name": "firstName", "middle_name": "middleName", "last_name": "lastName", "full_name": "fullName", "headline": "headline", "summary": "summary", "location": "location",
    "contacts": "contactInfo", "links": "socialLinks", "experiences": "experiences", "education": "education", "skills": "skills", "tags": "tags", "additional_data": "additionalData",
}
#: An address that a browser would take.
ADDRESS = r"^(https?://[^\s/?#]+|(?!https?:)[A-Za-z][A-Za-z0-9+.-]*:\S)"


def narrowed(c: Column, kind: DataType) -> Column:
    """A value with the fields of ``kind`` alone."""
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*[narrowed(c[f.name], f.dataType).alias(f.name) for f in kind.fields]))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(c, lambda x: narrowed(x, kind.elementType))
    return c


def validity(c: Column, kind: DataType, field: str) -> Column:
    """How far a field's value is well-formed: contacts and links by their entries' mean; text and lists if they hold anything; other values if they are there."""
    if field == "contactInfo":
        return score.contact_validity(c)
    if field == "socialLinks":
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + F.when(F.rlike(x["url"], F.lit(ADDRESS)), 1.0).otherwise(0.6))
        return F.when(F.size(c) > 0, total / F.size(c)).otherwise(0.0)
    if isinstance(kind, StringType):
        return F.when(F.trim(c) != "", 1.0).otherwise(0.0)
    if isinstance(kind, ArrayType):
        return F.when(F.size(c) > 0, 1.0).otherwise(0.0)
    return F.when(c.isNotNull(), 1.0).otherwise(0.0)


def _key(c: Column, kind: DataType) -> Column:
    """What two values are compared by: text trimmed and without case, the rest as JSON; null for null."""
    return F.lower(F.trim(c)) if isinstance(kind, StringType) else F.when(c.isNotNull(), generic.serialized(c, kind))


def source_records(rows: DataFrame, group: str = "group_ix") -> DataFrame:
    """(group, source_records): id, type and name of a group's sources, by their first record."""
    of = F.struct(F.col("source_id").alias("id"), F.col("source_type").alias("type"), F.col("source_name").alias("name"))
    once = rows.groupBy(group, "source_id").agg(F.min("candidate_ix").alias("ord"), F.min_by(of, "candidate_ix").alias("s"))
    return once.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "s"))), lambda x: x["s"]).alias("source_records"))


def agreement(merged: DataFrame, rows: DataFrame, columns: list[str], group: str = "group_ix") -> DataFrame:
    """(group, a share per column): how many of a group's records that have a value have the selected one; 1 for one value or none. Empty lists are values.

    Records meet their group's selected values in one join and are counted by partial sums: no group's records are gathered.
    """
    kinds = {c: rows.schema[c].dataType for c in columns}
    selected = merged.select(group, *[_key(narrowed(F.col(c), kinds[c]), kinds[c]).alias(f"_s{i}") for i, c in enumerate(columns)])
    said = rows.select(group, *[_key(F.col(c), kinds[c]).alias(f"_k{i}") for i, c in enumerate(columns)])
    counts = []
    for i in range(len(columns)):
        counts += [F.count(f"_k{i}").alias(f"_n{i}"), F.count_if(F.col(f"_k{i}") == F.col(f"_s{i}")).alias(f"_e{i}")]
    g = said.join(selected, group).groupBy(group).agg(*counts)
    return g.select(group, *[F.when(F.col(f"_n{i}") <= 1, 1.0).otherwise(F.col(f"_e{i}") / F.col(f"_n{i}")).alias(c) for i, c in enumerate(columns)])


def scored(merged: DataFrame, rows: DataFrame, group: str = "group_ix") -> DataFrame:
    """Canonical records with ``source_records``, ``confidence`` (a score per field, then the record's), ``entry_scores`` (one per contact, link, skill, job and
    school) and ``metadata``.

    ``rows``: the records they were merged from, with group, candidate_ix, source_id, source_type and source_name. A field that records do not have scores 0. Where a field's
    decisions name no source, the group's first one counts. Entries have no rivals; their values are their text, ``employer|title`` or ``institution|degree``.
    """
    columns = [c for c in FIELDS if c in merged.columns and c in rows.columns and c != "additional_data"]
    kinds = {c: rows.schema[c].dataType for c in columns}
    shares = agreement(merged, rows, columns, group)
    out = merged.join(shares.select(group, *[F.col(c).alias(f"_agree_{c}") for c in columns]), group).join(source_records(rows, group), group)
    # a field's source is found once, then looked up: inside the search it would be found anew for each of the group's sources
    kind_of = lambda source: F.get(F.transform(F.array(source), lambda known: F.get(F.filter("source_records", lambda s: s["id"] == known), F.lit(0))["type"]), F.lit(0))
    sources = F.array(F.get("source_records", F.lit(0))["id"])  # the first stands in where no decision names one
    first = score.source_weight(F.get("source_records", F.lit(0))["type"])
    parts = {}
    for column, field in FIELDS.items():
        if column not in columns:
            parts[field] = score.score_record(F.lit(field), F.col("id"), first, F.lit(1.0), F.lit(0.0), F.lit(0.0))
            continue
        value = narrowed(F.col(column), kinds[column])
        own = F.filter("provenance", lambda p: (p["field"] == field) | F.startswith(p["field"], F.lit(f"{field}.")))  # noqa: B023
        complete = F.least(F.lit(1.0), generic.completeness(value, kinds[column]) / 100)
        parts[field] = score.score_record(F.lit(field), F.col("id"), score.source_weight(kind_of(primary_source(own, sources))), F.col(f"_agree_{column}"), complete, validity(value, kinds[column], field))
    out = out.withColumns({f"_score_{f}": c for f, c in parts.items()})
    overall = score.overall({f: F.col(f"_score_{f}.value") for f in parts})
    whole = F.struct(
        F.col("_score_fullName.id").alias("id"), F.lit("overall").alias("field"), overall.alias("value"), F.lit("weighted mean of all fields").alias("reason"), F.lit(sum(FIELD_WEIGHTS.values())).alias("weight"), (overall < 0).alias("low"),
    )
    entries = {
        "contacts": lambda x: x["value"], "links": lambda x: x["url"], "skills": lambda x: x,
        "experiences": lambda x: F.concat(x["employer"], F.lit("|"), F.coalesce(x["title"], F.lit(""))), "education": lambda x: F.concat(x["institution"], F.lit("|"), F.coalesce(x["degree"], F.lit(""))),
    }
    told = [score.entity_scores(F.col(c), FIELDS[c], F.col("id"), first, lambda x, v=v: merge.text_completeness(v(x)), lambda x, v=v: F.when(F.trim(v(x)) != "", 1.0).otherwise(0.0)) for c, v in entries.items() if c in columns]
    out = out.withColumns({
        "confidence": F.concat(F.array(*[F.col(f"_score_{f}") for f in parts]), F.array(whole)),
        "entry_scores": F.concat(*told),
        "metadata": candidate_metadata(F.col("id"), F.transform("source_records", lambda s: s["name"]), F.lit(len(FIELDS)), F.col("updated_at")),
    })
    return out.drop(*[f"_score_{f}" for f in parts], *[f"_agree_{c}" for c in columns])
