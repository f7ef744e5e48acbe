"""Where values come from: one long table of field histories, merge decisions and source records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MERGE_STRATEGIES, SOURCE_WEIGHTS
from ..functions.ids import det_id
from .confidence import narrowed
from .generic import serialized
from .operations import OPERATION
from .records import contact_value

COLUMNS = ("group_ix", "id", "field", "source_record_id", "source_priority", "normalizer", "extracted", "original", "normalized", "selected", "strategy")


def source_priority(source_type: Column) -> Column:
    """The place of the type in the table of weights, from 0; null for others."""
    at = F.array_position(F.array(*[F.lit(x) for x in SOURCE_WEIGHTS]), source_type)
    return F.when(at > 0, at - 1).cast("int")


def field_history(values: DataFrame, operations: DataFrame, selected: DataFrame) -> DataFrame:
    """One row per value and normalization of it, or one row without a normalization.

    ``values``: group_ix, candidate_ix, source_record_id, source_type, field, value. ``operations``: candidate_ix, op_field,
    normalizer, original, normalized; one belongs to its field and to every field above it in its dotted path, so the join is
    on equal keys. ``selected``: group_ix, field, selected, strategy.
    """
    parts = F.split("op_field", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    ops = operations.select("candidate_ix", F.explode(above).alias("field"), "normalizer", "original", "normalized")
    h = values.join(ops, ["candidate_ix", "field"], "left").join(selected, ["group_ix", "field"], "left")
    h = h.withColumn("id", det_id("field-history", F.col("group_ix"), F.col("field"), F.col("source_record_id"), F.col("normalizer")))
    return h.withColumn("source_priority", source_priority(F.col("source_type"))).select(*[F.col("value").alias(c) if c == "extracted" else F.col(c) for c in COLUMNS])


def source_history(records: DataFrame) -> DataFrame:
    """One row per source record (group_ix, source_record_id, source_type)."""
    field = F.concat(F.lit("sourceRecords."), "source_record_id")
    made = {"field": field, "id": det_id("source-history", F.col("group_ix"), F.col("source_record_id")), "source_priority": source_priority(F.col("source_type"))}
    r = records.withColumns(made)
    return r.select(*[F.col(c) if c in r.columns else F.lit(None).cast("string").alias(c) for c in COLUMNS])


def provenance(*histories: DataFrame) -> DataFrame:
    """All rows, one per group and id: two normalizations of one field, source and normalizer are one, the smallest."""
    every = histories[0]
    for h in histories[1:]:
        every = every.unionByName(h)
    rest = [c for c in COLUMNS if c not in ("group_ix", "id")]
    first = every.groupBy("group_ix", "id").agg(F.min(F.struct(*rest)).alias("s"))
    return first.select("group_ix", "id", "s.*").select(*COLUMNS)


def attached(entities: DataFrame, histories: DataFrame, path: str = "path") -> DataFrame:
    """Entities (group_ix, path) with ``provenance``: the histories about their own path, by id; an empty list where there is none."""
    rest = [c for c in COLUMNS if c not in ("group_ix", "field")]
    about = histories.groupBy("group_ix", F.col("field").alias(path)).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias("provenance"))
    kind = about.schema["provenance"].dataType
    return entities.join(about, ["group_ix", path], "left").withColumn("provenance", F.coalesce("provenance", F.array().cast(kind)))


def of_records(merged: DataFrame, rows: DataFrame, fields: dict[str, str], group: str = "group_ix") -> DataFrame:
    """The whole lineage of canonical records, one long table with ``COLUMNS`` (group_ix is the record's id): the decisions behind them, the
    history of each field in each record they were merged from, and their sources. A selected value is told with the fields that records have: those that
    only canonical records have list a group's sources, and each of these has a history with the selected value.

    ``rows``: group, candidate_ix, source_id, source_type, ``operations`` and the columns of ``fields`` (column: field). An operation on an e-mail or phone speaks of the
    first contact of its kind.
    """
    kinds = {c: rows.schema[c].dataType for c in fields}
    text = lambda c: F.col(c) if kinds[c].typeName() == "string" else F.when(F.col(c).isNotNull(), serialized(narrowed(F.col(c), kinds[c]), kinds[c]))
    own = merged.select(F.col(group).alias("_g"), F.col("id").alias("group_ix"))
    r = rows.withColumnRenamed(group, "_g").join(own, "_g")
    entries = F.array(*[F.struct(F.lit(f).alias("field"), text(c).alias("value")) for c, f in fields.items()])
    values = r.select("group_ix", "candidate_ix", F.col("source_id").alias("source_record_id"), "source_type", F.inline(entries))
    made = r.select("candidate_ix", F.inline("operations")).withColumnRenamed("field", "op_field")
    selected = merged.select(F.col("id").alias("group_ix"), F.inline(F.array(*[F.struct(F.lit(f).alias("field"), text(c).alias("selected"), F.lit(MERGE_STRATEGIES[f]).alias("strategy")) for c, f in fields.items()])))
    history = field_history(values, made, selected)
    if "contacts" in fields:  # what an operation on a contact was extracted from is that contact, not the list
        first = r.select("group_ix", F.col("source_id").alias("source_record_id"), "candidate_ix", contact_value(F.lit("contactInfo.email"), F.col("contacts"), F.lit(None)).alias("_email"), contact_value(F.lit("contactInfo.phone"), F.col("contacts"), F.lit(None)).alias("_phone"))
        first = first.groupBy("group_ix", "source_record_id").agg(F.min_by("_email", "candidate_ix").alias("_email"), F.min_by("_phone", "candidate_ix").alias("_phone"))
        spoken = F.when(F.col("normalizer") == "EmailNormalizer", F.col("_email")).when(F.col("normalizer") == "PhoneNormalizer", F.col("_phone"))
        history = history.join(first, ["group_ix", "source_record_id"], "left").withColumn("extracted", F.coalesce(F.when(F.col("field") == "contactInfo", spoken), F.col("extracted"))).select(*COLUMNS)
    decided = merged.select(F.col("id").alias("_owner"), F.inline("provenance"))
    none = F.lit(None).cast("string")
    decided = decided.select(F.col("_owner").alias("group_ix"), "id", "field", F.col("source").alias("source_record_id"), F.lit(None).cast("int").alias("source_priority"), none.alias("normalizer"), F.col("value").alias("extracted"), none.alias("original"), none.alias("normalized"), F.col("value").alias("selected"), "strategy")
    sources = r.select("group_ix", F.col("source_id").alias("source_record_id"), "source_type").distinct()
    return provenance(decided, history, source_history(sources))


def entries(merged: DataFrame, rows: DataFrame, fields: dict[str, str], group: str = "group_ix") -> DataFrame:
    """The rows of :func:`of_records` without their texts and priorities, which are null, and with ``source_name``, that of the source's first record.

    ``rows`` has source_name besides. A source's records meet by group and source, in one row that holds no more than its pairs of field and normalizer; its entries are spread from there
    without another shuffle. Nothing is gathered by group, so no group's sources are one row or one task.
    """
    none = F.lit(None).cast("string")

    def pairs(ops: Column) -> Column:
        """The histories of a record: a field's normalizers, or none for a field without operations."""
        out = []
        for f in fields.values():
            about = F.filter(ops, lambda o: (o["field"] == f) | F.startswith(o["field"], F.lit(f"{f}.")))  # noqa: B023
            pair = lambda normalizer: F.struct(F.lit(f).alias("field"), normalizer.alias("normalizer"), F.lit(MERGE_STRATEGIES[f]).alias("strategy"))  # noqa: B023, E731
            out.append(F.when(F.size(about) > 0, F.transform(about, lambda o: pair(o["normalizer"]))).otherwise(F.array(pair(none))))  # noqa: B023
        return F.concat(*out)

    applied = F.array_distinct(F.transform(F.coalesce("operations", F.array().cast(OPERATION)), lambda o: F.struct(o["field"].alias("field"), o["normalizer"].alias("normalizer"))))
    own = merged.select(F.col(group).alias("_g"), F.col("id").alias("group_ix"))
    sources = rows.groupBy(F.col(group).alias("_g"), F.col("source_id").alias("source_record_id")).agg(F.collect_set(applied).alias("_applied"), F.min_by("source_name", "candidate_ix").alias("source_name")).join(own, "_g")
    record = F.struct(F.concat(F.lit("sourceRecords."), "source_record_id").alias("field"), none.alias("normalizer"), none.alias("strategy"))
    spread = sources.select("group_ix", "source_record_id", "source_name", F.inline(F.concat(F.array_distinct(F.flatten(F.transform("_applied", pairs))), F.array(record))))
    of_source = F.col("strategy").isNull()
    of_field = det_id("field-history", F.col("group_ix"), F.col("field"), F.col("source_record_id"), F.col("normalizer"))
    spread = spread.withColumn("id", F.when(of_source, det_id("source-history", F.col("group_ix"), F.col("source_record_id"))).otherwise(of_field))
    decided = merged.select(F.col("id").alias("group_ix"), F.inline("provenance")).withColumnRenamed("source", "source_record_id")
    decided = decided.join(sources.select("group_ix", "source_record_id", "source_name"), ["group_ix", "source_record_id"], "left").withColumn("normalizer", none)
    given = ("group_ix", "id", "field", "source_record_id", "source_name", "normalizer", "strategy")
    every = decided.select(*given).unionByName(spread.select(*given))
    return every.select(*[F.col(c) if c in given else F.lit(None).cast("int" if c == "source_priority" else "string").alias(c) for c in COLUMNS], "source_name")
