"""Confidence of fields and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from ..config import DEFAULT_FIELD_WEIGHT, DEFAULT_SOURCE_WEIGHT, FIELD_WEIGHTS, LOW_CONFIDENCE, MISSING_SOURCE_WEIGHT, SOURCE_WEIGHTS
from ..functions.ids import det_id


def rounded4(c: Column) -> Column:
    """Half up at four digits, clamped to [0, 1]; see the README on ties."""
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 10000 + 0.5) / 10000


def source_weight(source_type: Column) -> Column:
    weights = F.create_map(*[F.lit(x) for p in SOURCE_WEIGHTS.items() for x in p])
    return F.when(source_type.isNull(), MISSING_SOURCE_WEIGHT).otherwise(F.coalesce(F.try_element_at(weights, source_type), F.lit(DEFAULT_SOURCE_WEIGHT)))


def agreement(selected: Column, values: Column) -> Column:
    """The share of a field's given values that equal the selected one, trimmed and without case; 1 for one value or none."""
    given = F.filter(values, lambda v: v.isNotNull())
    same = F.filter(given, lambda v: F.lower(F.trim(v)) == F.lower(F.trim(selected)))
    return F.when(F.size(given) <= 1, 1.0).otherwise(F.size(same) / F.size(given))


def contact_validity(contacts: Column) -> Column:
    """The mean over contacts: well-formed ones count 1, others less by kind; 0 for none."""
    one = lambda c: (
        F.when(c["kind"] == "email", F.when(F.rlike(c["value"], F.lit(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")), 1.0).otherwise(0.5))
        .when(c["kind"] == "phone", F.when(F.rlike(c["value"], F.lit(r"^\+[0-9]{8,15}$")), 1.0).otherwise(0.6))
        .when(c["kind"] == "website", F.when(F.rlike(c["value"], F.lit(r"^https?://")), 1.0).otherwise(0.6))
        .otherwise(0.8)
    )
    return F.when(F.size(contacts) > 0, F.aggregate(F.transform(contacts, one), F.lit(0.0), lambda a, x: a + x) / F.size(contacts)).otherwise(0.0)


def combined(source: Column, agree: Column, complete: Column, valid: Column) -> Column:
    return rounded4(source * agree * complete * valid)


def overall(scores: dict[str, Column]) -> Column:
    """The weighted mean over all fields, those without a score counting 0."""
    total = sum(FIELD_WEIGHTS.values())
    value = F.lit(0.0)
    for field, score in scores.items():
        value = value + F.coalesce(score, F.lit(0.0)) * FIELD_WEIGHTS[field]
    return rounded4(value / F.lit(total))


def score_record(field: Column, owner: Column, source: Column, agree: Column, complete: Column, valid: Column) -> Column:
    """One field's score with its parts: id, field, value, reason, weight, low (worth a second look)."""
    value = combined(source, agree, complete, valid)
    reason = F.format_string("source=%.2f, agreement=%.2f, completeness=%.2f, validation=%.2f", source.cast("double"), agree.cast("double"), complete.cast("double"), valid.cast("double"))
    weights = F.create_map(*[F.lit(x) for p in FIELD_WEIGHTS.items() for x in p])
    top = F.substring_index(field, ".", 1)
    return F.struct(
        det_id("field-confidence", owner, field).alias("id"),
        field.alias("field"),
        value.alias("value"),
        reason.alias("reason"),
        F.coalesce(F.try_element_at(weights, top), F.lit(DEFAULT_FIELD_WEIGHT)).alias("weight"),
        (value < LOW_CONFIDENCE).alias("low"),
    )


def entity_scores(entities: Column, field: str, owner: Column, source: Column, complete: Callable[[Column], Column], valid: Callable[[Column], Column]) -> Column:
    """A score for each entry of a list, under ``field.<place>``; an entry has no rivals, so its agreement is 1."""
    one = lambda x, i: score_record(F.concat(F.lit(f"{field}."), i.cast("string")), owner, source, F.lit(1.0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), complete(x) / 100)), valid(x))
    return F.transform(entities, one)
