"""Groups of records to one canonical record each, with the decisions that led there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import MERGE_STRATEGIES
from ..functions.ids import det_id
from . import buckets, generic, merge
from .tables import written

#: Scalar fields of a record and their names in the decisions; middle names are optional.
SCALARS = {"first_name": "firstName", "middle_name": "middleName", "last_name": "lastName", "full_name": "fullName", "headline": "headline", "summary": "summary", "location": "location"}


def decision(group_id: Column, field: str, winners: Column, candidates: Column, value: Column, discarded: Column, resolved_at: Column) -> Column:
    """A merge decision on one field: id, field, strategy, winners, candidates, value, discarded, resolved_at."""
    source = F.coalesce(F.get(winners, F.lit(0)), F.get(candidates, F.lit(0)))
    strategy = F.lit(MERGE_STRATEGIES[field])
    named = det_id("merge-provenance", group_id, F.lit(field), strategy, source, F.to_json(winners), F.to_json(candidates), value, F.to_json(discarded), resolved_at)
    return F.struct(
        named.alias("id"), F.lit(field).alias("field"), strategy.alias("strategy"), source.alias("source"), winners.alias("winners"),
        candidates.alias("candidates"), value.alias("value"), discarded.alias("discarded"), resolved_at.alias("resolved_at"),
    )


def remapped(entries: Column, ids: Column, owner: Column) -> Column:
    """Provenance entries with their sources replaced by the stable ids of the map ``ids``, renamed, each once and in order."""
    def to(s: Column) -> Column:
        return F.coalesce(F.try_element_at(ids, s), s)

    moved = F.transform(entries, lambda p: p.withField("source", to(p["source"])).withField("winners", F.array_distinct(F.transform(p["winners"], to))))
    renamed = F.transform(moved, lambda p: p.withField("id", det_id("provenance", owner, p["field"], p["source"], p["value"])))
    return F.flatten(F.transform(F.array(renamed), lambda a: F.filter(a, lambda p, i: F.array_position(F.transform(a, lambda q: q["id"]), p["id"]) == i + 1)))


def united(rows: DataFrame, group: str, entries: str, key, flags: tuple[str, ...] = (), lists: tuple[str, ...] = (), source: str | None = None) -> DataFrame:
    """(group, entries): the groups' entries of each key once, by first sight; the first in order stands for its key, flags are
    or-ed over all and ``lists`` joined, distinct. With ``source``, a column, also the distinct sources of all entries, that of the first entry first.

    Groups are met by key, so an entry that very many records share is one row per group and key. A group's own list
    is bounded by its distinct keys.
    """
    of = F.col(source) if source else F.lit(None).cast("string")
    flat = rows.select(group, "rank", "candidate_ix", of.alias("source"), F.posexplode(entries).alias("pos", "x"))
    flat = flat.withColumn("key", key(F.col("x"))).withColumn("ord", F.struct("rank", "candidate_ix", "pos"))
    joined = [F.array_distinct(F.flatten(F.collect_list(F.struct("ord", F.col(f"x.{n}").alias("l"))).getField("l"))).alias(n) for n in lists]
    once = flat.groupBy(group, "key").agg(F.min("ord").alias("ord"), F.min_by(F.struct("x", "source"), "ord").alias("first"), F.collect_set("source").alias("of"), *[F.bool_or(f"x.{f}").alias(f) for f in flags], *joined)
    x = F.col("first.x")
    for f in (*flags, *lists):
        x = x.withField(f, F.col(f))
    once = once.select(group, "ord", x.alias("x"), F.col("first.source").alias("source"), "of")
    g = once.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "source", "of")), lambda a, b: F.when(a["ord"] < b["ord"], -1).when(a["ord"] > b["ord"], 1).otherwise(0)).alias("all"))
    sources = F.array_distinct(F.concat(F.array(F.get("all", F.lit(0))["source"]), F.array_sort(F.flatten(F.transform("all", lambda e: e["of"])))))
    return g.select(group, F.transform("all", lambda e: e["x"]).alias(entries), *([sources.alias(f"{entries}_sources")] if source else []))


def undecided(merged: DataFrame) -> DataFrame:
    """(group_id, field) of decisions that put values aside though no source won."""
    lost = (F.col("x.discarded").isNotNull() & (F.size("x.discarded") > 0)) & ~F.coalesce(F.exists("x.winners", lambda w: w.isNotNull()), F.lit(False))
    return merged.select("group_id", F.explode("provenance").alias("x")).filter(lost).select("group_id", "x.field")


def canonical(rows: DataFrame, group: str = "group_ix", ids: DataFrame | None = None) -> DataFrame:
    """One row per group: id, its scalars by preference, united contacts, links, skills, jobs and schools, sources, decisions, created_at and updated_at.

    ``rows``: records (``weftline.sources.structured.RECORD``, optionally middle_name, tags and additional_data) with group_ix, rank, candidate_ix, source_id and
    received_at. ``ids``: (group, group_id), what canonical ids name; the group itself where not given. A group has one source at least. A field nobody fills is
    null or an empty list. Jobs of one employer and title, and schools of one institution and degree, unite where :mod:`buckets` says so; they keep the fields of
    their representative. Equal ranks and ties go to the earlier record. Repeated records are records of their own.
    """
    rows = written(rows, "records-to-merge")
    scalars = [c for c in SCALARS if c in rows.columns]
    about = rows.groupBy(group).agg(F.array_sort(F.collect_set("source_id")).alias("sources"), F.min("received_at").alias("created_at"), F.max("received_at").alias("updated_at"))
    out = about.join(ids, group) if ids is not None else about.withColumn("group_id", F.col(group).cast("string"))
    out = out.withColumn("id", det_id("canonical-candidate", F.col("group_id")))
    won = generic.merge_values(rows, group, scalars)
    out = out.join(won.select(group, *[F.col(c).alias(f"_{c}") for c in scalars]), group)
    decisions = []
    for column in scalars:
        w, kind = F.col(f"_{column}"), rows.schema[column].dataType
        value = generic.serialized(w["value"], kind) if column == "location" else w["value"]
        decisions.append(F.when(w.isNotNull(), decision(F.col("id"), SCALARS[column], F.array(w["source"]), w["candidates"], value, w["discarded"], F.col("updated_at"))))
        out = out.withColumn(column, w["value"])
    out = out.withColumn("location", F.when(F.col("location").isNotNull(), F.col("location").withField("id", det_id("location", F.col("group_id"), generic.serialized(F.col("location"), rows.schema["location"].dataType)))))
    lists = {
        "contacts": (lambda c: F.concat(c["kind"], F.lit(":"), F.lower(c["value"])), ("is_primary",)),
        "links": (lambda x: F.concat(x["platform"], F.lit(":"), F.lower(x["url"])), ()),
        "skills": (lambda s: F.lower(s), ()),
        "tags": (lambda s: s, ()),
    }
    lists = {c: how for c, how in lists.items() if c in rows.columns}
    shown = {"contacts": ("contactInfo", lambda c: c["value"]), "links": ("socialLinks", lambda x: x["url"]), "skills": ("skills", lambda s: s), "tags": ("tags", lambda s: s)}
    for column, (key, flags) in lists.items():
        out = out.join(united(rows, group, column, key, flags, source="source_id"), group, "left").withColumn(column, F.coalesce(column, F.array().cast(rows.schema[column].dataType)))
        field, value = shown[column]
        of = F.col(f"{column}_sources")
        decisions.append(F.when(of.isNotNull(), decision(F.col("id"), field, F.array(F.get(of, F.lit(0))), of, F.array_join(F.transform(column, value), ", "), F.array().cast("array<string>"), F.col("updated_at"))))
    named = lambda a, b: lambda x: F.concat_ws("|", F.lower(x[a]), F.coalesce(F.lower(x[b]), F.lit("")))
    jobs = buckets.united(rows, group, "experiences", named("employer", "title"), buckets.dated(), lists=("skills",) if "skills" in rows.schema["experiences"].dataType.elementType.names else ())
    schools = buckets.united(rows, group, "education", named("institution", "degree"), buckets.same_year(), start=None, current=None)
    numbered = lambda kind, *parts: lambda x, i: x.withField("id", det_id(kind, F.col("group_id"), *[F.coalesce(F.lower(x[p]), F.lit("")) for p in parts], i.cast("string")))
    for column, found, name in (("experiences", jobs, numbered("experience", "employer", "title", "start")), ("education", schools, numbered("education", "institution", "degree", "end"))):
        out = out.join(found, group, "left").withColumn(column, F.transform(F.coalesce(column, F.array().cast(found.schema[column].dataType)), name))
        entries = F.col(column)
        joined = F.array_join(F.transform(entries, lambda x: x["employer" if column == "experiences" else "institution"]), ", ")  # noqa: B023
        of = lambda part: F.array_distinct(F.flatten(F.transform(entries, lambda x: x[part])))  # noqa: B023, E731
        first = F.get(entries, F.lit(0))
        decisions.append(F.when(F.size(entries) > 0, decision(F.col("id"), column, F.array(first["source"]), of("sources"), joined, of("discarded"), F.col("updated_at"))))
    if "additional_data" in rows.columns:
        out = out.join(merge.merge_additional(rows, group, "additional_data"), group, "left")
    out = out.withColumn("provenance", F.array_compact(F.array(*decisions)))
    more = ["additional_data"] if "additional_data" in rows.columns else []
    return out.select("id", group, "group_id", *scalars, *lists, "experiences", "education", *more, "sources", "provenance", "created_at", "updated_at")
