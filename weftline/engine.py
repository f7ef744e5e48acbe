"""Files to profiles in one flow: extract, normalize, resolve, merge, project, check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import FusionError, IdentityError, MergeConflictError
from .hooks import Hooks, advised, assessed, renamed, warned
from .operators import canonical, confidence, identity, lineage, merge, operations, records
from .operators.order import numbered
from .operators.tables import written
from .plans import contract
from .plans.projection import Config, project
from .sources import extract, files


@dataclass
class Transformed:
    profiles: DataFrame  # projected
    canonical: DataFrame  # with decisions and scores
    rejects: DataFrame
    warnings: DataFrame
    lineage: DataFrame
    conflicts: DataFrame  # with the advice of a hook, if there is one
    sources: DataFrame  # path, name, source_type and source_name of every file, rejects included
    records: DataFrame  # normalized, with their groups


def resolved(found: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """Normalized records (path, row_no, source_type, extractor and the record columns) with rank, candidate_ix, keys, group_ix, group_id and source_id.

    candidate_ix numbers the records by path and row in one order over all (:func:`weftline.operators.order.numbered`), so equal records are two and ties go to the
    earlier one. A record without a path has no source and cannot be resolved: an error. A source goes by ``source_name`` where the records have one, else by its file's name.
    """
    if found.filter("path is null").first():
        raise IdentityError("a record has no source")
    n = records.normalized(found.withColumn("operations", operations.of_record()))
    if hooks and hooks.serve("normalization"):
        n = renamed(n, hooks)
    label = merge.source_label(F.concat_ws(" ", "source_type", F.substring_index("path", "/", -1), "extractor"), F.col("source_type"))
    name = records.display_name(F.col("full_name"), F.col("first_name"), F.lit(None).cast("string"), F.col("last_name"))
    place = records.location_fingerprint(F.col("location"))
    fallback = identity.fallback_key(name, records.primary_employer(F.col("experiences")), place)
    n = n.withColumns({"rank": merge.priority_rank(label), "source_id": F.sha2(F.col("path"), 256), "source_name": F.coalesce(F.col("source_name") if "source_name" in found.columns else F.lit(None), F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")), "display_name": name, "fingerprint": place})
    n = n.withColumn("keys", identity.identity_keys(F.col("contacts"), F.col("links"), fallback))
    r = written(identity.resolve(numbered(n, ["path", "row_no"])), "resolved-records")
    ids = identity.group_ids(r, name="display_name", location="fingerprint", source="source_id").select("group_ix", "group_id")
    return r.join(ids, "group_ix").drop("display_name", "fingerprint")


def entries(scored: DataFrame, history: DataFrame) -> DataFrame:
    """(id, place, x, name): the entries of the records' provenance, one a row, with their order and their sources' names. ``history``: the records' lineage
    (:func:`weftline.operators.lineage.of_records`, or :func:`weftline.operators.lineage.entries`, which knows the names)."""
    none = F.lit(None).cast("string")
    x = F.struct("field", "source_record_id", none.alias("source_name"), "normalizer", "strategy", none.alias("extractor"), "id", "extracted", "original", "normalized", "selected")
    # decisions and fields by their names, then sources, then what was normalized
    place = F.struct(F.col("normalizer").isNotNull().cast("int").alias("a"), F.startswith("field", F.lit("sourceRecords.")).cast("int").alias("b"), "field", "source_record_id", "normalizer", "id")
    if "source_name" not in history.columns:
        # names meet the entries in a join: looked up inside a record, each entry would pass all of its sources
        names = scored.select("id", F.explode("source_records").alias("s")).select(F.col("id").alias("group_ix"), F.col("s.id").alias("source_record_id"), F.col("s.name").alias("source_name"))
        history = history.join(names, ["group_ix", "source_record_id"], "left")
    return history.select(F.col("group_ix").alias("id"), place.alias("place"), x.alias("x"), F.col("source_name").alias("name"))


def profiles(scored: DataFrame, history: DataFrame, apart: bool = False) -> DataFrame:
    """Scored canonical records with the columns that projections read. ``history``: their lineage, as :func:`entries` takes it.

    A record's whole provenance is one list in its row. ``apart``: it is left to rows of their own (:func:`weftline.plans.projection.listed`); the record keeps
    the entries about its skills alone, which tell the names of their sources, one per field and name.
    """
    told = entries(scored, history)
    if apart:
        field = F.col("x.field")
        told = told.filter((field == "skills") | F.startswith(field, F.lit("skills."))).groupBy("id", field, "name").agg(F.min(F.struct("place", "x")).alias("first")).select("id", "first.place", "first.x", "name")
    gathered = told.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "x", "name"))).alias("_all"))
    gathered = gathered.select("id", F.transform("_all", lambda p: p["x"]).alias("provenance"), F.transform("_all", lambda p: p["name"]).alias("provenance_names"))
    out = scored.drop("provenance").join(gathered, "id", "left")
    about = lambda field: F.filter("entry_scores", lambda s: s["field"] == field)
    detail = lambda s, i: F.struct(
        s.alias("name"), F.transform(about(F.concat(F.lit("skills."), i.cast("string"))), lambda x: x["value"]).alias("confidence"), F.filter("provenance", lambda p: p["field"] == F.concat(F.lit("skills."), F.lower(s))).alias("provenance"),
    )
    return out.withColumn("skill_details", F.transform("skills", detail))


def described(given: DataFrame, descriptors: DataFrame | None) -> DataFrame:
    """Files with the name and type that a descriptor gives their source, by the file's place in the order of paths, else by its name; otherwise those of the file itself."""
    if descriptors is None:
        return given.withColumn("source_name", F.lit(None).cast("string"))
    listed = files.described(numbered(given.select("path", "name"), ["path"], "ord"), descriptors)
    return given.drop("source_type").join(listed.select("path", "source_name", "source_type"), "path")


def transform(
    spark: SparkSession, folder: str, config: Config | dict | None = None, received_at: str = "1970-01-01T00:00:00Z", strict: bool = False, hooks: Hooks | None = None, descriptors: DataFrame | None = None,
) -> Transformed:
    """All files of a folder to projected profiles, with what was put aside and warned of.

    ``config`` is a projection or its JSON form (an invalid one counts as none). ``received_at`` is the time that sources
    without one of their own carry. Files that cannot be used are rejects; strict runs end with the first.
    ``hooks``: functions that may take part in a stage; without them every result is the deterministic one. ``descriptors``: (ord, file_name, source_name,
    source_type), see :func:`weftline.sources.files.described`; the types decide which extractor takes a file. A conflict that no source wins is an error.
    """
    plan = config if isinstance(config, Config) else contract.parsed_config(config)
    hooks = hooks or Hooks()
    given = described(files.read(spark, folder), descriptors)
    sources = written(given.select("path", "name", "source_type", "source_name"), "sources")
    found, rejects = extract.extracted(given, strict, hooks)
    rows = resolved(found.join(sources.select("path", "source_name"), "path", "left"), hooks).withColumn("received_at", F.lit(received_at))
    merged = written(canonical.canonical(rows, ids=rows.select("group_ix", "group_id").distinct()), "canonical-records")
    if lost := canonical.undecided(merged).first():
        raise MergeConflictError("conflicting values without a winner", group_id=lost["group_id"], field=lost["field"])
    known = confidence.scored(merged, rows)
    known = written(assessed(known, hooks) if hooks.serve("confidence") else known, "scored-records")
    fields = {c: f for c, f in confidence.FIELDS.items() if c in rows.columns and c in merged.columns}
    history = written(lineage.of_records(merged, rows, fields), "lineage")
    warnings = contract.chronology(merged, "id")
    if hooks.serve("validation"):
        warnings = warnings.unionByName(warned(merged, hooks))
    return Transformed(project(profiles(known, history), plan), known, rejects, warnings, history, advised(merged, hooks), sources, rows)


def summary(out: Transformed) -> DataFrame:
    """(measure, value) of a run: its candidates, their sources, decisions and mean confidence, and how many conflicts, histories, warnings and rejects there are."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("double")
    own = {"candidates": F.count("*").cast("double"), "sources": size("sources"), "decisions": size("provenance"), "mean_confidence": F.avg(F.element_at("confidence", -1)["value"])}
    rows = out.canonical.agg(*[c.alias(n) for n, c in own.items()]).select(F.inline(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in own])))
    for name, df in (("conflicts", out.conflicts), ("histories", out.lineage), ("warnings", out.warnings), ("rejects", out.rejects)):
        rows = rows.unionByName(df.agg(F.count("*").cast("double").alias("value")).select(F.lit(name).alias("measure"), "value"))
    return rows


def response(out: Transformed, request_id: str, duration_ms: int) -> DataFrame:
    """One row of JSON, ``response``: success, the request's id, its duration and the five counts of the run. The candidates themselves are the rows of ``profiles``, as there may be
    too many for one text; ``save`` writes them beside it."""
    # fixed values: the counts' names
    counted = {"sourceCount": out.sources, "partialCandidateCount": out.records, "normalizedCandidateCount": out.records, "canonicalCandidateCount": out.canonical, "projectedCandidateCount": out.profiles}
    told = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counted.items()])
    counts = told.agg(*[F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in counted])
    data = F.struct(F.struct(*counted).alias("summary"))
    return counts.select(F.to_json(F.struct(F.lit(True).alias("success"), F.lit(request_id).alias("requestId"), F.lit(int(duration_ms)).cast("long").alias("duration"), data.alias("data"))).alias("response"))


def failure(error: FusionError, request_id: str) -> dict:
    """What a failed run answers: its code, status, message and details."""
    return {"success": False, "requestId": request_id, "error": {"code": error.code, "status": error.status, "message": str(error), "details": error.details}}


def save(out: Transformed, folder: str) -> None:
    """Write a run as JSON lines: ``profiles``, ``rejects``, ``warnings``, ``conflicts``, ``lineage``, and ``summary``, each a folder of its own in ``folder``."""
    for name in ("profiles", "rejects", "warnings", "conflicts", "lineage"):
        getattr(out, name).write.json(f"{folder.rstrip('/')}/{name}")
    summary(out).coalesce(1).write.json(f"{folder.rstrip('/')}/summary")
