"""Where a language model may take part. None is shipped: without hooks every result is the deterministic one.

A hook is a plain function from a DataFrame of requests (request_id, request) to one of answers (request_id, answer), both JSON texts, so it can be a
Pandas UDF, a join with prepared answers, or anything else that Spark distributes. Equal requests are asked once, and never again where a
cache table is named. Answers that are no JSON of the expected form say nothing. What hooks decide is kept beside the data, not instead of it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.normalize import unique_ci
from .operators.operations import OPERATION
from .operators.resume import section
from .operators.score import rounded4
from .operators.tables import written

# Stages a hook may serve, and its weight in mixed scores with and without evidence.
STAGES = ("extraction", "normalization", "merge", "confidence", "validation")
GROUNDED, UNGROUNDED = 0.8, 0.4
TEXT_LIMIT, SECTION_LIMIT = 6000, 2500


@dataclass(frozen=True)
class Hooks:
    """``calls``: a function DataFrame -> DataFrame for each stage that has one; ``mode`` ``deterministic-only`` turns all off; ``cache``: a folder that driver and
    executors share, where answers are kept from run to run."""

    calls: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    mode: str = "deterministic-only"
    cache: str | None = None

    def serve(self, stage: str) -> bool:
        return self.mode != "deterministic-only" and stage in self.calls

    def answered(self, stage: str, rows: DataFrame, request: Column, form: str) -> DataFrame:
        """``rows`` with ``answer``, a structure of ``form``: the answer to ``request``, null where there is none.

        Requests are told apart by their digest; those that the cache does not know are asked, each once, and their answers added to it.
        """
        asked = rows.withColumn("_request", request).withColumn("_id", F.sha2("_request", 256))
        distinct = written(asked.filter("_request is not null").groupBy(F.col("_id").alias("request_id")).agg(F.any_value("_request").alias("request")), f"{stage}-requests")
        place = f"{self.cache.rstrip('/')}/{stage}" if self.cache else None
        known = _read_if_there(rows.sparkSession, place) if place else None
        fresh = distinct if known is None else distinct.join(known, "request_id", "left_anti")
        said = self.applied(stage, fresh).filter("answer is not null").groupBy("request_id").agg(F.min("answer").alias("answer"))
        said = written(said.join(fresh.select("request_id"), "request_id", "left_semi"), f"{stage}-answers")
        if place:
            said.write.mode("append").parquet(place)
        every = said if known is None else said.unionByName(known)
        parsed = every.select(F.col("request_id").alias("_id"), F.from_json("answer", form).alias("answer"))
        return asked.join(parsed, "_id", "left").drop("_id", "_request")

    def applied(self, stage: str, df: DataFrame) -> DataFrame:
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        call = None if self.mode == "deterministic-only" else self.calls.get(stage)
        return call(df) if call else df


def _read_if_there(spark: SparkSession, place: str) -> DataFrame | None:
    try:
        return spark.read.schema("request_id string, answer string").parquet(place)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


# What answers look like, by stage.
ANSWERS = {
    "extraction": "full_name string, headline string, summary string, skills array<string>",
    "normalization": "headline string, employerAliases map<string,string>, skillAliases map<string,string>",
    "merge": "advice string",
    "confidence": "assessments array<struct<fieldPath:string,score:double,grounded:boolean>>",
    "validation": "warnings array<struct<code:string,severity:string,message:string>>",
}


def completed(records: DataFrame, texts: DataFrame, hooks: Hooks) -> DataFrame:
    """Records of text sources with their empty fields filled from what a hook reads in the text. ``texts``: path, text."""
    told = F.to_json(F.struct(F.lit("extraction").alias("stage"), evidence(F.col("text")).alias("text"), F.struct(*[evidence(section(F.col("text"), s), SECTION_LIMIT).alias(s) for s in ("summary", "skills", "experience", "education")]).alias("sections")))
    a = hooks.answered("extraction", texts.select("path", "text"), told, ANSWERS["extraction"]).select("path", "answer")
    filled = {c: only_missing(F.col(c), F.col("answer")[c]) for c in ("full_name", "headline", "summary")}
    filled["skills"] = F.when(F.size("skills") > 0, F.col("skills")).otherwise(F.coalesce(F.col("answer.skills"), F.col("skills")))
    return records.join(a, "path", "left").withColumns(filled).drop("answer")


def renamed(records: DataFrame, hooks: Hooks) -> DataFrame:
    """Normalized records with the headline, employers and skills that a hook names otherwise, and the log of it in ``operations``."""
    told = F.to_json(F.struct(F.lit("normalization").alias("stage"), "headline", F.transform("experiences", lambda x: x["employer"]).alias("employers"), "skills"))
    r = hooks.answered("normalization", records, told, ANSWERS["normalization"])
    employers, skills = F.coalesce("answer.employerAliases", F.create_map().cast("map<string,string>")), F.coalesce("answer.skillAliases", F.create_map().cast("map<string,string>"))
    one = lambda name, a, b: F.struct(F.lit(name).alias("field"), F.lit("LLMSemanticNormalizer").alias("normalizer"), a.alias("original"), b.alias("normalized"))
    made = F.concat(
        F.array(one("headline", F.col("headline"), F.coalesce("answer.headline", "headline"))),
        F.transform("skills", lambda s: one("skill.name", s, aliased(s, skills))),
        F.transform("experiences", lambda x: one("experience.employer", x["employer"], aliased(x["employer"], employers))),
    )
    log = F.filter(made, lambda o: ~o["original"].eqNullSafe(o["normalized"]))
    return r.withColumns({
        "operations": F.concat("operations", log.cast(OPERATION)),
        "headline": F.coalesce("answer.headline", "headline"),
        "experiences": F.transform("experiences", lambda x: x.withField("employer", aliased(x["employer"], employers))),
        "skills": unique_ci(F.transform("skills", lambda s: aliased(s, skills))),
    }).drop("answer")


def advised(merged: DataFrame, hooks: Hooks) -> DataFrame:
    """(id, field, value, discarded, advice, applied): the conflicts behind canonical records and what a hook says of each; nothing is applied."""
    c = merged.select(F.col("id").alias("record_id"), F.inline("provenance")).filter(F.size("discarded") > 0).select(F.col("record_id").alias("id"), "field", "value", "discarded")
    key = F.xxhash64("id", "field")
    told = F.to_json(F.struct(F.lit("merge").alias("stage"), "field", "value", "discarded"))
    a = hooks.answered("merge", c, told, ANSWERS["merge"]) if hooks.serve("merge") else c.withColumn("answer", F.lit(None).cast("struct<advice:string>"))
    return decisions(c.withColumn("_key", key), a.select(key.alias("_key"), "answer.advice"), "_key").drop("_key")


def assessed(scored: DataFrame, hooks: Hooks) -> DataFrame:
    """Scored records with a hook's assessments mixed into the scores of fields and entries, and the record's own score anew."""
    targets = lambda scores: F.transform(F.filter(scores, lambda s: s["value"] > 0), lambda s: s["field"])
    shown = F.struct("headline", "summary", "location", "skills", F.transform("experiences", lambda x: F.struct(x["employer"], x["title"], x["description"])).alias("experiences"), F.transform("education", lambda x: F.struct(x["institution"], x["degree"], x["field"])).alias("education"))
    told = F.to_json(F.struct(F.lit("confidence").alias("stage"), F.concat(targets("confidence"), targets("entry_scores")).alias("targets"), shown.alias("values")))
    r = hooks.answered("confidence", scored, told, ANSWERS["confidence"])

    def mixed(s: Column) -> Column:
        a = F.get(F.filter("answer.assessments", lambda x: (x["fieldPath"] == s["field"]) & x["score"].between(0, 1)), F.lit(0))
        return s.withField("value", mixed_score(s["value"], a["score"], F.coalesce(a["grounded"], F.lit(True))))

    fields = F.transform(F.filter("confidence", lambda s: s["field"] != "overall"), mixed)
    r = r.withColumns({"_fields": fields, "entry_scores": F.transform("entry_scores", mixed)})
    total = lambda value: F.aggregate("_fields", F.lit(0.0), lambda a, s: a + value(s))
    own = rounded4(total(lambda s: s["value"] * s["weight"]) / total(lambda s: s["weight"]))
    overall = F.transform(F.filter("confidence", lambda s: s["field"] == "overall"), lambda s: s.withField("value", own))
    return r.withColumn("confidence", F.concat("_fields", overall)).drop("_fields", "answer")


def warned(merged: DataFrame, hooks: Hooks) -> DataFrame:
    """(id, code, severity, message): what a hook finds odd in canonical records."""
    told = F.to_json(F.struct(F.lit("validation").alias("stage"), "full_name", "headline", F.transform("experiences", lambda x: F.struct(x["employer"], x["title"], x["start"], x["end"])).alias("experiences"), F.transform("education", lambda x: F.struct(x["institution"], x["end"])).alias("education")))
    a = hooks.answered("validation", merged.select("id", "full_name", "headline", "experiences", "education"), told, ANSWERS["validation"])
    return a.select("id", F.inline("answer.warnings")).select("id", "code", F.coalesce("severity", F.lit("warn")).alias("severity"), "message")


def only_missing(own: Column, proposed: Column) -> Column:
    """A proposal fills a field that is empty, it never replaces one."""
    return F.coalesce(own, proposed)


def aliased(value: Column, aliases: Column) -> Column:
    """A value under its exact key in a map of proposed names."""
    return F.coalesce(F.try_element_at(aliases, value), value)


def mixed_score(deterministic: Column, proposed: Column, grounded: Column) -> Column:
    """A score with its share of a proposed one: more where evidence supports it; the deterministic one without a proposal."""
    w = F.when(grounded, GROUNDED).otherwise(UNGROUNDED)
    return F.when(proposed.isNull(), deterministic).otherwise(rounded4(deterministic * (1 - w) + proposed * w))


def evidence(text: Column, limit: int = TEXT_LIMIT) -> Column:
    """What a hook is shown of a text: its beginning, marked where cut."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def decisions(conflicts: DataFrame, advised: DataFrame, key: str) -> DataFrame:
    """Conflicts with the advice given on them, recorded and never applied."""
    return conflicts.join(advised.select(key, "advice"), key, "left").withColumn("applied", F.lit(False))
