"""What results must fulfil: output contract, domain rules, chronology, configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import ConfigurationError
from .projection import Config, ProjectionError, compile_plan

# What kinds, platforms and levels a record may name.
KINDS = ("email", "phone", "website", "other")
PLATFORMS = ("linkedin", "github", "portfolio", "twitter", "other")
UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}\z"


def parsed_config(given: dict | None, strict: bool = False) -> Config:
    """A configuration from its JSON form, camel and snake case alike; an invalid one is an error if strict, else the default.

    What a missing field does is said by ``on_missing``, else by ``includeNullish``, else by ``missingValuePolicy``.
    """
    known = {
        "fields": "fields", "exclude": "exclude", "rename": "rename", "computedFields": "computed", "computed_fields": "computed", "formatting": "formats", "includeConfidence": "include_confidence",
        "include_confidence": "include_confidence", "includeProvenance": "include_provenance", "include_provenance": "include_provenance", "includeSourceRecords": "include_source_records", "include_source_records": "include_source_records",
    }
    policies = ("on_missing", "includeNullishFields", "include_nullish_fields", "missingValuePolicy", "missing_value_policy")
    carried = ("id", "target", "allow", "block", "transforms")
    try:
        given = dict(given or {})
        if unknown := set(given) - set(known) - set(policies) - set(carried):
            raise ConfigurationError(f"unknown keys {sorted(unknown)}")
        out = {known[k]: v for k, v in given.items() if k in known}
        out.setdefault("fields", given.get("allow", ()))
        out.setdefault("exclude", given.get("block", ()))
        nullish = given.get("includeNullishFields", given.get("include_nullish_fields"))
        fallback = given.get("missingValuePolicy", given.get("missing_value_policy", "omit"))
        out["missing"] = given.get("on_missing") or ({True: "null", False: "omit"}[nullish] if nullish is not None else fallback)
        config = Config(**{k: tuple(v) if k in ("fields", "exclude", "computed") else v for k, v in out.items()})
        compile_plan(config)
    except (ConfigurationError, ProjectionError, TypeError, KeyError, AttributeError, ValueError) as e:
        if strict:
            raise e if isinstance(e, ConfigurationError) else ConfigurationError(str(e)) from e
        return Config()
    return config


def violations(projected: DataFrame, config: Config, key: str) -> DataFrame:
    """(key, path) of every planned path that a projected row lacks though the policy wants it; a schema without a path lacks it in all rows.

    Under ``omit`` nothing is wanted."""
    wanted = [] if config.missing == "omit" else [p.split(".")[0] for p, _ in compile_plan(config)]
    if config.missing == "null":  # null is there
        lacking = [F.lit(p) for p in dict.fromkeys(wanted) if p not in projected.columns]
    else:
        lacking = [F.when(F.col(p).isNull() if p in projected.columns else F.lit(True), p) for p in dict.fromkeys(wanted)]
    found = F.array_compact(F.array(*lacking)) if lacking else F.array().cast("array<string>")
    return projected.select(key, F.explode(found).alias("path"))


def chronology(records: DataFrame, key: str, experiences: str = "experiences") -> DataFrame:
    """Warnings (key, code, severity, message) of records with a job that ends before it starts, as text; the rest give none."""
    wrong = F.exists(experiences, lambda e: F.coalesce(e["end"] < e["start"], F.lit(False)))
    return records.filter(wrong).select(key, F.lit("IMPOSSIBLE_CHRONOLOGY").alias("code"), F.lit("warn").alias("severity"), F.lit("a job ends before it starts").alias("message"))


def domain_violations(records: DataFrame, key: str) -> DataFrame:
    """(key, field, problem) of canonical records that break a rule of their fields: ids, kinds, platforms, addresses, names, dates."""
    bad = lambda field, problem, wrong: F.when(F.coalesce(wrong, F.lit(False)), F.struct(F.lit(field).alias("field"), F.lit(problem).alias("problem")))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    checks: list[Column] = [
        bad("id", "no id", F.col("id").isNull() | ~F.rlike("id", F.lit(UUID))),
        bad("contacts", "unknown kind", F.exists("contacts", lambda c: ~c["kind"].isin(*KINDS))),
        bad("contacts", "no value", F.exists("contacts", lambda c: blank(c["value"]))),
        bad("links", "unknown platform", F.exists("links", lambda x: ~x["platform"].isin(*PLATFORMS))),
        bad("links", "no address", F.exists("links", lambda x: ~F.coalesce(F.rlike(x["url"], F.lit("^[a-z][a-z0-9+.-]*:")), F.lit(False)))),
        bad("experiences", "no employer", F.exists("experiences", lambda x: blank(x["employer"]))),
        bad("education", "no institution", F.exists("education", lambda x: blank(x["institution"]))),
        bad("skills", "no name", F.exists("skills", blank)),
        bad("updated_at", "before it was created", F.col("updated_at") < F.col("created_at")),
    ]
    return records.select(key, F.explode(F.array_compact(F.array(*checks))).alias("x")).select(key, "x.*")
