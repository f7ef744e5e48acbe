"""Identity keys and the groups they connect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import det_id
from .components import connected_components
from .tables import written


def identity_keys(contacts: Column, links: Column, fallback: Column | None = None) -> Column:
    """``kind:value`` of e-mails and phones, then ``github:url`` and ``linkedin:url`` of links of that platform or whose
    address holds its domain, lower-cased, unique, in order; ``fallback`` comes last where it is not null.

    ``contacts``: array<struct<kind, value>>, ``links``: array<struct<platform, url>>.
    """
    none = F.array().cast("array<string>")
    of_contact = F.transform(F.filter(contacts, lambda c: c["kind"].isin("email", "phone")), lambda c: F.when(F.trim(c["value"]) != "", F.concat(c["kind"], F.lit(":"), F.lower(F.trim(c["value"])))))

    def of_link(x: Column) -> Column:
        u = F.lower(F.trim(x["url"]))
        on = lambda name: F.when(((x["platform"] == name) | F.contains(u, F.lit(f"{name}.com"))) & (u != ""), F.concat(F.lit(f"{name}:"), u))
        return F.array(on("github"), on("linkedin"))

    found = F.concat(F.coalesce(of_contact, none), F.coalesce(F.flatten(F.transform(links, of_link)), none), none if fallback is None else F.array(fallback))
    return F.array_distinct(F.filter(found, lambda k: k.isNotNull()))


def fallback_key(name: Column, employer: Column, location: Column) -> Column:
    """``fallback:name|employer|location`` if all three are there."""
    given = [F.lower(F.trim(c)) for c in (name, employer, location)]
    filled = (given[0] != "") & (given[1] != "") & (given[2] != "")
    return F.when(filled, F.concat(F.lit("fallback:"), F.concat_ws("|", *given)))


def resolve(candidates: DataFrame, ix: str = "candidate_ix", keys: str = "keys") -> DataFrame:
    """Adds group_ix: the smallest candidate index connected over shared keys; candidates without keys stay alone.

    Each key links its candidates to the smallest one, so a key that very many share gives a star, not all pairs.
    """
    flat = written(candidates.select(F.col(ix).cast("long").alias("b"), F.explode_outer(keys).alias("key")).filter("key is not null"), "identity-keys")
    first = flat.groupBy("key").agg(F.min("b").alias("a"))
    labels = connected_components(flat.join(first, "key").select("a", "b").distinct())
    return candidates.join(labels.withColumnsRenamed({"node": ix, "component": "group_ix"}), ix, "left").withColumn("group_ix", F.coalesce("group_ix", F.col(ix).cast("long")))


def group_ids(resolved: DataFrame, ix: str = "candidate_ix", keys: str = "keys", name: str | None = None, location: str | None = None, source: str | None = None) -> DataFrame:
    """(group_ix, group_id, keys, members): the id names the group's sorted keys; where it has none, its record's index, name,
    place and source (columns; unknown where not given)."""
    exploded = resolved.select("group_ix", ix, F.explode_outer(keys).alias("key"))
    g = exploded.groupBy("group_ix").agg(F.array_sort(F.collect_set("key")).alias("keys"), F.array_sort(F.collect_set(ix)).alias("members"))
    part = lambda label, c, unknown: F.concat(F.lit(f"{label}:"), F.coalesce(F.col(c), F.lit(unknown)) if c else F.lit(unknown))
    parts = [F.concat(F.lit("candidate-index:"), F.col(ix).cast("string")), part("candidate-name", name, "unknown-name"), part("candidate-location", location, "unknown-location")]
    parts += [F.concat(F.lit("source:"), F.col(source))] if source else []
    alone = resolved.filter(F.coalesce(F.size(keys), F.lit(0)) <= 0).select("group_ix", det_id("candidate-group", *parts).alias("_alone"))
    named = g.join(alone, "group_ix", "left")
    return named.select("group_ix", F.when(F.size("keys") > 0, det_id("candidate-group", F.array_join("keys", "::"))).otherwise(F.col("_alone")).alias("group_id"), "keys", "members")
