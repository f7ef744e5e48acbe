"""Conflict resolution within a group: ordered folds and ordered unions.

A group is one person's records; its lists stay small. Folds are order-dependent, so every
list is sorted by (rank, index) first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..config import OPEN_END, SOURCE_MATCHERS, SOURCE_PRIORITY


def source_label(haystack: Column, source_type: Column) -> Column:
    """The first label whose pattern the lower-cased description holds; else the type."""
    h, out = F.lower(haystack), None
    for label, needles in SOURCE_MATCHERS.items():
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(h, F.lit(n))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(source_type)


def priority_rank(label: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(x) for x in SOURCE_PRIORITY]), label)
    return F.when(at > 0, at - 1).otherwise(len(SOURCE_PRIORITY)).cast("int")


def text_completeness(c: Column) -> Column:
    """Characters and five per word of the trimmed text; 0 for null and blank."""
    t = F.trim(c)
    return F.when(t != "", F.length(t) + 5 * F.size(F.split(t, r"\s+"))).otherwise(0)


def more_complete(loser: Column, winner: Column) -> Column:
    """Substantially: longer and containing the other, without case."""
    return (F.length(loser) > F.length(winner)) & F.contains(F.lower(loser), F.lower(winner))


def preferred(entries: Column) -> Column:
    """The winner of sorted array<struct<rank, ix, value>>: better rank wins unless the other value is
    substantially more complete; equal ranks go by completeness, ties to the earlier."""

    def better(a: Column, x: Column) -> Column:
        by_rank = F.when(a["rank"] < x["rank"], F.when(more_complete(x["value"], a["value"]), x).otherwise(a)).otherwise(F.when(more_complete(a["value"], x["value"]), a).otherwise(x))
        equal = F.when(text_completeness(x["value"]) > text_completeness(a["value"]), x).otherwise(a)
        return F.when(a["rank"] == x["rank"], equal).otherwise(by_rank)

    first = F.get(entries, F.lit(0))
    return F.aggregate(F.filter(entries, lambda x, i: i > 0), first, lambda a, x: better(a, x))


def merge_scalar(rows: DataFrame, group: str | list[str], value: str, rank: str = "rank", ix: str = "candidate_ix") -> DataFrame:
    """(group, value, winner_ix, discarded, has_conflict) over the group's non-blank values."""
    filled = rows.filter(F.trim(F.col(value)) != "")
    entry = F.struct(F.col(rank).alias("rank"), F.col(ix).alias("ix"), F.col(value).alias("value"))
    groups = [group] if isinstance(group, str) else group
    g = filled.groupBy(*groups).agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    g = g.withColumn("winner", preferred(F.col("entries")))
    losers = F.array_distinct(F.transform(F.filter("entries", lambda x: x["value"] != F.col("winner.value")), lambda x: x["value"]))
    return g.select(*groups, F.col("winner.value").alias(value), F.col("winner.ix").alias("winner_ix"), losers.alias("discarded"), (F.size(losers) > 0).alias("has_conflict"))


def merge_additional(rows: DataFrame, group: str, data: str, rank: str = "rank", ix: str = "candidate_ix") -> DataFrame:
    """(group, data): open key-value data of a group, each key with its preferred value; groups without any key give no row."""
    flat = rows.select(group, rank, ix, F.explode(data).alias("key", "value"))
    won = merge_scalar(flat, [group, "key"], "value", rank, ix)
    return won.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias(data))


def merge_union(rows: DataFrame, group: str, key: Column, order: list[Column], value: Column, flags: list[str] = ()) -> DataFrame:
    """(group, key, value, flags): one row per distinct key, its first value in order, flags or-ed; ``ord`` is the order of first sight."""
    o = F.struct(*order)
    r = rows.select(F.col(group), key.alias("key"), o.alias("ord"), value.alias("value"), *flags)
    return r.groupBy(group, "key").agg(F.min("ord").alias("ord"), F.min_by("value", "ord").alias("value"), *[F.bool_or(f).alias(f) for f in flags])


def merge_intervals(rows: DataFrame, group: list[str], rank: str = "rank", ix: str = "candidate_ix", start: str = "start", end: str = "end", current: str = "is_current", weight: str = "weight", meets: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Experiences of one employer and title, folded into buckets: group columns, start, end, is_current, size.

    Items come by (rank, ix). An item joins the first bucket whose representative has the same
    start, or where a start is missing, or whose closed range overlaps its own (no end: open). The representative
    gives way to an item of equal rank and greater ``weight``. A bucket spans its smallest start and largest
    end; it has no end if any item is current. ``meets`` (representative, item) replaces the rule by which an item joins.
    """
    item = F.struct(F.col(rank).alias("rank"), F.col(ix).alias("ix"), F.col(start).alias("start"), F.col(end).alias("end"), F.coalesce(F.col(current), F.lit(False)).alias("current"), F.col(weight).alias("weight"))
    g = rows.groupBy(*group).agg(F.array_sort(F.collect_list(item)).alias("items"))
    until = lambda x: F.when(x["current"] | x["end"].isNull(), F.lit(OPEN_END)).otherwise(x["end"])

    def overlaps(r: Column, x: Column) -> Column:
        overlap = (r["start"] <= until(x)) & (x["start"] <= until(r))
        return r["start"].isNull() | x["start"].isNull() | (r["start"] == x["start"]) | overlap

    joins = meets or overlaps

    def bucket(rep: Column, lo: Column, hi: Column, cur: Column, n: Column) -> Column:
        return F.struct(rep.alias("rep"), lo.alias("lo"), hi.alias("hi"), cur.alias("cur"), n.alias("n"))

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda b: F.coalesce(joins(b["rep"], x), F.lit(False))), True) - 1
        grown = lambda b: bucket(
            F.when((x["rank"] == b["rep"]["rank"]) & (x["weight"] > b["rep"]["weight"]), x).otherwise(b["rep"]), F.least(b["lo"], x["start"]), F.greatest(b["hi"], x["end"]), b["cur"] | x["current"], b["n"] + 1
        )
        return F.when(at >= 0, F.transform(acc, lambda b, i: F.when(i == at, grown(b)).otherwise(b))).otherwise(F.concat(acc, F.array(bucket(x, x["start"], x["end"], x["current"], F.lit(1)))))

    kind = "array<struct<rep:struct<rank:int,ix:bigint,start:string,end:string,current:boolean,weight:bigint>,lo:string,hi:string,cur:boolean,n:int>>"
    typed = g.withColumn("items", F.col("items").cast("array<struct<rank:int,ix:bigint,start:string,end:string,current:boolean,weight:bigint>>"))
    b = typed.select(*group, F.explode(F.aggregate("items", F.array().cast(kind), step)).alias("b"))
    return b.select(*group, F.col("b.lo").alias("start"), F.when(~F.col("b.cur"), F.col("b.hi")).alias("end"), F.col("b.cur").alias("is_current"), F.col("b.n").alias("size"))


def merge_education(rows: DataFrame, group: str, institution: str = "institution", degree: str = "degree", **names: str) -> DataFrame:
    """Schools of a group: (group, institution_key, degree_key, start, end, size), spanning their smallest start and largest end.

    Entries of one institution and degree (without case; a missing degree is one of its own) are the same unless both
    have a graduation year and these differ.
    """

    def same_year(r: Column, x: Column) -> Column:
        a, b = F.substring(r["end"], 1, 4), F.substring(x["end"], 1, 4)
        return a.isNull() | b.isNull() | (a == b)

    keyed = rows.withColumns({"institution_key": F.lower(institution), "degree_key": F.coalesce(F.lower(degree), F.lit("")), "_current": F.lit(False)})
    return merge_intervals(keyed, [group, "institution_key", "degree_key"], current="_current", meets=same_year, **names).drop("is_current")
