"""Rules over values of any type, generated from their schema: completeness, meaning, comparison, serialization.

Ids, provenance and confidence are technical and say nothing about a value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from . import merge
from .tables import dropped, written

TECHNICAL = frozenset({"id", "provenance", "confidence"})


def _inner(kind: StructType):
    return [f for f in kind.fields if f.name not in TECHNICAL]


def completeness(c: Column, kind: DataType) -> Column:
    """Text: characters and five per word; numbers and booleans 1; lists ten per entry and what they hold; records the sum of their fields."""
    if isinstance(kind, StringType):
        return merge.text_completeness(c)
    if isinstance(kind, ArrayType):
        held = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + completeness(x, kind.elementType))
        return F.when(c.isNotNull(), 10 * F.size(c) + held).otherwise(0)
    if isinstance(kind, StructType):
        total = reduce(lambda a, f: a + completeness(c[f.name], f.dataType), _inner(kind), F.lit(0))
        return F.when(c.isNotNull(), total).otherwise(0)
    return F.when(c.isNotNull(), 1).otherwise(0)


def meaningful(c: Column, kind: DataType) -> Column:
    """Text that is not blank, a list that is not empty, a record with a meaningful field, any other value."""
    if isinstance(kind, StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if isinstance(kind, ArrayType):
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if isinstance(kind, StructType):
        return c.isNotNull() & reduce(lambda a, f: a | meaningful(c[f.name], f.dataType), _inner(kind), F.lit(False))
    return c.isNotNull()


def serialized(c: Column, kind: DataType) -> Column:
    """JSON with sorted keys, without technical and missing fields: equal values give equal text."""

    def bare(x: Column, k: DataType) -> Column:
        if isinstance(k, StructType):
            named = [bare(x[f.name], f.dataType).alias(f.name) for f in sorted(_inner(k), key=lambda f: f.name)]
            return F.when(x.isNotNull(), F.struct(*named))
        if isinstance(k, ArrayType):
            return F.transform(x, lambda y: bare(y, k.elementType))
        return x

    return F.to_json(F.struct(bare(c, kind).alias("value")))


def _leaves(c: Column, kind: DataType, path: str = "") -> list[tuple[str, Column]]:
    if isinstance(kind, StructType):
        return [x for f in _inner(kind) for x in _leaves(c[f.name], f.dataType, f"{path}.{f.name}")]
    return [(path, serialized(c, kind) if isinstance(kind, ArrayType) else c.cast("string"))]


def leaves(c: Column, kind: DataType) -> list[Column]:
    """The texts of a value's leaves; lists are leaves, as JSON."""
    return [x for _, x in _leaves(c, kind)]


def more_complete(loser: Column, winner: Column, kind: DataType) -> Column:
    """Whether ``loser`` is substantially more complete: text that is longer and contains the other; a record that repeats
    every field of the other and has more; else by completeness. What says nothing yields to what says something."""
    if isinstance(kind, StringType):
        more = merge.more_complete(F.trim(loser), F.trim(winner))
    elif isinstance(kind, StructType):
        pairs = list(zip(_leaves(loser, kind), _leaves(winner, kind)))
        same = reduce(lambda a, p: a & (p[1][1].isNull() | p[0][1].eqNullSafe(p[1][1])), pairs, F.lit(True))
        count = lambda i: reduce(lambda a, p: a + p[i][1].isNotNull().cast("int"), pairs, F.lit(0))
        more = same & (count(0) > count(1))
    else:
        more = completeness(loser, kind) > completeness(winner, kind)
    return F.when(meaningful(winner, kind), F.coalesce(more, F.lit(False))).otherwise(meaningful(loser, kind))


def takes_over(winner: Column, rank: Column, complete: Column, x: Column, x_rank: Column, x_complete: Column, kind: DataType) -> Column:
    """Whether the value ``x`` that comes after ``winner`` replaces it: at the same rank if it is more complete; of a worse rank if
    substantially so; of a better one unless the winner is."""
    worse = more_complete(x, winner, kind)
    return F.when(rank == x_rank, x_complete > complete).when(rank < x_rank, worse).otherwise(~more_complete(winner, x, kind))


def preferred(entries: Column, kind: DataType) -> Column:
    """The winner of sorted array<struct<rank, ix, value>>: the better rank unless the other value is substantially more
    complete; equal ranks by completeness, ties to the earlier."""

    def better(a: Column, x: Column) -> Column:
        return F.when(takes_over(a["value"], a["rank"], completeness(a["value"], kind), x["value"], x["rank"], completeness(x["value"], kind), kind), x).otherwise(a)

    return F.aggregate(F.filter(entries, lambda x, i: i > 0), F.get(entries, F.lit(0)), better)


def merge_value(rows: DataFrame, group: str, value: str, rank: str = "rank", ix: str = "candidate_ix") -> DataFrame:
    """(group, value, winner_ix, candidate_ixs, discarded): the group's preferred value of a column of any type.

    ``candidate_ixs`` are all that had one, ``discarded`` the other distinct values as JSON.
    """
    kind = rows.schema[value].dataType
    entry = F.struct(F.col(rank).cast("int").alias("rank"), F.col(ix).alias("ix"), F.col(value).alias("value"))
    g = rows.filter(meaningful(F.col(value), kind)).groupBy(group).agg(F.collect_list(entry).alias("_entries"))
    by_place = lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).when(a["ix"] < b["ix"], -1).when(a["ix"] > b["ix"], 1).otherwise(0)
    g = g.withColumn("_entries", F.array_sort("_entries", by_place))
    g = g.withColumn("_won", preferred(F.col("_entries"), kind))
    said = F.transform("_entries", lambda e: serialized(e["value"], kind))
    losers = F.array_except(said, F.array(serialized(F.col("_won.value"), kind)))
    return g.select(group, F.col("_won.value").alias(value), F.col("_won.ix").alias("winner_ix"), F.transform("_entries", lambda e: e["ix"]).alias("candidate_ixs"), losers.alias("discarded"))


#: Records of one group whose values are gathered in one row at most.
GATHERED = 4096


def merge_values(rows: DataFrame, group: str, columns: list[str], gathered: int | None = None) -> DataFrame:
    """(group, one structure per column): value, ix and source of its winner, ``candidates`` (the sources that had a value, by first sight) and ``discarded``
    (the other distinct values as JSON); null where nobody has a value.

    ``rows``: group, rank, candidate_ix, source_id and the columns. All columns are folded from one gathering of a group's records. Groups of more than
    ``gathered`` records are not gathered: their winners are found rank by rank (:func:`preferred_by_rank`). What they list is bounded by their sources and distinct values.
    """
    gathered = gathered or GATHERED
    many = written(rows.groupBy(group).count().filter(F.col("count") > gathered).select(group), "groups-of-many")
    if many.isEmpty():
        return _gathered(rows, group, columns)
    large = written(rows.join(many, group, "left_semi").select(group, "rank", "candidate_ix", "source_id", *columns), "records-of-many")
    found = many
    for c in columns:
        kind = rows.schema[c].dataType
        has = large.filter(meaningful(F.col(c), kind))
        won = preferred_by_rank(large, group, c)
        first = has.groupBy(group, "source_id").agg(F.min(F.struct("rank", "candidate_ix")).alias("ord")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", "source_id"))).alias("by"))
        said = has.groupBy(group, serialized(F.col(c), kind).alias("said")).agg(F.min(F.struct("rank", "candidate_ix")).alias("ord")).groupBy(group).agg(F.array_sort(F.collect_list(F.struct("ord", "said"))).alias("said"))
        whole = won.join(first, group).join(said, group)
        losers = F.array_except(F.transform("said", lambda s: s["said"]), F.array(serialized(F.col("value"), kind)))
        whole = whole.select(group, F.struct("value", F.col("candidate_ix").alias("ix"), F.col("source_id").alias("source"), F.transform("by", lambda s: s["source_id"]).alias("candidates"), losers.alias("discarded")).alias(c))
        found = found.join(whole, group, "left")
    return _gathered(rows.join(many, group, "left_anti"), group, columns).unionByName(found)


def _gathered(rows: DataFrame, group: str, columns: list[str]) -> DataFrame:
    by_place = lambda a, b: F.when(a["rank"] < b["rank"], -1).when(a["rank"] > b["rank"], 1).when(a["ix"] < b["ix"], -1).when(a["ix"] > b["ix"], 1).otherwise(0)
    record = F.struct(F.col("rank").cast("int").alias("rank"), F.col("candidate_ix").alias("ix"), F.col("source_id").alias("source"), *columns)
    g = rows.groupBy(group).agg(F.array_sort(F.collect_list(record), by_place).alias("_all"))
    for i, c in enumerate(columns):
        kind = rows.schema[c].dataType
        given = F.transform(F.filter("_all", lambda r: meaningful(r[c], kind)), lambda r: F.struct(r["rank"].alias("rank"), r["ix"].alias("ix"), r["source"].alias("source"), r[c].alias("value")))  # noqa: B023
        g = g.withColumn(f"_given{i}", given).withColumn(f"_won{i}", preferred(F.col(f"_given{i}"), kind))
    out = []
    for i, c in enumerate(columns):
        kind, won, entries = rows.schema[c].dataType, F.col(f"_won{i}"), F.col(f"_given{i}")
        losers = F.array_except(F.transform(entries, lambda e: serialized(e["value"], kind)), F.array(serialized(won["value"], kind)))  # noqa: B023
        sources = F.array_distinct(F.transform(entries, lambda e: e["source"]))
        out.append(F.when(won.isNotNull(), F.struct(won["value"].alias("value"), won["ix"].alias("ix"), won["source"].alias("source"), sources.alias("candidates"), losers.alias("discarded"))).alias(c))
    return g.select(group, *out)


def preferred_by_rank(rows: DataFrame, group: str, column: str) -> DataFrame:
    """(group, rank, candidate_ix, source_id, value): what :func:`preferred` finds, for groups of any size, by grouped aggregates alone.

    Ranks are few and met in turn. Within one, the first record substantially more complete than the winner so far takes over, and from it on the most complete
    one wins, the earliest of equals: two aggregates, no list. Groups without a value give no row.
    """
    kind = rows.schema[column].dataType
    value = rows.filter(meaningful(F.col(column), kind)).select(group, "rank", "candidate_ix", "source_id", F.col(column).alias("value"), completeness(F.col(column), kind).cast("long").alias("_weight"))
    state = None
    for r in [x["rank"] for x in value.select("rank").distinct().orderBy("rank").collect()]:
        part = value.filter(F.col("rank") == r)
        if state is not None:
            before = state.select(group, F.col("value").alias("_value"), F.lit(True).alias("_had"))
            part = part.join(before, group, "left").withColumn("_takes", F.col("_had").isNull() | more_complete(F.col("value"), F.col("_value"), kind)).drop("_value", "_had")
            first = part.filter("_takes").groupBy(group).agg(F.min("candidate_ix").alias("_first"))
            part = part.join(first, group).filter("candidate_ix >= _first")
        best = F.max_by(F.struct("rank", "candidate_ix", "source_id", "value"), F.struct("_weight", -F.col("candidate_ix"))).alias("best")
        won = part.groupBy(group).agg(best).select(group, "best.*")
        if state is not None:
            won = won.unionByName(state.join(won.select(group), group, "left_anti"))
        before, state = state, written(won, "winners")
        dropped(before)
    return rows.select(group, "rank", "candidate_ix", "source_id", F.col(column).alias("value")).limit(0) if state is None else state


def agreement(selected: Column, values: Column, kind: DataType) -> Column:
    """The share of the given values that equal the selected one: text trimmed and without case, the rest as JSON; 1 for one value or none."""
    key = (lambda v: F.lower(F.trim(v))) if isinstance(kind, StringType) else (lambda v: serialized(v, kind))
    given = F.filter(values, lambda v: v.isNotNull())
    return F.when(F.size(given) <= 1, 1.0).otherwise(F.size(F.filter(given, lambda v: key(v) == key(selected))) / F.size(given))
