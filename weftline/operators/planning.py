"""What a merge has before it: per group and field, who has a value, who lacks one, and whether they differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from ..config import MERGE_STRATEGIES

#: Bookkeeping parts of a value that say nothing about the person.
TECHNICAL = ("id", "provenance", "confidence")


def meaningful(c: Column, kind: DataType) -> Column:
    """A non-blank text, a non-empty list or map, a structure with a meaningful part, any other value but null."""
    if isinstance(kind, StringType):
        return F.coalesce(F.trim(c) != "", F.lit(False))
    if isinstance(kind, (ArrayType, MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(kind, StructType):
        has = F.lit(False)
        for f in kind.fields:
            if f.name not in TECHNICAL:
                has = has | meaningful(c[f.name], f.dataType)
        return has
    return c.isNotNull()


def stable(c: Column, kind: DataType) -> Column:
    """A text that is equal for equal values: JSON without the bookkeeping parts, in the schema's order."""
    if isinstance(kind, (StringType, MapType)):
        return c if isinstance(kind, StringType) else F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c))))
    return F.to_json(_bare(c, kind)) if isinstance(kind, (ArrayType, StructType)) else c.cast("string")


def _bare(c: Column, kind: DataType) -> Column:
    if isinstance(kind, StructType):
        return F.struct(*[_bare(c[f.name], f.dataType).alias(f.name) for f in kind.fields if f.name not in TECHNICAL])
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(c, lambda x: _bare(x, kind.elementType))
    return c


def merge_plan(rows: DataFrame, fields: dict[str, str], group: str = "group_ix", rank: str = "rank", ix: str = "candidate_ix") -> DataFrame:
    """(group, field, strategy, candidates, missing, has_conflict): one row per group and field, from one shuffle.

    ``fields`` maps field names to columns. ``candidates`` are the indexes with a meaningful value by (rank, index), ``missing``
    the others by index. A conflict is two different values, which the smallest and the largest tell.
    """
    plans = []
    for field, column in fields.items():
        kind = rows.schema[column].dataType
        has = meaningful(F.col(column), kind)
        said = F.when(has, stable(F.col(column), kind))
        by_rank = F.array_sort(F.collect_list(F.when(has, F.struct(F.col(rank).alias("rank"), F.col(ix).alias("ix")))))
        plans.append(
            F.struct(
                F.lit(field).alias("field"),
                F.lit(MERGE_STRATEGIES[field]).alias("strategy"),
                F.transform(by_rank, lambda x: x["ix"]).alias("candidates"),
                F.array_sort(F.collect_list(F.when(~has, F.col(ix)))).alias("missing"),
                F.coalesce(F.min(said) != F.max(said), F.lit(False)).alias("has_conflict"),
            )
        )
    return rows.groupBy(group).agg(F.array(*plans).alias("plans")).select(group, F.inline("plans"))


def conflict_counts(plan: DataFrame, group: str = "group_ix") -> DataFrame:
    """(group, conflicts)."""
    return plan.groupBy(group).agg(F.count_if("has_conflict").alias("conflicts"))
