"""Numbers for rows in one order over all of them, without a task that sees them all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .tables import written


def numbered(rows: DataFrame, by: list[str], name: str = "candidate_ix", within: str | None = None) -> DataFrame:
    """A written table of ``rows`` with ``name``: 0, 1, 2, … in the order of the columns ``by``.

    Rows are dealt by ranges of ``by`` and sorted within them, each partition counts its own, and the counts of the partitions
    before it (one row a partition) say where its numbers begin. Rows that are equal in ``by`` get numbers of their own. With
    ``within``, the first of ``by``, numbers begin anew at each of its values: those of the partitions before are carried over,
    so one value may fill many partitions.
    """
    sorted_ = rows.repartitionByRange(*[F.col(c) for c in by]).sortWithinPartitions(*by)
    mark = f"_{uuid.uuid4().hex}"
    part, place, group = f"{mark}part", f"{mark}place", f"{mark}group"
    # the upper bits of the id are the partition, the lower 33 the place within it
    placed = sorted_.withColumn(part, F.monotonically_increasing_id()).withColumns({part: F.shiftrightunsigned(part, 33), place: F.col(part).bitwiseAND(F.lit((1 << 33) - 1))})
    placed = written(placed, "sorted-rows")
    if within is None:
        counts = placed.groupBy(part).agg(F.count("*").alias("n"))
        before = counts.select(part, (F.sum("n").over(Window.orderBy(part)) - F.col("n")).alias(f"{mark}n"))
        return written(placed.join(F.broadcast(before), part).withColumn(name, F.col(place) + F.col(f"{mark}n")).select(*rows.columns, name), "numbered-rows")
    # of each value's first place in a partition: what stands before it there, and how many rows of it stand in earlier partitions
    counts = placed.groupBy(F.col(within).alias(group), part).agg(F.count("*").alias("n"), F.min(place).alias("first"))
    earlier = F.sum("n").over(Window.partitionBy(group).orderBy(part)) - F.col("n") - F.col("first")
    before = counts.select(group, F.col(part).alias(f"{mark}p"), earlier.alias(f"{mark}n"))
    same = F.col(within).eqNullSafe(F.col(group)) & (F.col(part) == F.col(f"{mark}p"))
    return written(placed.join(before, same).withColumn(name, F.col(place) + F.col(f"{mark}n")).select(*rows.columns, name), "numbered-rows")
