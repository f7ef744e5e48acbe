"""Lists of dated entries (jobs, schools) of a group, duplicates united in buckets that carry what stands for them.

An entry joins the first bucket of its key whose representative it meets. The representative gives way to a preferred entry
(:func:`weftline.operators.generic.takes_over`), the span grows, lists inside the entries are joined. The order of a group's entries is
that of its records, then their place. The fold only says which bucket an entry joins and whether it takes over: it runs over the entries sorted
by key and order, and its state is a key's representatives, so no key is one row and each entry costs as much as the key has buckets. Everything else is
aggregated from the entries by bucket.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructType

from ..config import OPEN_END
from . import generic
from .tables import written

#: Entries handed to the fold at a time.
CHUNK = 4096


class Meeting(NamedTuple):
    """When an entry meets a representative: the texts of an entry that decide, and the rule on those of the representative and the entry."""

    parts: Callable[[Column], list[Column]]
    rule: Callable[[list[str | None], list[str | None]], bool]


def _ranges_meet(r: list[str | None], x: list[str | None]) -> bool:
    return r[0] is None or x[0] is None or r[0] == x[0] or (r[0] <= x[1] and x[0] <= r[1])


def _years_meet(r: list[str | None], x: list[str | None]) -> bool:
    return r[0] is None or x[0] is None or r[0] == x[0]


def dated(start: str = "start", end: str = "end", current: str = "is_current") -> Meeting:
    """Entries that begin alike, that lack a beginning, or whose closed ranges overlap; without an end a range is open."""
    return Meeting(lambda x: [x[start], F.when(F.coalesce(x[current], F.lit(False)) | x[end].isNull(), F.lit(OPEN_END)).otherwise(x[end])], _ranges_meet)


def same_year(end: str = "end") -> Meeting:
    """Entries whose years of ending do not differ."""
    return Meeting(lambda x: [F.substring(x[end], 1, 4)], _years_meet)


class _Entry(NamedTuple):
    """What the fold knows of an entry."""

    rank: int | None
    weight: int
    full: bool
    said: str
    leaves: list[str | None]
    parts: list[str | None]


def _more_complete(loser: _Entry, winner: _Entry) -> bool:
    """:func:`weftline.operators.generic.more_complete` of records."""
    if not winner.full:
        return loser.full
    same = all(w is None or x == w for x, w in zip(loser.leaves, winner.leaves))
    return same and sum(x is not None for x in loser.leaves) > sum(w is not None for w in winner.leaves)


def _takes_over(r: _Entry, x: _Entry) -> bool:
    """:func:`weftline.operators.generic.takes_over` of records."""
    if r.rank is not None and r.rank == x.rank:
        return x.weight > r.weight
    if r.rank is not None and x.rank is not None and r.rank < x.rank:
        return _more_complete(x, r)
    return not _more_complete(r, x)


def _fold(rule: Callable[[list, list], bool], chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds to entries sorted by ``at`` and ``ord`` the number of the bucket they join, whether they stand for it from then on, and the text of the entry that stood for it before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps = None, []
        for whole in batches:
            for begin in range(0, whole.num_rows, chunk):
                batch = whole.slice(begin, chunk)
                told = batch.column("told")
                columns = [told.field(n).to_pylist() for n in _Entry._fields]
                numbers, took, lost = [], [], []
                for at, *own in zip(batch.column("at").to_pylist(), *columns):
                    if at != key:
                        key, reps = at, []
                    x = _Entry(*own)
                    n = next((i for i, r in enumerate(reps) if rule(r.parts, x.parts)), len(reps))
                    gone = None
                    if n == len(reps):
                        reps.append(x)
                        took.append(True)
                    elif _takes_over(reps[n], x):
                        gone, reps[n] = reps[n].said, x
                        took.append(True)
                    else:
                        took.append(False)
                    numbers.append(n)
                    lost.append(gone)
                kept = [(n, batch.column(n)) for n in batch.schema.names if n != "told"]
                added = [("bucket", pa.array(numbers, pa.int32())), ("took", pa.array(took, pa.bool_())), ("lost", pa.array(lost, pa.string()))]
                yield pa.RecordBatch.from_arrays([c for _, c in kept + added], names=[n for n, _ in kept + added])

    return run


def united(rows: DataFrame, group: str, entries: str, key: Callable[[Column], Column], meets: Meeting, start: str | None = "start", end: str = "end", current: str | None = "is_current", lists: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """(group, entries): a written list per group with the representatives' fields, spans put in, and ``source``, ``sources``, ``discarded``, ``size``.

    ``rows``: group, rank, candidate_ix (no two records of a group share both), source_id and a list of structures. ``lists`` are lists of text inside the
    entries; they are joined without case, first spelling first. Entries without a key, null ones, are a key of their own. A span has no end if an
    entry is current; where nothing ends it has none. Groups without entries give no row. ``chunk`` entries are handed to the fold at a time; the result does not depend on it.
    """
    kind = rows.schema[entries].dataType.elementType
    flat = rows.select(group, F.col("rank").cast("int").alias("rank"), F.col("candidate_ix").cast("long").alias("ix"), "source_id", F.posexplode(entries).alias("pos", "x"))
    x = F.col("x")
    told = {"rank": F.col("rank"), "weight": generic.completeness(x, kind).cast("long"), "full": generic.meaningful(x, kind), "said": generic.serialized(x, kind), "leaves": F.array(*generic.leaves(x, kind)), "parts": F.array(*meets.parts(x))}
    flat = flat.select(
        F.struct(F.col(group).alias("group"), key(x).alias("key")).alias("at"), F.struct("rank", "ix", "pos").alias("ord"), F.col("source_id").cast("string").alias("source"), "x", F.struct(*[told[n].alias(n) for n in _Entry._fields]).alias("told"),
    )
    in_order = flat.repartition("at").sortWithinPartitions("at", "ord")
    kept = StructType([f for f in flat.schema.fields if f.name != "told"])
    folded = written(in_order.mapInArrow(_fold(meets.rule, chunk or CHUNK), StructType([*kept.fields]).add("bucket", IntegerType()).add("took", BooleanType()).add("lost", StringType())), "folded-entries")

    now = F.coalesce(x[current], F.lit(False)) if current else F.lit(False)
    of = ["at", "bucket"]
    buckets = folded.groupBy(*of).agg(
        F.min("ord").alias("ord"), F.max_by(F.struct("x", "source"), F.when(F.col("took"), F.col("ord"))).alias("rep"), F.min(x[start] if start else F.lit(None).cast("string")).alias("lo"), F.max(x[end]).alias("hi"), F.bool_or(now).alias("cur"), F.count("*").alias("size"),
    )
    # sources, texts put aside and the entries' own lists, each value once by first sight
    fact = lambda name, v, k, n: F.struct(F.lit(name).alias("name"), v.alias("v"), k.alias("k"), n.alias("n"))
    facts = [F.array(fact("sources", F.col("source"), F.col("source"), F.lit(0))), F.when(F.col("lost").isNotNull(), F.array(fact("discarded", F.col("lost"), F.col("lost"), F.lit(0)))).otherwise(F.array())]
    facts += [F.transform(F.coalesce(x[name], F.array().cast(kind[name].dataType)), lambda v, i: fact(name, v, F.lower(v), i)) for name in lists]  # noqa: B023
    once = folded.select(*of, "ord", F.explode(F.concat(*facts)).alias("f")).groupBy(*of, "f.name", "f.k").agg(F.min(F.struct("ord", "f.n", "f.v")).alias("first"))
    held = once.groupBy(*of).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == name, F.struct("first.ord", "first.n", "first.v")))), lambda e: e["v"]).alias(f"_{name}") for name in ("sources", "discarded", *lists)])
    out = buckets.join(held, of)
    entry = F.col("rep.x")
    for name in lists:
        entry = entry.withField(name, F.col(f"_{name}"))
    if start:
        entry = entry.withField(start, F.col("lo"))
    entry = entry.withField(end, F.when(~F.col("cur"), F.col("hi")))
    if current:
        entry = entry.withField(current, F.col("cur"))
    more = {"source": F.col("rep.source"), "sources": F.col("_sources"), "discarded": F.col("_discarded"), "size": F.col("size")}
    for name, c in more.items():
        entry = entry.withField(name, c)
    g = out.groupBy(F.col("at.group").alias(group)).agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("x"))), lambda p, q: F.when(p["ord"] < q["ord"], -1).when(p["ord"] > q["ord"], 1).otherwise(0)).alias("all"))
    return written(g.select(group, F.transform("all", lambda e: e["x"]).alias(entries)), f"united-{entries}")
