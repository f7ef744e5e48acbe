"""SimHash near-duplicate classes through an inverted index over positional bytes.

Two fingerprints that differ in at most ``max_bits`` bits differ in at most that many of
their 8 bytes, so at least ``8 - max_bits`` positional bytes agree. Posting lists of single
bytes hold a 256th of the corpus each; joining them would be quadratic. The lists are
therefore kept for *triples* of positional bytes: any four agreeing positions contain at
least one of the 20 triples below, so every link still meets in some list. Within a list the
shared positional bytes of each pair are tallied, pairs below the guaranteed minimum are
dropped, and the rest are verified bit by bit.

Lists longer than ``list_limit`` emit no pairs at once. A linked pair agrees on one more position
outside the triple, so their members are listed again by triple and each further byte: these lists hold 2^-32
of the corpus. What is still longer (dense groups of near copies) is linked exactly through midpoints instead: two fingerprints at distance <= 4 have a common
point at distance <= 2 from both, and all fingerprints within 2 of one point lie within 4 of
each other. So each member names the 2081 points within 2 of itself, and per point every
member is linked to the smallest one. At most 2081 fingerprints can share a point.

Exact copies share a fingerprint and enter the search once.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.components import connected_components
from ..operators.tables import written
from .shared import small_batches

SHINGLE_WORDS = 4
SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str | None, words_per_shingle: int = SHINGLE_WORDS) -> int:
    """The unsigned 64-bit SimHash of a text; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = words_per_shingle
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return digest(joined, SEED)
    starts = np.zeros(len(words), np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    np.cumsum(lengths[:-1] + 1, out=starts[1:])
    ends = (starts + lengths)[k - 1 :].tolist()
    begins = starts[: len(words) - k + 1].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), _CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begins[at : at + _CHUNK], ends[at : at + _CHUNK])], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(ones * 2 > len(begins), bitorder="little")
    return int(set_bits.view(np.uint64)[0])


def _covering_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions such that every four positions contain one of them.

    Positions fall into three groups on a circle; a triple is kept if it lies inside a group or
    has two positions in a group and one in the next. That is Turan's construction, 20 triples for 8.
    """
    group = [0, 0, 0, 1, 1, 1, 2, 2]
    kept = []
    for t in combinations(range(8), 3):
        g = sorted(group[p] for p in t)
        inside = g[0] == g[2]
        onward = len(set(g)) == 2 and (max(set(g), key=g.count) + 1) % 3 == min(set(g), key=g.count)
        if inside or onward:
            kept.append(t)
    return kept


TRIPLES = _covering_triples()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: (id, ``keep``, fp long). A null text has no words."""
    names = [id_col, *keep]
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t) for t in b.column(len(names)).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(fps, pa.int64())], names=[*names, "fp"])

    return docs.select(*names, text_col).mapInArrow(small_batches(batch), f"{kinds}, fp long")


def _byte(col, position: int):
    return F.shiftrightunsigned(col, 8 * position).bitwiseAND(F.lit(255))


def links(fps: DataFrame, max_bits: int = 4, list_limit: int = 64) -> DataFrame:
    """Edges (a, b) whose connected components are those of all pairs of the distinct
    ``fps.fp`` at ``max_bits`` or fewer differing bits. ``fps`` must be cheap to read twice."""
    if max_bits not in (0, 2, 4):
        raise ValueError("max_bits is 0, 2 or 4: midpoints halve it, and the posting lists cover up to 4")
    fp = F.col("fp")
    keys = F.array(
        *[
            F.shiftleft(F.lit(i).cast("long"), 24).bitwiseOR(F.shiftleft(_byte(fp, x), 16)).bitwiseOR(F.shiftleft(_byte(fp, y), 8)).bitwiseOR(_byte(fp, z))
            for i, (x, y, z) in enumerate(TRIPLES)
        ]
    )
    bits = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b)))

    def listed(postings: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """(short lists, long lists); lists of one member are dropped."""
        sizes = postings.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        lists = written(postings.join(sizes, "key"), name)
        return lists.filter(F.col("n") <= list_limit), lists.filter(F.col("n") > list_limit)

    def met(short: DataFrame) -> DataFrame:
        """Linked pairs that meet in a list: the tally of shared positional bytes decides first, then the bits."""
        a, b = short.select("key", F.col("fp").alias("a")), short.select("key", F.col("fp").alias("b"))
        shared = sum(((_byte(F.col("a"), p) == _byte(F.col("b"), p)).cast("int") for p in range(1, 8)), (_byte(F.col("a"), 0) == _byte(F.col("b"), 0)).cast("int"))
        return a.join(b, "key").filter(F.col("a") < F.col("b")).filter(shared >= 8 - max_bits).filter(bits("a", "b") <= max_bits).select("a", "b")

    short, long_ = listed(fps.select("fp", F.explode(keys).alias("key")), "postings")
    others = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in t]) for t in TRIPLES])
    position = F.explode(F.get(others, F.shiftright("key", 24).cast("int")))
    further = long_.select("fp", "key", position.alias("p"))
    byte = F.expr("shiftrightunsigned(fp, 8 * p)").bitwiseAND(F.lit(255))
    finer, dense = listed(further.select("fp", F.shiftleft("key", 11).bitwiseOR(F.shiftleft(F.col("p").cast("long"), 8)).bitwiseOR(byte).alias("key")), "finer-postings")
    near = met(short).unionByName(met(finer))
    dense = dense.select("fp").distinct()
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    half = max_bits // 2
    flips = [0] + [1 << i for i in range(64) if half >= 1] + [(1 << i) | (1 << j) for i, j in combinations(range(64), 2) if half >= 2]
    flips = [f - (1 << 64) if f >= 1 << 63 else f for f in flips]
    points = dense.repartition(partitions).select("fp", F.explode(F.lit(flips).cast("array<long>")).alias("flip")).select("fp", fp.bitwiseXOR(F.col("flip")).alias("point"))
    stars = points.select(F.min("fp").over(Window.partitionBy("point")).alias("a"), F.col("fp").alias("b")).filter("a < b").distinct()
    return near.unionByName(stars).distinct()


def classes(docs: DataFrame, max_bits: int = 4, list_limit: int = 64, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, ``keep``, fp, component (the class's key, a fingerprint), component_id."""
    rows = written(fingerprints(docs, keep=keep), "fingerprints")
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    labels = connected_components(links(distinct.select("fp"), max_bits, list_limit))
    of_fp = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    smallest = of_fp.groupBy("component").agg(F.min("first_id").alias("component_id"))
    return rows.join(of_fp.join(smallest, "component").select("fp", "component", "component_id"), "fp").select("doc_id", *keep, "fp", "component", "component_id")


def near_duplicate_classes(docs: DataFrame, max_bits: int = 4, list_limit: int = 64) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over links of ``max_bits`` or fewer differing
    bits, the row's own included. Null and empty texts have fingerprint 0 and link like any
    other. Repeated rows stay repeated. A null doc_id takes part in linking and gets the
    smallest id that is not null, or null if its class has none. Other columns are ignored.
    """
    rows = classes(docs, max_bits, list_limit)
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
