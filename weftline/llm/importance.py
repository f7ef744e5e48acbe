"""Quality selection by importance resampling over hashed n-grams.

Unigrams and bigrams of words are hashed into ``BUCKETS`` counts. The raw model counts every
document, the target model the documents labelled good; a document's log importance is the
sum of the target-to-raw log ratios of its n-grams. Adding Gumbel noise and keeping the top k
draws k documents without replacement, in proportion to their importance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.tables import written
from .shared import small_batches

BUCKETS = 10_000
#: Labelled documents the target model is fitted on at most: those with the smallest hashed ids.
TARGET_ROWS = 20_000
SMOOTHING = 1.0
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_POWERS = None


def features(text: str | None) -> np.ndarray:
    """Bucket numbers of the words and word pairs of a text, lower-cased (A-Z), repeats included."""
    global _POWERS
    data = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    if not len(data):
        return np.zeros(0, np.int64)
    white = _WHITE[data]
    begins = np.flatnonzero(~white & np.concatenate(([True], white[:-1])))
    if not len(begins):
        return np.zeros(0, np.int64)
    if _POWERS is None or len(_POWERS) < len(data):
        _POWERS = np.cumprod(np.concatenate(([1], np.full(max(len(data), 1 << 16), 0x100000001B3, np.uint64))).astype(np.uint64), dtype=np.uint64)
    lengths = np.diff(np.append(begins, len(data)))
    place = np.arange(len(data) - begins[0]) - np.repeat(begins - begins[0], lengths)
    value = (data[begins[0] :].astype(np.uint64) + np.uint64(1)) * _POWERS[place]
    value[white[begins[0] :]] = 0
    words = np.add.reduceat(value, begins - begins[0])
    words ^= words >> np.uint64(29)
    pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    both = np.concatenate((words * np.uint64(0xBF58476D1CE4E5B9), pairs))
    return ((both >> np.uint64(33)) % np.uint64(BUCKETS)).astype(np.int64)


def counts(docs: DataFrame, target_ids: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts of all documents and of the target's; a partition sends ``BUCKETS`` rows at most."""
    ids = docs.sparkSession.sparkContext.broadcast(target_ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                f = features(text)
                np.add.at(raw, f, 1)
                if i in ids.value:
                    np.add.at(target, f, 1)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    sums = docs.select("doc_id", "text").mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    return raw, target


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, n_grams, log_weight (0 for a text without words)."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = {r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TARGET_ROWS).collect()}
    raw, target = counts(docs, ids)
    ratio = np.log((target + SMOOTHING) / (target + SMOOTHING).sum()) - np.log((raw + SMOOTHING) / (raw + SMOOTHING).sum())
    if not ids:
        ratio = np.zeros(BUCKETS)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        f = [features(t) for t in b.column(1).to_pylist()]
        weight = [math.fsum(shared.value[x].tolist()) if len(x) else 0.0 for x in f]
        return pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([len(x) for x in f], pa.int64()), pa.array(weight, pa.float64())], names=["doc_id", "digest", "n_grams", "log_weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).mapInArrow(small_batches(batch), f"doc_id {kind}, digest long, n_grams long, log_weight double")


def gumbel_top_k(rows: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """Adds gumbel_key and selected: exactly min(k, rows) rows with the largest
    log_weight + Gumbel noise, ties to the smaller doc_id. Noise comes from doc_id, digest and seed, so a rerun draws alike.

    The k-th largest key is found by counting, not by sorting: each round splits the interval
    that holds it into 1024 and counts rows per part, until the part that holds it is one value or
    has few rows. Only counts reach the driver.
    """
    u = (F.shiftrightunsigned(F.xxhash64("doc_id", "digest", F.lit(seed)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    keyed = written(rows.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u))), "gumbel-keys")
    span = keyed.agg(F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi"), F.count("*").alias("n")).first()
    if k >= span["n"]:
        return keyed.withColumn("selected", F.lit(True))
    lo, hi, above = span["lo"], math.nextafter(span["hi"], math.inf), 0  # the k-th largest lies in [lo, hi); `above` rows are at hi or more
    key = F.col("gumbel_key")
    while True:
        inside = keyed.filter((key >= lo) & (key < hi))
        step = (hi - lo) / 1024
        part = F.least(F.lit(1023), F.greatest(F.lit(0), F.floor((key - lo) / step))).cast("int") if step > 0 else F.lit(0)
        tally = {r["part"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()}
        for p in sorted(tally, reverse=True):
            n, low, high = tally[p]
            if above + n >= k:
                break
            above += n
        lo, hi = low, math.nextafter(high, math.inf)
        if low == high or n <= 1000:
            break
    edge = keyed.filter((key >= lo) & (key < hi))
    if low == high:  # copies of one row: any of them will do, so each part of the table gives its share of the places left
        edge = edge.withColumn("_part", F.spark_partition_id())
        quota, left = {}, k - above
        for r in edge.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row per part
            quota[r["_part"]] = min(left, r["n"])
            left -= quota[r["_part"]]
        own = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in quota.items() for x in item]), F.col("_part")), F.lit(0))
        nth = F.row_number().over(Window.partitionBy("_part").orderBy("digest"))
        edge = edge.withColumn("selected", nth <= own).drop("_part")
    else:  # 1000 rows at most
        edge = edge.withColumn("selected", F.row_number().over(Window.orderBy(F.col("gumbel_key").desc(), "doc_id", "digest")) <= k - above)
    rest = keyed.filter((key < lo) | (key >= hi)).withColumn("selected", key >= hi)
    return rest.unionByName(edge)


def resampled(docs: DataFrame, labels: DataFrame, share: float = 0.5, seed: int = 42) -> DataFrame:
    """Scores all of ``docs`` and draws ``share`` of its rows, rounded up.

    Null texts have no n-grams and weight 0; without labels all weights are 0 and the draw is
    uniform. Repeated rows get one key and are drawn together but for the last place. Other columns are ignored, whatever
    their names. Long texts are read whole. No rows, no rows.
    """
    rows = written(scored(docs, labels), "importance")
    return gumbel_top_k(rows, math.ceil(share * rows.count()), seed)
