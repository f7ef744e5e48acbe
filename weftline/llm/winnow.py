"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``span`` (10) consecutive words. Its fingerprint is the minimum hash over its
``span - gram + 1`` word 5-grams, so a document and a benchmark item that share a window share
its fingerprint: nothing of ``span`` words or more can be missed. A document keeps a fingerprint
where it changes from one window to the next, and at every ``BLOCK``-th window.

The first pass streams lean rows (document, length, fingerprint, place) against the benchmark's
fingerprints and keeps the places that meet. The second reads the texts of those documents
alone and extends every hit to the windows that may share its fingerprint, each looked up word
by word among the benchmark's windows. Items shorter than a window are one window of their own
length, looked up by the hash of all their words, for those lengths the benchmark has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.tables import written
from .shared import broadcast_if

SPAN, GRAM = 10, 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows after which a fingerprint is kept again though it has not changed.
BLOCK = 16
#: Benchmark windows that are broadcast at most (some tens of MB).
BROADCAST_ROWS = 200_000
#: Hit places of documents that are broadcast at most.
BROADCAST_HITS = 500_000


def words(text: Column) -> Column:
    """Lower-cased (A-Z only) words of a text; none for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _range(first: int, last: Column) -> Column:
    """first..last, empty if last is smaller."""
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def with_grams(df: DataFrame, gram: int) -> DataFrame:
    """Adds n_words, hashes (of words) and grams (hashes of ``gram`` consecutive words)."""
    df = df.withColumn("n_words", F.size("words")).withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    joined = lambda i: F.xxhash64(*[F.get("hashes", i + d) for d in range(gram)])
    return df.withColumn("grams", F.transform(_range(0, F.col("n_words") - gram), joined))


def _least(at: Column, span: int, gram: int) -> Column:
    """The smallest gram hash of the window that begins at the 0-based place ``at``."""
    own = [F.get("grams", at + d) for d in range(span - gram + 1)]
    return F.least(*own) if len(own) > 1 else own[0]


def _chained(at: Column, n: int) -> Column:
    """One hash over the n word hashes from the 0-based place ``at``."""
    h = F.lit(0).cast("long")
    for d in range(n):
        h = F.xxhash64(h, F.get("hashes", at + d))
    return h


def benchmark_windows(items: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Distinct windows of the items: len, key (the fingerprint to join on), win (words) and item_set,
    the number of the set of items that hold it. A set's list is bounded by the benchmark's items."""
    w = with_grams(items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("words")), gram)
    # the outer generators here and below keep the optimizer from inferring filters, which would inline the arrays above into their own lambdas
    at = w.select("item_id", "words", "grams", "n_words", F.explode_outer(_range(0, F.greatest(F.lit(0), F.col("n_words") - span))).alias("i")).filter("n_words > 0")
    length = F.least(F.col("n_words"), F.lit(span))
    win = F.slice("words", F.col("i") + 1, length)
    short = F.aggregate(win, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, F.xxhash64(x)))
    key = F.when(F.col("n_words") >= span, _least(F.col("i"), span, gram)).otherwise(short)
    flat = at.select("item_id", length.alias("len"), key.alias("key"), win.alias("win"))
    sets = flat.groupBy("len", "key", "win").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return sets.select("len", "key", "win", F.xxhash64("item_ids").alias("item_set"), "item_ids")


def fingerprint_hits(docs: DataFrame, keys: DataFrame, short: list[int], small: bool, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per distinct (doc_id, digest): n_words, copies (rows) and ``hits``, the places (len, i) whose fingerprint is among ``keys``."""
    d = with_grams(docs.select("doc_id", F.xxhash64("text").alias("digest"), words(F.col("text")).alias("words")), gram)
    d = d.select("doc_id", "digest", "n_words", "hashes", "grams", F.explode_outer(F.sequence(F.lit(-1), F.col("n_words") - 1)).alias("i"))
    i, n = F.col("i"), F.col("n_words")
    d = d.withColumns({"key": _least(i, span, gram), "before": _least(i - 1, span, gram)})
    kept = (i >= 0) & (i <= n - span) & ((i % BLOCK == 0) | (F.col("key") != F.col("before")))
    own = ["doc_id", "digest", "n_words", "i"]
    full = F.when(i < 0, F.struct(F.lit(0).alias("len"), F.lit(0).cast("long").alias("key"))).when(kept, F.struct(F.lit(span).alias("len"), F.col("key").alias("key")))
    if short:
        more = [F.when((i >= 0) & (i <= n - x), F.struct(F.lit(x).alias("len"), _chained(i, x).alias("key"))) for x in short]
        looked = d.select(*own, F.explode_outer(F.array(full, *more)).alias("x")).filter("x is not null").select(*own, "x.len", "x.key")
    else:
        looked = d.filter((i < 0) | kept).select(*own, full["len"].alias("len"), full["key"].alias("key"))
    base = looked.filter("len = 0") if not small else None
    met = looked.filter("len > 0") if not small else looked
    if small:  # one pass: what is not found goes but for the row of the document itself
        met = met.join(F.broadcast(keys.withColumn("found", F.lit(True))), ["len", "key"], "left").filter("found or len = 0")
    else:
        met = met.join(keys, ["len", "key"], "left_semi").select(*own, "len", "key").unionByName(base)
    place = F.when(F.col("len") > 0, F.struct("len", "i"))
    return met.groupBy("doc_id", "digest", "n_words").agg(F.count(F.when(F.col("len") == 0, 1)).alias("copies"), F.collect_set(place).alias("hits"))


def _same_document(hit_id: str, hit_digest: str) -> Column:
    return F.col("doc_id").eqNullSafe(F.col(hit_id)) & (F.col("digest") == F.col(hit_digest))


def extended(docs: DataFrame, hits: DataFrame, windows: DataFrame, small: bool, few: bool, span: int = SPAN) -> DataFrame:
    """(hit_id, hit_digest, places, item_sets) of the documents that hold a window: ``places`` are the hit word numbers, ascending."""
    d = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(broadcast_if(hits, few), _same_document("hit_id", "hit_digest"))
    d = d.select("hit_id", "hit_digest", words(F.col("text")).alias("words"), "hits")
    until = lambda h: F.when(h["len"] < span, h["i"]).otherwise(F.least(h["i"] - h["i"] % BLOCK + BLOCK - 1, F.size("words") - span))
    windows_of = lambda h: F.transform(F.sequence(h["i"], until(h)), lambda k: F.struct(h["len"].alias("len"), k.alias("start")))
    c = d.select("hit_id", "hit_digest", "words", F.explode_outer(F.array_distinct(F.flatten(F.transform("hits", windows_of)))).alias("c"))
    c = c.select("hit_id", "hit_digest", "c.len", "c.start", F.slice("words", F.col("c.start") + 1, F.col("c.len")).alias("win"))
    known = windows.select("win", F.xxhash64("win").alias("win_hash"), "item_set")
    found = c.withColumn("win_hash", F.xxhash64("win")).join(broadcast_if(known, small), ["win_hash", "win"])
    hit = found.groupBy("hit_id", "hit_digest").agg(F.collect_set(F.struct("start", "len")).alias("at"), F.collect_set("item_set").alias("item_sets"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda x: F.sequence(x["start"], x["start"] + x["len"] - 1)))))
    return hit.select("hit_id", "hit_digest", covered.alias("places"), "item_sets")


def contamination(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, broadcast_rows: int = BROADCAST_ROWS, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, item_ids (sorted strings), spans, digest.

    ``spans`` are the hit word ranges [start, end), merged. A null or wordless text has no words
    and no hits; a null item text has no windows; a null item_id counts for hits, not for items.
    Repeated document rows come out once each; two items with one id count once. Other columns
    are ignored, whatever their names. A very long text is one row of the first pass per kept
    fingerprint; only its word hashes, and where it has hits its words, are held at once. Empty
    tables give no rows, or rows without hits.
    """
    every = written(benchmark_windows(benchmark, span, gram), "benchmark-windows")
    windows = every.select("len", "key", "win", "item_set")
    size = every.agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("len") < span, F.col("len"))).alias("short")).first()
    small = size["n"] <= broadcast_rows
    found = written(fingerprint_hits(docs, windows.select("len", "key").distinct(), sorted(size["short"]), small, span, gram), "fingerprint-hits")
    places = found.agg(F.sum(F.size("hits"))).first()[0] or 0
    hits = found.filter(F.size("hits") > 0).select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), "hits")
    met = written(extended(docs, hits, windows, small, places <= broadcast_hits, span), "window-hits")

    sets = every.select("item_set", "item_ids").dropDuplicates(["item_set"])
    named = met.select("hit_id", "hit_digest", F.explode("item_sets").alias("item_set")).join(broadcast_if(sets, small), "item_set")
    named = named.select("hit_id", "hit_digest", F.explode("item_ids").alias("item")).groupBy("hit_id", "hit_digest").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    named = named.select(F.col("hit_id").alias("named_id"), F.col("hit_digest").alias("named_digest"), "item_ids")
    out = found.select("doc_id", "digest", "n_words", "copies").join(met.select("hit_id", "hit_digest", "places"), _same_document("hit_id", "hit_digest"), "left").join(named, _same_document("named_id", "named_digest"), "left")
    none = F.array().cast("array<string>")
    out = out.select("doc_id", "digest", "n_words", F.coalesce("places", F.array().cast("array<int>")).alias("places"), F.coalesce("item_ids", none).alias("item_ids"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    begins = F.filter("places", lambda x, i: (i == 0) | (F.get("places", i - 1) != x - 1))
    ends = F.filter("places", lambda x, i: (i == F.size("places") - 1) | (F.get("places", i + 1) != x + 1))
    spans = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("start"), (b + 1).alias("end")))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_hit"), "item_ids", spans.alias("spans"), "digest")
