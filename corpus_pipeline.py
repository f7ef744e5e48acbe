"""From raw documents to packed sequences: five stages, each written and reread.

Every stage works on all its predecessor kept. All but the last return the columns of
``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weftline.llm import langid, pack, pii, simhash, winnow
from weftline.operators.tables import written

TOKENIZER = "word_bpe_49k.json"
#: Language inference, expectation-maximisation and packing have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """``docs`` with its columns named column0, column1, …, so that none clashes with an operator's; the new name of
    each, and the columns that give the old names back."""
    new = {c: f"column{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*new.values()), new, [F.col(n).alias(c) for c, n in new.items()]


def _texts(docs: DataFrame, new: dict[str, str], *more) -> DataFrame:
    """What the operators read: doc_id and text, with ``more``."""
    return docs.select(F.col(new["doc_id"]).alias("doc_id"), F.col(new["text"]).alias("text"), *more)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language (null, empty or no letters); those in several are kept.

    Repeated rows and ids are decided each by its own text, whole. No rows, no rows; an empty model knows no language and
    keeps nothing. Further columns pass through, whatever their names.
    """
    docs, new, back = _numbered(docs)
    found = langid.identify(_texts(docs, new, F.col(new["lang"]).alias("lang"), *new.values()), keep=list(new.values()))
    return found.filter(F.col("lang_pred") != langid.UNKNOWN).select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each near-duplicate class: that with the smallest id, null ids last.

    Among rows of one id the digest of the whole row decides, and of equal rows one is kept. Ids
    play no part in what a class is: documents without an id or with the same one are all kept if
    their texts are far apart, and lost to a near copy like any other. Null and empty texts are one class. No rows, no
    rows; further columns pass through, whatever their names.
    """
    docs, new, back = _numbered(docs)
    docs = docs.withColumn("digest", F.xxhash64(*[x for c in new.values() for x in (F.col(c), F.isnull(c))]))
    rows = simhash.classes(_texts(docs, new, "digest"), keep=("digest",)).groupBy("component", "doc_id", "digest").agg(F.count("*").alias("rows"))
    first = rows.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("null"), "doc_id", "digest", "rows")).alias("x"))
    first = written(first.select(F.col("x.doc_id").alias("kept_id"), F.col("x.digest").alias("kept_digest"), F.col("x.rows").alias("rows")), "kept")
    kept = docs.join(first, F.col(new["doc_id"]).eqNullSafe(F.col("kept_id")) & (F.col("digest") == F.col("kept_digest")))
    one = kept.filter("rows > 1").dropDuplicates(["kept_id", "kept_digest"])
    return kept.filter("rows = 1").unionByName(one).select(*back)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Every row is decided by its own text: of rows with one id, or none, those with a hit go. Null and wordless texts
    stay. An empty benchmark drops nothing; further columns pass through, whatever their names.
    """
    docs, new, back = _numbered(docs)
    found = winnow.contamination(_texts(docs, new), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = written(found.filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest")).distinct(), "contaminated")
    return docs.join(hit, F.col(new["doc_id"]).eqNullSafe(F.col("hit_id")) & (F.xxhash64(new["text"]) == F.col("hit_digest")), "left_anti").select(*back)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind. n_chars follows the text; a null text stays null, and so does a null n_chars
    where nothing is replaced.

    All rows stay, repeated ones and those without an id included. No rows, no rows; further columns pass through,
    whatever their names.
    """
    docs, new, back = _numbered(docs)
    kinds = dict(docs.dtypes)
    found = written(pii.candidates(_texts(docs, new, *new.values()), list(new.values())), "personal-data")  # read twice: to fit, then to decide
    found = pii.with_spans(found, pii.fit(found))
    text = F.col(new["text"])
    out = found.withColumn("redacted", F.when(text.isNotNull(), pii.redacted(text, F.col("spans"))))
    if "n_chars" in new:
        out = out.withColumn(new["n_chars"], F.when(F.size("spans") > 0, F.length("redacted").cast(kinds[new["n_chars"]])).otherwise(F.col(new["n_chars"])))
    return out.drop(new["text"]).withColumnRenamed("redacted", new["text"]).select(*back)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack what is left into sequences of 2048 tokens: one row per piece.

    A null text is its end id alone; repeated rows are packed each. Columns but doc_id and text end here.
    """
    return pack.packed_documents(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("redact", redact), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each on the written result of the one before."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
