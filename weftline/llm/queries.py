"""The numbered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import alignment, chat, fim, importance, langid, lattice, mtree, pack, pii, secret_scan, simhash, winnow, wrapper

TOKENIZER, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_randomness_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan.secrets(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(secret_scan.KINDS[:3])]
    return out.select("doc_id", *counts, F.sha2(secret_scan.spelled(F.col("base")), 256).alias("base_sha256"), secret_scan.spelled(F.col("spans")).alias("spans"))


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnow.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op4_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = langid.identify(docs.withColumn("held_out", langid.held_out(docs)), keep=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op5_weak_supervision_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tables import written

    found = written(pii.candidates(_table(spark, sf_dir, "documents"), ["doc_id"]), "pii-candidates")
    out = pii.with_spans(found, pii.fit(found))
    counts = [_count("base", k).alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op6_wrapper_induction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extracted(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op7_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = "</s>[INST] ok [/INST]"
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(awkward).alias("text")).to(given.schema)
    out = chat.formatted(chat.from_turns(given.unionByName(more)), whole=True)
    turns = F.array_join(F.transform(chat.turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat.loss_text(F.col("text"), F.col("loss_spans"))
    return out.select(
        F.col("key.conv_id").alias("conv_id"),
        F.size(chat.turns_of(F.col("text"))).cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("text").cast("long").alias("formatted_chars"),
    )


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.packed_documents(_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_grams", "log_weight", "gumbel_key", "selected")


def op10_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.transformed(_table(spark, sf_dir, "documents"))
    restored = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.tables import written

    spelled = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    table = alignment.aligned(_table(spark, sf_dir, "documents"), BYTES, PIECES)
    out = alignment.weighed(written(table.withColumn("groups_sha256", spelled).drop("groups"), "alignments"))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1
    return lattice.scored(_table(spark, sf_dir, "documents"), held_out, PIECES)


QUERIES = {
    f.__name__: f
    for f in (
        op1_randomness_battery,
        op2_winnowing,
        op3_simhash,
        op4_language_mixture,
        op5_weak_supervision_pii,
        op6_wrapper_induction,
        op7_reply_trees,
        op8_best_fit,
        op9_importance_resampling,
        op10_mtree,
        op11_fill_in_middle,
        op12_tokenizer_alignment,
        op13_subword_lattice,
    )
}

#: Words as the contract has them, for DuckDB.
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES = {
    "op2_winnowing": rf"""
WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT item_id, len(w) AS n, array_to_string(w, ' ') AS win FROM items WHERE len(w) BETWEEN 1 AND 9
  UNION
  SELECT item_id, 10, array_to_string(list_slice(w, i, i + 9), ' ') FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS i FROM items WHERE len(w) >= 10)),
docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
lengths AS (SELECT DISTINCT n FROM windows),
starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n),
hits AS (SELECT doc_id, i, n, item_id FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win FROM starts) JOIN windows USING (n, win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
""",
    "op7_reply_trees": r"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM rows),
sizes AS (SELECT *, length(ESCAPE_ROLE) + length(ESCAPE_TEXT) + 16 AS n FROM escaped)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY i), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM sizes GROUP BY conv_id
""",
    "op10_mtree": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
    "op11_fill_in_middle": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
  ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(list_slice(w, 1, a), '') AS pre, array_to_string(list_slice(w, a + 1, b), '') AS mid, array_to_string(list_slice(w, b + 1, n), '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
""",
}


def _escape_sql(column: str, controls: tuple[str, ...]) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for c in controls:
        literal = "chr(10)" if c == "\n" else f"'{c}'"
        out = f"replace({out}, {literal}, '{chat.STANDS_FOR[c[0]]}{c[1:]}')"
    return out


ORACLES["op7_reply_trees"] = (
    ORACLES["op7_reply_trees"].replace("ESCAPE_ROLE", _escape_sql("role", (*chat.CONTROLS, "\n"))).replace("ESCAPE_TEXT", _escape_sql("text", chat.CONTROLS))
)
