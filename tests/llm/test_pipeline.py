import random

import pytest
import corpus_pipeline as pipeline
from weftline.llm import langid, simhash

from .test_langid import rows as labelled

SCHEMA = "doc_id long, text string, lang string"


def words(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))


def brute_classes(rows):
    """Lists of rows whose fingerprints are linked over 4 or fewer differing bits."""
    left, out = list(rows), []
    while left:
        own = [left.pop()]
        for x in own:
            near = [y for y in left if (simhash.fingerprint(x[1]) ^ simhash.fingerprint(y[1])).bit_count() <= 4]
            own += near
            left = [y for y in left if not any(y is z for z in near)]
        out.append(own)
    return out


NULLS = [(None, words(i), "x") for i in range(6)]
REPEATED = [(7, words(20), "x"), (7, words(21), "x"), (7, words(21), "x"), (9, words(21), "x"), (8, words(20), "y")]
COPIES = [(3, words(0), "x"), (None, words(22), "x"), (None, words(22), "x"), (None, words(22), "y"), (12, None, "x"), (11, "", "x")]


@pytest.mark.parametrize("rows", [NULLS, REPEATED, NULLS + REPEATED + COPIES])
def test_near_dedup_keeps_one_row_of_each_class(spark, rows):
    kept = [tuple(r) for r in pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect()]
    found = brute_classes(rows)
    assert len(kept) == len(found)
    for own in found:
        ids = [r[0] for r in own if r[0] is not None]
        assert [r[0] for r in kept if r in own and r[0] == (min(ids) if ids else None)] == [min(ids) if ids else None]


def table(spark, rows):
    """Documents of the driver's columns from (doc_id, text, lang)."""
    return spark.createDataFrame([(*r, "s", None if r[1] is None else len(r[1])) for r in rows], SCHEMA + ", source string, n_chars long")


def test_language_stage_drops_only_documents_without_a_language(spark):
    given = labelled()
    mixed = [(5000 + i, " ".join(given[60 * k + i][1] for k in (0, 1, 2)), None) for i in range(30)]
    docs = table(spark, given + mixed + [(None, "the people are happy", "en"), (1, None, "en"), (2, "12 34", "de"), (3, "", None)])
    scores = {r["doc_id"]: r["score"] for r in langid.identify(docs).collect()}
    assert min(scores[i] for i, *_ in mixed) < 0.5  # no language makes up half of them
    kept = [r["doc_id"] for r in pipeline.language_id(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([r[0] for r in given + mixed] + [None], key=str)


def test_decontamination_and_redaction(spark, tmp_path):
    item = words(50, 14)
    spark.createDataFrame([(1, item), (2, words(51, 3)), (3, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, words(60), "x"), (1, words(61) + " " + item.upper(), "x"), (None, item, "x"), (None, words(62), "x"), (2, "a " + " ".join(item.split()[:9]), "x"), (3, None, "x"), (4, words(51, 3), "x"), (5, words(63), "x"), (5, words(63), "x")]
    windows = {tuple(w.split()[i : i + 10]) for w in (item,) for i in range(5)} | {tuple(words(51, 3).split())}
    hit = lambda t: any(tuple(t.lower().split()[i : i + n]) in windows for n in (3, 10) for i in range(len(t.split())))
    got = [tuple(r)[:3] for r in pipeline.decontaminate(spark, table(spark, rows), str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted((r for r in rows if not hit(r[1] or "")), key=str) and len(got) == 6

    mail = "write to ann.lee@mail.example about it, "
    rows = [(i, f"{mail}{words(70 + i, 9)}", "x") for i in range(20)] + [(None, f"{mail}x", "x"), (None, "plain", "x"), (5, "plain again", "x"), (5, "plain again", "x"), (6, None, "x"), (7, "", "x")]
    got = [(r["doc_id"], r["text"], r["n_chars"]) for r in pipeline.redact(spark, table(spark, rows), "").collect()]
    clean = lambda t: t and t.replace("ann.lee@mail.example", "[EMAIL]")
    assert sorted(got, key=str) == sorted(((i, clean(t), None if t is None else len(clean(t))) for i, t, _ in rows), key=str)


@pytest.mark.parametrize("n", [0, 60])
def test_run(spark, tmp_path, n):
    spark.createDataFrame([(1, words(50, 14))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    one = words(80)
    rows = [(i, f"{words(100 + i)}", "en") for i in range(n)] + [(None, one, "en"), (None, words(81), "en"), (None, words(50, 14), "en"), (300, one, "en"), (301, one, "en"), (301, None, "en")]
    table(spark, rows).limit(len(rows) if n else 0).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"] for r in pipeline.run(spark, str(tmp_path)).collect()), key=str)
    assert got == (sorted([*range(n), None, 300], key=str) if n else [])


def test_clashing_columns_pass_through(spark, tmp_path):
    spark.createDataFrame([(1, words(50, 14))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = "score mixture lang_pred fp digest component component_id rows kept_id hit_id base extra spans redacted column0 column3 _text _digest _id found hits words".split()
    rows = [(i, words(i) + " ann.lee@mail.example", "en", "s", 3, *[f"{c}{i}" for c in extra]) for i in range(5)] + [(None, words(9), "en", None, None, *[None] * len(extra))]
    docs = spark.createDataFrame(rows, SCHEMA + ", source string, n_chars long, " + ", ".join(f"{c} string" for c in extra))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = sorted((tuple(r)[5:] for r in out.collect()), key=str)
        assert got == sorted((r[5:] for r in rows), key=str), name
        assert all((r["n_chars"] == len(r["text"])) == (name == "redact" and r["doc_id"] is not None) for r in out.collect()), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert pipeline.packing(spark, docs, str(tmp_path)).count() == 6
