"""Language identification by multilingual mixture inference.

Each language is a smoothed distribution over hashed character trigrams, counted over every
training document. A document is taken as a mixture: expectation-maximisation estimates its
languages' proportions from the trigram likelihoods, and the set of languages is chosen by
penalised likelihood: each language beyond the first must gain more than
``PENALTY * log(trigrams)`` of log-likelihood, so texts in one language keep a set of one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .shared import small_batches

BUCKETS = 1 << 15
SMOOTHING = 0.5
PENALTY = 3.0
ROUNDS = 12
#: Numbers of one block of a document's likelihoods (trigrams times languages); longer documents and more languages take more blocks.
BLOCK = 1 << 20
#: Columns that a prediction adds.
ADDED = ("lang_pred", "score", "mixture")
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"

_is_letter: np.ndarray | None = None


def trigrams(text: str) -> np.ndarray:
    """Bucket numbers of the lower-cased text's character trigrams; what is no letter counts as a space."""
    global _is_letter
    if _is_letter is None:
        _is_letter = np.array([LETTER.match(chr(c)) is not None and not 0xD800 <= c < 0xE000 for c in range(0x10000)])
    code = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "replace"), np.uint32)
    basic = code < 0x10000
    letter = np.where(basic, _is_letter[np.where(basic, code, 0)], code < 0xE0000)
    code = np.where(letter, code, np.uint32(32))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = code[keep]
    h = code[:-2] * np.uint32(0x9E3779B1) + code[1:-1] * np.uint32(0x85EBCA77) + code[2:] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    return (h * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))


@dataclass
class Model:
    languages: list[str]
    log_p: np.ndarray  # (BUCKETS, languages)


def fit(labelled: DataFrame) -> Model:
    """Trigram counts over all rows of ``labelled`` (text, lang); null texts and langs are left out.

    Each partition adds up its own counts first, so what is shuffled is at most ``BUCKETS``
    rows per language and partition, and what reaches the driver ``BUCKETS`` per language.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, n in totals.items():
                at = np.nonzero(n)[0]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])
            totals.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if lang not in totals and len(totals) >= 64:
                    yield from out()
                if lang not in totals:
                    totals[lang] = np.zeros(BUCKETS, np.int64)
                np.add.at(totals[lang], trigrams(text), 1)
        yield from out()

    known = labelled.filter("text is not null and lang is not null").select("text", "lang")
    counts = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = counts.toArrow()
    languages = sorted(set(table.column("lang").unique().to_pylist()))
    log_p = np.empty((BUCKETS, len(languages)), np.float32)
    if languages:
        lang, bucket, n = (table.column(c).combine_chunks() for c in ("lang", "bucket", "n"))
        code = lang.dictionary_encode()
        place = np.array([languages.index(x) for x in code.dictionary.to_pylist()])[code.indices.to_numpy()]
        order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[order], np.arange(len(languages) + 1))
        for i in range(len(languages)):  # a language at a time: one column of counts
            own = order[ends[i] : ends[i + 1]]
            counted = np.full(BUCKETS, SMOOTHING)
            counted[bucket.to_numpy()[own]] += n.to_numpy()[own]
            log_p[:, i] = np.log(counted / counted.sum())
    return Model(languages, log_p)


def _em(blocks, weights: list[np.ndarray], theta: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Mixture proportions and log-likelihood; ``blocks()`` gives the likelihoods of the trigrams (relative to a scale of their own), block by block."""
    total = sum(w.sum() for w in weights)
    for _ in range(rounds):
        gained = [(w / (p @ theta)) @ p for p, w in zip(blocks(), weights)]
        theta = theta * (gained[0] if len(gained) == 1 else sum(gained)) / total
    return theta, float(sum(w @ np.log(p @ theta) for p, w in zip(blocks(), weights)))


def infer(model: Model, text: str | None) -> dict[str, float]:
    """Proportions of the chosen languages, the largest first, ties by name; empty if the text has no letter
    or no language was learned."""
    if not text or not model.languages or not LETTER.search(text):
        return {}
    grams = trigrams(text)
    weight = np.ones(len(grams))
    if len(grams) > 512:
        grams, weight = np.unique(grams, return_counts=True)
    size = max(1, BLOCK // len(model.languages))
    cuts = range(0, len(grams), size)
    weights = [weight[i : i + size] for i in cuts]
    logs = lambda i: model.log_p[grams[i : i + size]].astype(np.float64)
    single = sum(w @ logs(i) for i, w in zip(cuts, weights))
    best = int(single.argmax())
    if len(model.languages) == 1:
        return {model.languages[0]: 1.0}
    scales = [logs(i).max(axis=1) for i in cuts]
    whole = lambda i, scale: np.exp(logs(i) - scale[:, None])
    kept = [whole(i, scale) for i, scale in zip(cuts, scales)] if len(cuts) == 1 else None  # one block is computed once, of more only one is held
    blocks = lambda: kept if kept else (whole(i, scale) for i, scale in zip(cuts, scales))
    shift = float(sum(w @ scale for scale, w in zip(scales, weights)))
    theta, _ = _em(blocks, weights, np.full(len(model.languages), 1 / len(model.languages)))
    order = [best, *(i for i in np.argsort(-theta, kind="stable").tolist() if i != best)]
    chosen, value = {best: 1.0}, float(single[best]) - shift
    cost = PENALTY * np.log(weight.sum() + 1)
    for k in range(2, len(order) + 1):
        part = order[:k]
        own = [p[:, part] + 1e-30 for p in kept] if kept else None
        t, ll = _em(lambda: own if own else (p[:, part] + 1e-30 for p in blocks()), weights, np.maximum(theta[part], 1e-6) / np.maximum(theta[part], 1e-6).sum())  # noqa: B023
        if ll - value <= cost:
            break
        chosen, value = dict(zip(part, t.tolist())), ll
    return {model.languages[i]: w for i, w in sorted(chosen.items(), key=lambda x: (-x[1], x[0]))}


def predict(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all by default) of ``docs`` with lang_pred, score and mixture.

    lang_pred is the language of the largest proportion and score that proportion (0 to 1);
    ``und`` and 0 for null and empty texts, texts without a letter, or an empty model. ``mixture`` lists
    the chosen languages and proportions, ties by name. Only ``text`` is an input of the prediction, read whole however long; repeated rows
    get repeated results. Columns of these three names are replaced, others pass through. The model holds ``BUCKETS`` numbers for each language, and grows
    with nothing else; likelihoods of one document are held ``BLOCK`` numbers at a time.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(*keep)

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [infer(shared.value, t) for t in b.column(b.num_columns - 1).to_pylist()]
        first = [next(iter(x.items()), (UNKNOWN, 0.0)) for x in found]
        mixture = pa.array([[{"lang": k, "share": v} for k, v in x.items()] for x in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))
        added = [pa.array([x for x, _ in first], pa.string()), pa.array([min(1.0, max(0.0, float(v))) for _, v in first], pa.float64()), mixture]
        return pa.RecordBatch.from_arrays([*b.columns[:-1], *added], names=[*b.schema.names[:-1], "lang_pred", "score", "mixture"])

    out = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("mixture", ArrayType(StructType([StructField("lang", StringType()), StructField("share", DoubleType())])))])
    return docs.select(*keep, docs["text"].alias("_text")).mapInArrow(small_batches(batch), out)


def held_out(docs: DataFrame):
    """The rows kept out of training: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out, but not learned from."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Fit on the rows of ``docs`` that are not held out and predict for all rows (:func:`predict`). No rows, no rows."""
    model = fit(docs.filter(~held_out(docs) & docs["doc_id"].isNotNull()))
    return predict(docs, model, keep)
