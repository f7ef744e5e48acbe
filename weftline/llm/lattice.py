"""Scores of texts under a unigram model of subwords, over all ways to cut them.

The pieces of an existing vocabulary are drawn independently, or the text ends. A word, with the mark that vocabularies put before
words, is a lattice whose edges are the pieces found in it (single bytes included, so every word has a path); its
probability is the sum over all paths, by a forward recursion in logarithms. No piece that occurs reaches over a
word's beginning, so a text's lattice falls apart into its words, and each distinct word of the corpus is computed once.
The vocabulary's own scores give the first weights and stay in as a prior; expectation-maximisation on the training words' counts refines them.
"""

from __future__ import annotations

import math
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.tables import written
from .shared import joined_by_frequency

#: Rounds of expectation-maximisation, and how many drawn pieces the vocabulary's own scores count for.
ROUNDS, PRIOR = 3, 1000.0
#: The mark before a word, as vocabularies of pieces spell it.
MARK = "▁"


@cache
def _vocabulary(file: str) -> tuple[object, np.ndarray]:
    """(automaton that finds pieces by their bytes, first weights of the pieces).

    The file's scores order the pieces (they are merge ranks, not probabilities), so a piece's first weight is the inverse of its place. Bytes that
    are no piece of their own come last. Control pieces, and those with a mark after their beginning, never occur.
    """
    import ahocorasick
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=file if os.path.isabs(file) else public_tokenizers.path(file))
    spelled = [(-model.get_score(i), model.id_to_piece(i).encode("utf-8")) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    order = [p for _, p in sorted(s for s in spelled if MARK.encode() not in s[1][1:])]
    have = set(order)
    order += [bytes([b]) for b in range(256) if bytes([b]) not in have]
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(order):
        automaton.add_word(p.decode("latin-1"), (i, len(p)))
    automaton.make_automaton()
    weights = 1.0 / np.arange(2, len(order) + 2)
    return automaton, weights / weights.sum()


def _both(x: float, y: float) -> float:
    """log(exp(x) + exp(y)); y may be minus infinity."""
    return x + math.log1p(math.exp(y - x)) if x >= y else y + math.log1p(math.exp(x - y))


def _edges(automaton, word: str) -> tuple[list[tuple[int, int, int]], int]:
    """((from, to, piece) by their ends, bytes) of a marked word."""
    data = (MARK + word).encode().decode("latin-1")
    return [(end + 1 - size, end + 1, i) for end, (i, size) in automaton.iter(data)], len(data)


def _forward(edges: list[tuple[int, int, int]], size: int, logs: list[float]) -> list[float]:
    """Log probability of all paths from the beginning to each place."""
    alpha = [0.0] + [-math.inf] * size
    for a, z, i in edges:
        alpha[z] = _both(alpha[a] + logs[i], alpha[z])
    return alpha


#: A word's probability from which on plain products are exact enough to count with.
LEAST = 1e-280


def _expected(edges: list[tuple[int, int, int]], size: int, logs: list[float], plain: list[float], times: int, counts: list[float]) -> None:
    """Adds how often each piece is expected in ``times`` occurrences of a word. ``plain`` are the probabilities themselves; where their products get too small,
    logarithms do."""
    alpha = [1.0] + [0.0] * size
    for a, z, i in edges:
        alpha[z] += alpha[a] * plain[i]
    if alpha[size] > LEAST:
        beta = [0.0] * size + [times / alpha[size]]
        for a, z, i in reversed(edges):  # by their ends from the last: what follows an end is complete when it is met
            through = plain[i] * beta[z]
            counts[i] += alpha[a] * through
            beta[a] += through
        return
    alpha = _forward(edges, size, logs)
    beta = [-math.inf] * size + [0.0]
    for a, z, i in reversed(edges):
        through = logs[i] + beta[z]
        counts[i] += times * math.exp(alpha[a] + through - alpha[size])
        beta[a] = _both(through, beta[a])


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lower, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")


def fitted(words: DataFrame, texts: int, file: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log probabilities of the pieces, then of the end: expectation-maximisation on ``words`` (word, c), a written table.

    Each round, every partition sums up what its words expect; a vocabulary's worth of sums reaches the driver. ``texts`` is how many ends there were.
    """
    _, first = _vocabulary(file)
    counts = np.zeros(len(first))

    def logs_of(counts: np.ndarray) -> np.ndarray:
        p = (counts + PRIOR * first) / (counts.sum() + PRIOR)
        end = (texts + 0.5) / (texts + counts.sum() + 1)
        return np.append(np.log(p) + math.log1p(-end), math.log(end))

    for _ in range(rounds):
        logs = logs_of(counts).tolist()

        def expect(batches, logs=logs):
            automaton, weights = _vocabulary(file)
            plain = [math.exp(x) for x in logs]
            sums = [0.0] * len(weights)
            for b in batches:
                for word, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    _expected(*_edges(automaton, word), logs, plain, c, sums)
            at = [i for i, x in enumerate(sums) if x]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([sums[i] for i in at], pa.float64())], names=["piece", "n"])

        found = words.select("word", "c").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(first))
        counts[found.column("piece").to_numpy()] = found.column("n").to_numpy()
    return logs_of(counts)


def scored(docs: DataFrame, held_out: Column, file: str, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each text; rows with ``held_out`` teach nothing.

    Tokens are the words between white space, A-Z lower-cased, and one end. ``base_score`` has smoothed counts of whole tokens, ``score`` is the
    base-10 logarithm of the text's probability over all segmentations. A null or empty text is its end alone. Repeated rows count
    and are scored each; null ids stay; long texts and words are read whole. Where nothing is held back, or all is, the prior stands.
    No rows, no rows; further columns end here. Frequent words are broadcast with their scores, rare ones joined by shuffle.
    """
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), _words(F.col("text")).alias("words"))
    table = written(given, "tokens")
    seen = table.select("row", "held_out", F.explode("words").alias("word"))
    words = written(seen.groupBy("word").agg(F.count_if(~F.col("held_out")).alias("c"), F.count("*").alias("n")), "words")
    sums = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    texts = table.filter("not held_out").count()
    tokens, distinct = sums["c"] + texts, sums["distinct"] + (texts > 0)
    logs = fitted(words.filter("c > 0"), texts, file, rounds)
    base = lambda c: F.log10((c + 0.5) / F.lit(tokens + 0.5 * (distinct + 1)))
    as_list = logs.tolist()

    def weigh(batches):
        automaton, _ = _vocabulary(file)
        for b in batches:
            paths = [_forward(*_edges(automaton, word), as_list)[-1] for word in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(paths, pa.float64())], names=["word", "c", "n", "path"])

    weights = written(words.mapInArrow(weigh, "word string, c long, n long, path double"), "word-scores")
    known = F.count_if(F.col("c") > 0).alias("known")
    parts = [p.groupBy("row").agg(known, F.sum(base(F.col("c"))).alias("base"), F.sum("path").alias("path")) for p in joined_by_frequency(seen.select("row", "word"), weights, "word", "n", sums["n"])]
    of_row = parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("known").alias("known"), F.sum("base").alias("base"), F.sum("path").alias("path"))
    out = table.select("row", "doc_id", "held_out", (F.size("words") + 1).cast("long").alias("n_tokens")).join(of_row, "row", "left")
    end = F.lit(texts).cast("long")
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.coalesce("known", F.lit(0)) + F.when(end > 0, 1).otherwise(0)).cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.coalesce("base", F.lit(0.0)) + base(end)).alias("base_score"),
        ((F.coalesce("path", F.lit(0.0)) + F.lit(float(logs[-1]))) / math.log(10)).alias("score"),
    )
