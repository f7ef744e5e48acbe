import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from weftline.llm import lattice, shared

FILE = "piece_bpe_32k.model"


def ways(data, pieces, longest):
    """All segmentations of ``data``, each a list of pieces."""
    if not data:
        return [[]]
    return [[data[:n], *rest] for n in range(1, min(longest, len(data)) + 1) if data[:n] in pieces for rest in ways(data[n:], pieces, longest)]


@pytest.fixture(scope="module")
def pieces():
    automaton, first = lattice._vocabulary(FILE)
    by_bytes = {k.encode("latin-1"): v[0] for k, v in automaton.items()}
    return by_bytes, first


def test_words_sum_over_all_segmentations(pieces):
    by_bytes, first = pieces
    logs = [math.log(x) for x in first]
    automaton, _ = lattice._vocabulary(FILE)
    for word in ("a", "the", "token", "é中", "zzq", "x1y2", "▁b"):
        every = ways((lattice.MARK + word).encode(), by_bytes, 60)
        want = [math.exp(sum(logs[by_bytes[p]] for p in way)) for way in every]
        edges, size = lattice._edges(automaton, word)
        assert math.isclose(lattice._forward(edges, size, logs)[-1], math.log(sum(want)), rel_tol=1e-12)
        counts, by_logs = [0.0] * len(logs), [0.0] * len(logs)
        lattice._expected(edges, size, logs, list(first), 3, counts)
        lattice._expected(edges, size, logs, [0.0] * len(logs), 3, by_logs)  # products that vanish
        assert all(math.isclose(x, y, rel_tol=1e-9) for x, y in zip(counts, by_logs))
        expected = Counter()
        for way, p in zip(every, want):
            for piece in way:
                expected[by_bytes[piece]] += 3 * p / sum(want)
        assert all(math.isclose(counts[i], n, rel_tol=1e-9) for i, n in expected.items())
        assert math.isclose(sum(counts), sum(expected.values()), rel_tol=1e-9)
    assert math.isclose(first.sum(), 1) and all(bytes([b]) in by_bytes for b in range(256))


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def brute_force(rows, pieces, rounds):
    by_bytes, first = pieces
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1 for i, _ in rows]
    train = Counter(w for (_, t), h in zip(rows, held) if not h for w in words_of(t))
    texts = held.count(False)
    n, v = sum(train.values()) + texts, len(train) + (texts > 0)
    segmented = {w: ways((lattice.MARK + w).encode(), by_bytes, 60) for _, t in rows for w in words_of(t)}
    counts = Counter()

    def weights():
        total = sum(counts.values())
        end = (texts + 0.5) / (texts + total + 1)
        p = {b: (counts[b] + lattice.PRIOR * first[i]) / (total + lattice.PRIOR) * (1 - end) for b, i in by_bytes.items()}
        return p, end

    for _ in range(rounds):
        p, _ = weights()
        fresh = Counter()
        for w, c in train.items():
            likely = [math.prod(p[x] for x in way) for way in segmented[w]]
            for way, x in zip(segmented[w], likely):
                for piece in way:
                    fresh[piece] += c * x / sum(likely)
        counts = fresh
    p, end = weights()
    base = lambda c: math.log10((c + 0.5) / (n + 0.5 * (v + 1)))
    out = []
    for (i, t), h in zip(rows, held):
        words = words_of(t)
        score = math.log10(end) + sum(math.log10(sum(math.prod(p[x] for x in way) for way in segmented[w])) for w in words)
        out.append((i, h, len(words) + 1, sum(train[w] > 0 for w in words) + (texts > 0), n, round(sum(base(train[w]) for w in words) + base(texts), 6), round(score, 6)))
    return out


def rounded(df):
    return sorted(repr((*tuple(r)[:5], round(r[5], 6), round(r[6], 6))) for r in df.collect())


def scored(docs):
    return lattice.scored(docs, F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1, FILE)


def test_texts_against_brute_force(spark, pieces, monkeypatch):
    rng = random.Random(13)
    vocabulary = ["the", "THE", "Token", "é", "of", "中", "x\x1cy", "one-two", "can't", "a"]
    rows = [(i, rng.choice([" ", "\n", "\t\x0b "]).join(rng.choices(vocabulary, k=rng.randint(0, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n"), (103, "\xa0"), (3, "twice the"), (3, "twice the"), (None, "no id"), (None, None)]
    docs = spark.createDataFrame([(*r, "taken", 2) for r in rows], "doc_id long, text string, word string, row int").repartition(4)
    want = sorted(map(repr, brute_force(rows, pieces, lattice.ROUNDS)))
    assert rounded(scored(docs)) == want
    monkeypatch.setattr(shared, "FREQUENT", 4)  # most words are rare now
    assert rounded(scored(docs)) == want
    assert scored(docs.limit(0)).count() == 0
    alone = [(i, "only the held out") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert rounded(scored(spark.createDataFrame(alone, "doc_id long, text string"))) == sorted(map(repr, brute_force(alone, pieces, lattice.ROUNDS)))


def test_long_words_and_likelihood_that_grows(spark):
    docs = spark.createDataFrame([(i, "z" * 100_000 if i == 4 else f"the fitted words {i % 9}") for i in range(300)], "doc_id long, text string")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    total = [lattice.scored(docs, held_out, FILE, rounds).filter("doc_id != 4").agg(F.sum("score")).first()[0] for rounds in (0, 1, 3)]
    assert total[0] < total[1] < total[2] < 0
