import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from weftline.llm import pack

FILE = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_librarys():
    rng = random.Random(4)
    library = Tokenizer.from_file(FILE)
    library.encode_special_tokens = True
    fast = pack.Tokenizer(FILE)
    alphabet = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x250), *range(0x370, 0x400), 0x130, 0x1C, 0x85, 0xA0, 0x2003, 0x301, 0x4E2D, 0x1F600]] + list("abcdefghij  \n\t'.") * 12
    texts = ["", " ", "It's  DON'T we'll ''s", "<|endoftext|> x", "ΣΑΣ ΟΔΟΣ", "é ́e", "12 3", "x" * 5000] + ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(4000)]
    for t in texts:
        assert np.frombuffer(fast.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            i = min(fits, key=lambda i: gaps[i])
            gaps[i] -= n
        else:
            gaps.append(capacity - n)
    return sorted(gaps)


def test_sweeps_against_best_fit_decreasing(spark):
    rng = random.Random(5)
    for capacity, n, most in ((7, 60, 7), (300, 500, 260)):
        lengths = [rng.randint(1, most) for _ in range(n)]
        items = spark.createDataFrame([(i, 0, x, i) for i, x in enumerate(lengths)], "doc_id long, piece int, length long, rank int")
        by = {}
        out = pack.best_fit(items, capacity).collect()
        for r in out:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert sorted(r["length"] for r in out) == sorted(lengths) and all(r["rank"] == r["doc_id"] for r in out)
        for places in by.values():
            at = 0
            for o, x in sorted(places):
                assert o == at
                at += x
            assert at <= capacity
        assert len(by) <= len(best_fit_decreasing(lengths, capacity)) * 1.02 + 1


def test_packing_of_a_table(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["one", "two", "Three!"]) for _ in range(rng.choice([0, 3, 300, 900, 2047, 2048, 5000])))) for i in range(80)]
    rows += [(200, None), (201, ""), (7, "again again"), (7, "again again"), (None, "no id")]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, length int")
    out = pack.packed_documents(docs, "word_bpe_49k.json").collect()
    library = Tokenizer.from_file(FILE)
    want = []
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k, a, len(ids[a : a + 2048]), zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in out)
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(by) <= len(best_fit_decreasing([w[3] for w in want], 2048))
    assert pack.packed_documents(docs.limit(0), "word_bpe_49k.json").count() == 0
