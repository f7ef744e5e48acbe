import random
import re

import pytest
from weftline.llm import winnow

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(len(w) - 9) if len(w) >= 10 else ([0] if w else []):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(i)
    out = []
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for k in range(len(w)):
            for n in range(1, 11):
                if k + n <= len(w) and (ids := windows.get(tuple(w[k : k + n]))):
                    hit |= set(range(k, k + n))
                    found |= {str(i) for i in ids if i is not None}
        out.append((d, len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("broadcast_rows", [10**6, 0])
def test_against_brute_force(spark, broadcast_rows):
    rng = random.Random(3)
    vocabulary = ["Alpha", "be", "c3", "délta", "e"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([4, 8, 9, 10, 11, 30]))) for i in range(12)] + [(50, None), (51, "..."), (None, line(12)), (52, "e " * 40), (7, line(15))]
    docs = [(i, line(rng.randint(0, 60)) + " " + rng.choice(items)[1 if rng.random() < 0.5 else 0].__str__()) for i in range(60)]
    docs += [(100, None), (101, ""), (102, "e, " * 3000), (102, "e, " * 3000), (None, line(40)), (103, items[9][1])]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_hit int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, words string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["item_ids"]) for r in winnow.contamination(d, b, broadcast_rows=broadcast_rows).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r["n_words"], r["n_hit"]) for r in winnow.contamination(d, b).collect()] == [(2, 0)]
    assert winnow.contamination(d.limit(0), b).count() == 0
