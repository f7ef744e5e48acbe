import random

import xxhash
from weftline.llm import simhash


def plain_fingerprint(text):
    words = ("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")).encode()
    for c in b"\t\n\v\f\r":
        words = words.replace(bytes([c]), b" ")
    words = [w for w in words.split(b" ") if w]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    """rows: (doc_id, fingerprint) -> smallest reachable id per row."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(rows[i][1] ^ rows[j][1]).count("1") <= 4:
                label[root(i)] = root(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(d)
    return [min((d for d in groups[root(i)] if d is not None), default=None) for i in range(len(rows))]


def test_every_link_meets_in_a_list():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def test_fingerprint_matches_the_plain_form():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "a B c", "É É x Y", "a b c d e f"] + [" ".join(rng.choice("ab cD éx Zq".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]


def near_fingerprints(rng, groups, size):
    out = []
    for _ in range(groups):
        base = rng.getrandbits(64)
        out += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(size)]
    return out


def test_links_through_lists_and_midpoints(spark):
    rng = random.Random(2)
    for limit in (3, 10_000):  # dense lists by midpoints, all lists by pairs
        fps = list(dict.fromkeys(near_fingerprints(rng, 6, 40)))
        signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
        from weftline.operators.components import connected_components

        edges = simhash.links(spark.createDataFrame(signed, "fp long"), list_limit=limit)
        found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
        want = brute_components([(i, f) for i, f in enumerate(fps)])
        got = [found.get(s[0], s[0]) for s in signed]
        assert len(set(zip(got, want))) == len(set(got)) == len(set(want))


def test_classes_with_nulls_ties_and_repeats(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big house by the sea today".split()
    rows = [(5, " ".join(base)), (3, " ".join(base)), (3, " ".join(base)), (9, None), (8, ""), (7, "one two"), (None, " ".join(base)), (None, "alone among these words"), (1, "x " * 5000)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, fp string")
    out = simhash.near_duplicate_classes(docs).collect()
    want = brute_components([(d, simhash.fingerprint(t)) for d, t in rows])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in out), key=key) == sorted(((d, f"{simhash.fingerprint(t):016x}", c) for (d, t), c in zip(rows, want)), key=key)
    assert simhash.near_duplicate_classes(docs.limit(0)).count() == 0
