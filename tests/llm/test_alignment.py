import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer
from weftline.llm import alignment
from weftline.operators.tables import written

A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


def brute_force(texts):
    """Per text: (n_a, n_b, groups, links), by marking byte offsets."""
    library = Tokenizer.from_file(public_tokenizers.path(A))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(B))
    a_bytes, b_bytes = alignment._sides(A, B)
    out = []
    for text in texts:
        if not text:
            out.append((0, 0, "", Counter()))
            continue
        a, b = library.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        if b"".join(b_bytes.token[i] for i in b) != (" " + text).encode():
            out.append((0, 0, "", Counter()))
            continue
        marks = [set(np.cumsum([len(side.token[i]) for i in ids]).tolist()) for side, ids in ((a_bytes, a), (b_bytes, b))]
        both, groups, links = sorted(marks[0] & marks[1]), [], Counter()
        ends = [np.cumsum([len(side.token[i]) for i in ids]).tolist() for side, ids in ((a_bytes, a), (b_bytes, b))]
        for low, high in zip([0, *both], both):
            of = [[i for i, e in zip(ids, end) if low < e <= high] for ids, end in zip((a, b), ends)]
            groups.append("|".join(",".join(map(str, x)) for x in of))
            links.update((x, y) for x in of[0] for y in of[1])
        out.append((len(a), len(b), ";".join(groups), links))
    return out


def test_against_marked_offsets(spark):
    rng = random.Random(12)
    alphabet = list("abcdefghij     \n\t.,'0123é中😀ß▁") + ["the ", "tion", "<|endoftext|>", "</s>", "<0x41>", "  ", "http"]
    texts = [None, "", " ", "▁", "a" * 9000, "\x00\x01", "<unk><s>", "中" * 300] + ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(400)]
    texts += [texts[20]] * 30 + ["".join(rng.choices("qxzjkv", k=9000)), "".join(rng.choices(alphabet, k=20000))]
    ids = [None, 5, 5] + list(range(10, 10 + len(texts) - 3))
    docs = spark.createDataFrame([(i, t, "links", 1) for i, t in zip(ids, texts)], "doc_id long, text string, groups string, row int").repartition(5)
    want = brute_force(texts)
    counts = Counter(p for w in want for p in w[3])
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(most.get(a, 0), n)
    expected = []
    for i, (n_a, n_b, groups, links) in zip(ids, want):
        best = sum(n for (a, b), n in links.items() if counts[a, b] == most[a])
        expected.append((i, n_a, n_b, groups.count(";") + 1 if groups else 0, sum(links.values()), groups, best, sum(n * counts[p] for p, n in links.items())))
    table = written(alignment.aligned(docs, A, B), "aligned")
    got = [tuple(r) for r in alignment.weighed(table).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))
    empty = written(alignment.aligned(docs.limit(0), A, B), "none")
    assert alignment.weighed(empty).count() == 0


def test_large_groups_count_equal_ids_first():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 9, 300).astype(np.int32), rng.integers(0, 7, 280).astype(np.int32)
    sizes = np.array([100, 1, 199]), np.array([100, 2, 178])
    group, pair, links = alignment._pairs(a, b, *sizes)
    got = Counter()
    for g, p, n in zip(group.tolist(), pair.tolist(), links.tolist()):
        got[g, p >> 32, p & 0xFFFFFFFF] += n
    want, at = Counter(), [0, 0]
    for g, (m, n) in enumerate(zip(*sizes)):
        want.update((g, x, y) for x in a[at[0] : at[0] + m].tolist() for y in b[at[1] : at[1] + n].tolist())
        at = [at[0] + m, at[1] + n]
    assert got == want


def test_rare_and_frequent_pairs_join_alike(spark, monkeypatch):
    from weftline.llm import shared

    docs = spark.createDataFrame([(i, f"common words {i} and number{i % 7}") for i in range(60)], "doc_id long, text string")
    table = written(alignment.aligned(docs, A, B), "aligned")
    columns = ("doc_id", "n_best", "count_sum")
    whole = sorted(map(tuple, alignment.weighed(table).select(*columns).collect()))
    monkeypatch.setattr(shared, "FREQUENT", 20)
    assert whole == sorted(map(tuple, alignment.weighed(table).select(*columns).collect()))
