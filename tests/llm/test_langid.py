import math
import random
import zlib
from collections import Counter

import numpy as np
from weftline.llm import langid

SAMPLES = {
    "en": "the house is by the river and the people who live there are happy with the weather this year",
    "de": "das haus steht am fluss und die menschen die dort wohnen sind mit dem wetter in diesem jahr zufrieden",
    "fr": "la maison est au bord de la rivière et les gens qui y vivent sont contents du temps de cette année",
}


def rows():
    out = []
    for k, (lang, text) in enumerate(SAMPLES.items()):
        w = text.split()
        out += [(1000 * k + i, " ".join(w[i % 5 : i % 5 + 9] + w[: i % 7]), lang) for i in range(60)]
    return out


def test_held_out_accuracy_and_edge_cases(spark):
    extra = [(9000, None, "en"), (9001, "", "en"), (9002, "12 34 ²", "de"), (None, "the people are happy", "xx"), (9003, "THE PEOPLE ARE HAPPY", None), (9003, "THE PEOPLE ARE HAPPY", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows() + extra], "doc_id long, text string, lang string, score double")
    out = langid.identify(docs.withColumn("held_out", langid.held_out(docs)), keep=["doc_id", "lang", "held_out"]).collect()
    test = [r for r in out if r["held_out"] and r["lang"] and r["doc_id"] < 9000]
    assert len(test) > 20 and sum(r["lang"] == r["lang_pred"] for r in test) / len(test) > 0.97
    by = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in out}
    assert by[9000] == by[9001] == by[9002] == ("und", 0.0)
    assert by[9003][0] == "en" and by[None][0] == "en"
    assert len(out) == docs.count() and all(0 <= r["score"] <= 1 for r in out)


def test_mixture(spark):
    docs = spark.createDataFrame([r for r in rows()], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert list(langid.infer(model, SAMPLES["de"])) == ["de"]
    mixed = langid.infer(model, SAMPLES["en"] + " " + SAMPLES["fr"])
    assert set(mixed) == {"en", "fr"} and all(0.3 < v < 0.7 for v in mixed.values())


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()] == [("und", 0.0)]
    assert langid.identify(docs.limit(0)).count() == 0


def by_hand(docs, texts):
    """The definition, one number at a time: counts, mixture, penalised sets."""
    counts = {}
    for _, text, lang in docs:
        for g in langid.trigrams(text).tolist():
            counts.setdefault(lang, Counter())[g] += 1
    names = sorted(counts)
    totals = {x: sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS for x in names}
    p = lambda x, g: float(np.float32(math.log((counts[x][g] + langid.SMOOTHING) / totals[x])))
    out = []
    for text in texts:
        grams = langid.trigrams(text).tolist()
        like = {x: [p(x, g) for g in grams] for x in names}
        best = max(names, key=lambda x: (sum(like[x]), -names.index(x)))

        def mixed(part, theta):
            for _ in range(langid.ROUNDS):
                share = dict.fromkeys(part, 0.0)
                for i in range(len(grams)):
                    whole = sum(theta[x] * math.exp(like[x][i]) for x in part)
                    for x in part:
                        share[x] += theta[x] * math.exp(like[x][i]) / whole
                theta = {x: v / len(grams) for x, v in share.items()}
            return theta, sum(math.log(sum(theta[x] * math.exp(like[x][i]) for x in part)) for i in range(len(grams)))

        theta, _ = mixed(names, dict.fromkeys(names, 1 / len(names)))
        order = [best, *sorted((x for x in names if x != best), key=lambda x: (-theta[x], x))]
        chosen, value = {best: 1.0}, sum(like[best])
        for k in range(2, len(order) + 1):
            start = {x: max(theta[x], 1e-6) for x in order[:k]}
            t, ll = mixed(order[:k], {x: v / sum(start.values()) for x, v in start.items()})
            if ll - value <= langid.PENALTY * math.log(len(grams) + 1):
                break
            chosen, value = t, ll
        out.append(chosen)
    return out


def test_against_the_definition(spark, monkeypatch):
    docs = [r for r in rows()]
    texts = [SAMPLES["de"], SAMPLES["en"] + " " + SAMPLES["fr"], " ".join(SAMPLES.values()), "the", "zzz qqq"]
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    for block in (1 << 20, 64):  # the second cuts every text into blocks
        monkeypatch.setattr(langid, "BLOCK", block)
        for got, want in zip((langid.infer(model, t) for t in texts), by_hand(docs, texts)):
            assert set(got) == set(want) and all(abs(got[x] - want[x]) < 1e-6 for x in want)


def test_three_hundred_languages(spark):
    rng = random.Random(4)
    words = {f"x{i:03d}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(12)] for i in range(300)}
    docs = [(k * 10 + j, " ".join(rng.choices(w, k=30)), lang) for k, (lang, w) in enumerate(words.items()) for j in range(3)]
    found = langid.identify(spark.createDataFrame([(*r, "taken", 0.5) for r in docs], "doc_id long, text string, lang string, lang_pred string, score double")).collect()
    taught = {lang for i, _, lang in docs if zlib.crc32(str(i).encode()) % 4 != 2}
    own = [r for r in found if r["lang"] in taught]
    assert len(found) == len(docs) and sum(r["lang"] == r["lang_pred"] for r in own) / len(own) > 0.97
