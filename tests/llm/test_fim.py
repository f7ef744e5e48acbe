import hashlib
import random
import re

import numpy as np
from weftline.llm import fim


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in fim.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_the_definition(spark):
    rng = random.Random(11)
    alphabet = list("abcPSMZ<<>>  \n\t0.é߿ࠀ中😀\x00\x7f")
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 40)))) for i in range(1500)]
    rows += [(2000, None), (2001, ""), (2002, "<"), (2003, "a<P"), (2004, "x<S>y"), (2005, "<<M>"), (7, "again and again"), (7, "again and again"), (None, "no id here"), (None, None)]
    rows += [(3000 + i, "".join(rng.choices(alphabet, k=60000))) for i in range(2)] + [(3010 + i, "word " * 400000 + "é") for i in range(3)]
    docs = spark.createDataFrame([(*r, "taken", 5) for r in rows], "doc_id long, text string, form string, n int").repartition(3)
    out = fim.transformed(docs).withColumn("restored", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    assert sorted(map(repr, (tuple(r)[:6] for r in out))) == sorted(map(repr, (expected(*r) for r in rows)))
    assert sorted((r["restored"] for r in out)) == sorted(t or "" for _, t in rows)
    assert {r["form"] for r in out} == {"plain", "psm", "spm"}
    assert fim.transformed(docs.limit(0)).count() == 0


def test_lanes_meet_where_they_should():
    rng = random.Random(12)
    data = "".join(rng.choices("<PSM>ab é中", k=200_000)).encode()
    got = fim.scan(np.frombuffer(data, np.uint8))
    following, counted, _ = fim.automaton()
    state, want = 0, []
    for b in data:
        want.append(counted[state + b])
        state = following[state + b]
    assert np.array_equal(got, np.array(want, np.uint8))
    assert (got & fim.SENTINEL > 0).sum() == len(re.findall(b"<[PSM]>", data))
