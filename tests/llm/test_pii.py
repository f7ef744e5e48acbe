import random
import re

from pyspark.sql import functions as F
from weftline.llm import pii

FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The base spans by Python's own regex engine."""
    out = []
    for rank, (kind, form) in enumerate(FORMS.items()):
        for m in re.finditer(form, text or ""):
            d = [int(c) for c in m[0] if c.isdigit()]
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), rank, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, base string")
    c = pii.candidates(docs, ["doc_id"])
    return pii.with_spans(c, pii.fit(c)).select("doc_id", pii.spelled(F.col("base")).alias("b"), pii.spelled(F.col("spans")).alias("s")).collect()


def test_base_spans_equal_python(spark):
    rng = random.Random(7)
    parts = ["a@b.co", "x@", "_d@e.f", "1.2.3.4", "256.1.1.1", ".5.6.7.8", "4111 1111 1111 1111", "4111111111111111", "12-34", "+1 (555) 010-2345", "+", "(", " ", "\n", "é", "😀", "-", ".", "9", "\x01", "\x02x", "@c.d.e", "00.0.0255.1"]
    rows = [(i, "".join(rng.choice(parts) + rng.choice(["", " ", "9"]) for _ in range(rng.randint(1, 14)))) for i in range(400)]
    rows += [(500, None), (501, ""), (502, "a@" + "b." * 20000 + "c"), (503, "1 " * 6000), (504, "+" + "1-" * 5000), (504, "+" + "1-" * 5000)]
    got = found(spark, rows)
    assert sorted((r["doc_id"], r["b"]) for r in got) == sorted((d, plain(t)) for d, t in rows)


def test_added_spans(spark):
    rows = [(1, "My SSN: 123-45-6789 and mail jane (at) example dot com"), (2, "call (555) 010-2345 now"), (3, "see version 123-45-6789 of the part"), (4, "contact: bob [at] mail [dot] org"), (5, "nothing here"), (6, "IBAN: GB82 WEST 1234 5698 7654 32"), (7, "a@b.com 4111111111111111")]
    rows += [(10 + i, f"phone: ({200 + i}) 555-0100, ssn {100 + i}-45-67{10 + i}, mail a{i}@b.com") for i in range(20)]
    got = {r["doc_id"]: r["s"] for r in found(spark, rows)}
    assert "idnum:8:19" in got[1] and got[2] == "localphone:5:19" and got[5] == ""
    assert got[3] == ""
    assert got[4].startswith("hiddenmail:9:") and got[6].startswith("account:6:")
    assert got[7] == "email:0:7,card:8:24"


def test_redaction_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "😀 a@b.com, é +1 (555) 010-2345!"), (2, "plain"), (3, None)], "doc_id long, text string")
    c = pii.candidates(docs, ["doc_id", "text"])
    out = pii.with_spans(c, pii.fit(c)).select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("t")).orderBy("doc_id").collect()
    assert [r["t"] for r in out] == ["😀 [EMAIL], é [PHONE]!", "plain", None]
    assert pii.fit(c.limit(0)) is not None


def test_overlaps_and_redaction_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        base, extra = [], []
        for rank, out in ((0, base), (1, base), (5, extra), (7, extra)):
            at = 0
            while (at := at + rng.randint(0, 30)) < 60:
                end = at + rng.randint(1, 9)
                out.append((at, rank, end, pii.KINDS[rank]))
                at = end
        rows.append((i, base, extra))
    df = spark.createDataFrame(rows, f"id int, base {pii.PLACED}, extra {pii.PLACED}")
    text = "".join(chr(0x1F600 + i) if i % 7 == 0 else chr(97 + i % 26) for i in range(80))
    free = pii._alone(pii._free(F.col("base"), pii._by_place(F.col("extra"))))
    out = df.withColumn("free", free).withColumn("r", pii.redacted(F.lit(text), F.array_sort(F.concat("base", "free")))).collect()
    touch = lambda s, b: b[0] < s[2] and s[0] < b[2]
    for (_, base, extra), r in zip(rows, sorted(out)):
        kept = sorted(s for s in extra if not any(touch(s, b) for b in base))
        alone = [s for i, s in enumerate(kept) if not any(touch(s, b) for b in kept[:i])]
        assert [tuple(s) for s in r["free"]] == alone
        said, at = "", 0
        for start, _, end, kind in sorted(base + alone):
            said += text[at:start] if start >= at else ""
            said += f"[{kind.upper()}]" if start >= at else ""
            at = max(at, end)
        assert r["r"] == said + text[at:]


def test_many_matches_in_one_text(spark):
    text = "mail a@b.co 123-45-6789 " * 20000
    ((_, b, s),) = found(spark, [(1, text)])
    assert b.count(",") == 19999 and b.endswith(f":{24 * 19999 + 11}") and s.count("email") == 20000
