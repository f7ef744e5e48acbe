"""Personal data by weak supervision, in DataFrame functions only.

Base spans are found by four fixed patterns. Wider patterns propose further candidates
(local phone numbers, identity numbers, account numbers, obfuscated addresses, titled
names). Five labelers vote on every span: a strict format, a check digit or range, a
gazetteer, words that announce personal data just before it, and words that announce
something else. Expectation-maximisation estimates each labeler's reliability and each vote
pattern's probability from the counts of vote patterns over all documents (a table bounded by kinds
times patterns); a logistic classifier over votes, kind and length is then trained on those
probabilities and decides on the candidates. Base spans stay whatever the vote.

Spans are found without offsets from the regex engine: matches are fenced with control
characters, the text is split at the fences, and piece lengths add up to code point offsets.
The patterns cannot match the fences; where a text holds them, they are replaced one for one.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, OTHER = "\x01", "\x02", "\x03"
BASE = ("email", "ip", "card", "phone")
EXTRA = ("idnum", "localphone", "account", "hiddenmail", "name")
KINDS = BASE + EXTRA
#: The characters of a local part may only begin where a run of them begins, or where the last match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "idnum": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "localphone": r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "hiddenmail": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:[\[(]dot[\])]|\.)\x20?[A-Za-z0-9-]++){1,4}",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20\p{Lu}\p{Ll}{1,20}(?:\x20\p{Lu}\p{Ll}{1,20})?(?![\p{L}])",
}
#: A text without the trigger cannot match; most texts are dismissed by it.
TRIGGERS = {"email": "@", "ip": ".", "card": "", "phone": "+", "idnum": "-", "localphone": "", "account": "", "hiddenmail": "at", "name": ""}
QUICK = {"ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9]", "localphone": r"[0-9]{4}", "account": r"[A-Z]{2}[0-9]{2}", "name": r"Mr|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor"}
#: Words that announce personal data, and words that announce other numbers.
CUES = r"(?iu)\b(?:e-?mail|mail|phone|tel|telephone|call|mobile|cell|fax|contact|ssn|social security|passport|iban|account|card|credit|visa|ip|address|name|correo|teléfono|courriel|téléphone|telefon|konto|adresse|dear|hello)\b[^\p{L}]*$"
OTHER_CUES = r"(?iu)\b(?:version|isbn|issn|doi|order|invoice|part|section|figure|table|chapter|page|release|build|model|serial|rfc)\b[^\p{L}]*$"
#: Top-level domains and given names, fixed values.
DOMAINS = r"(?i)\.(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu|us|example)$"
GIVEN_NAMES = r"(?iu)\x20(?:james|mary|john|anna|peter|maria|robert|linda|michael|susan|david|sarah|jean|marie|pierre|sophie|hans|karl|juan|carlos|carmen|jose|lucia|emma|paul|laura)\b"


def prepared(text: Column) -> Column:
    """The text without fences; every code point keeps its place."""
    return F.translate(F.coalesce(text, F.lit("")), OPEN + CLOSE, OTHER + OTHER)


def bound(value: Column, fn) -> Column:
    """``fn(value)``, an array, with ``value`` computed once however often ``fn`` mentions it."""
    return F.flatten(F.transform(F.array(value), fn))


def running(values: Column, combine) -> Column:
    """Running totals of an array by doubling: ``combine(own, further left or null)`` is applied
    log2(size) times to every place, so a text with n matches takes n log n steps."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)))).cast("int"))
    back = lambda k: F.pow(F.lit(2), k).cast("int")
    return F.aggregate(steps, values, lambda t, k: F.transform(t, lambda x, i: combine(x, F.get(t, i - back(k)))))


def _plus(own: Column, left: Column) -> Column:
    return own + F.coalesce(left, F.lit(0))


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, value, before>> of the leftmost non-overlapping matches; end exclusive."""
    cast = "array<struct<start:int,end:int,value:string,before:string>>"
    pieces = F.split(F.regexp_replace(text, PATTERNS[kind], OPEN + "$0" + CLOSE), f"[{OPEN}{CLOSE}]", -1)

    def located(p: Column) -> Column:
        def one(ends: Column, i: Column) -> Column:
            return F.struct(
                F.get(ends, i - 1).alias("start"),
                F.get(ends, i).alias("end"),
                F.get(p, i).alias("value"),
                F.right(F.get(p, i - 1), F.lit(40)).alias("before"),
            )

        places = F.sequence(F.lit(1), F.size(p) - 2, F.lit(2))
        return bound(running(F.transform(p, lambda x: F.length(x)), _plus), lambda ends: F.transform(places, lambda i: one(ends, i)))

    found = bound(pieces, lambda p: F.when(F.size(p) > 2, located(p)).otherwise(F.array().cast(cast)))
    may = F.contains(text, F.lit(TRIGGERS[kind])) if TRIGGERS[kind] else F.lit(True)
    if kind in QUICK:
        may = may & F.rlike(text, F.lit(QUICK[kind]))
    return F.when(may, found).otherwise(F.array().cast(cast))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    def part(i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        doubled = F.when(d >= 5, d * 2 - 9).otherwise(d * 2)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + part(i)) % 10 == 0


def _mod97(value: Column) -> Column:
    """Account numbers leave 1: the first four characters go last, letters count from 10."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(v, 5, 1000), F.substring(v, 1, 4))

    def step(a: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def passes(kind: str, value: Column) -> Column:
    """What a base match must fulfil; a failing match is dropped."""
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: F.coalesce(x.try_cast("bigint") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def votes(kind: str, s: Column) -> Column:
    """Five votes: 1 personal data, -1 not, 0 no opinion."""
    value, before = s["value"], s["before"]
    yes_no = lambda c: F.when(c, 1).otherwise(-1)
    format_, check, gazetteer = F.lit(1), F.lit(0), F.lit(0)
    if kind in ("email", "hiddenmail"):
        gazetteer = F.when(F.rlike(value, F.lit(DOMAINS)), 1).otherwise(0)
        format_ = yes_no(F.length(value).between(6, 100))
    elif kind == "ip":
        check = yes_no(~F.rlike(value, F.lit(r"^(?:0|255)\.|^0+\.")))
        format_ = yes_no(F.length(value) <= 15)
    elif kind == "card":
        format_ = yes_no(F.rlike(value, F.lit(r"^[0-9]{14,19}$|^[0-9]{4}(?:[ -][0-9]{4}){3}$")))
        check = F.lit(1)
    elif kind == "phone":
        format_ = yes_no(F.rlike(value, F.lit(r"^\+[0-9]{1,3}[ .-]?(?:\([0-9]+\)[ .-]?)?[0-9][0-9 .-]+$")))
    elif kind == "idnum":
        format_ = F.lit(0)  # the pattern is the format: no evidence beside it
        check = yes_no(~F.rlike(value, F.lit(r"^(?:000|666|9)|-00-|-0000$")))
    elif kind == "localphone":
        format_ = yes_no(F.rlike(value, F.lit(r"^\([0-9]{3}\)|^([0-9]{3})[-.][0-9]{3}[-.]")))
    elif kind == "account":
        format_ = F.lit(0)
        check = yes_no(_mod97(value))
    elif kind == "name":
        gazetteer = F.when(F.rlike(value, F.lit(GIVEN_NAMES)), 1).otherwise(0)
        format_ = yes_no(F.rlike(value, F.lit(r" \p{Lu}\p{Ll}+ \p{Lu}")))
    cue = F.when(F.rlike(before, F.lit(CUES)), 1).otherwise(0)
    other = F.when(F.rlike(before, F.lit(OTHER_CUES)), -1).otherwise(0)
    return F.array(format_, check, gazetteer, cue, other).cast("array<int>")


SPAN = "array<struct<start:int,end:int,rank:int,kind:string,size:int,votes:array<int>>>"


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` with ``base`` and ``extra``: spans with their labelers' votes, by kind."""
    d = docs.select(*keep, prepared(docs["text"]).alias("_text"))

    def spans(kind: str) -> Column:
        found = F.filter(matches(F.col("_text"), kind), lambda s: passes(kind, s["value"]))
        one = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), F.least(F.lit(5), F.floor(F.length(s["value"]) / 6)).cast("int").alias("size"), votes(kind, s).alias("votes"))
        return F.transform(found, one).cast(SPAN)

    return d.select(*keep, *[spans(k).alias(f"_{k}") for k in KINDS]).select(
        *keep, F.concat(*[F.col(f"_{k}") for k in BASE]).alias("base"), F.concat(*[F.col(f"_{k}") for k in EXTRA]).alias("extra")
    )


@dataclass
class Model:
    reliability: dict  # labeler -> {(class, vote): probability}
    weights: dict[str, float]  # of the classifier's features

    def probability(self, s: Column) -> Column:
        """The classifier's probability that a span is personal data."""
        w = self.weights.get
        score = F.lit(w("bias", 0.0))
        for k in KINDS:
            score = score + F.when(s["kind"] == k, w(f"kind={k}", 0.0)).otherwise(0.0)
        for j in range(5):
            v = F.get(s["votes"], F.lit(j))
            score = score + F.when(v == 1, w(f"{j}=1", 0.0)).when(v == -1, w(f"{j}=-1", 0.0)).otherwise(0.0)
        for n in range(6):
            score = score + F.when(s["size"] == n, w(f"size={n}", 0.0)).otherwise(0.0)
        return 1 / (1 + F.exp(-score))


#: How often a labeler is believed right before its votes are seen; format alone says little.
PRIORS = (0.6, 0.8, 0.8, 0.8, 0.95)
#: The kinds a labeler can speak on, where not all.
SPEAKS_ON = {1: ("ip", "card", "idnum", "account"), 2: ("email", "hiddenmail", "name")}


def estimate(rows: list[tuple[str, tuple[int, ...], int, int]], rounds: int = 30) -> Model:
    """From (kind, votes, size, count) rows: labeler reliabilities by EM, then the classifier.

    A reliability is the rate of a vote among all spans of a class that the labeler can speak on, silent ones
    included, so a labeler that only ever votes one way is told apart from one that is always right. Silence is no evidence.
    """
    patterns: dict[tuple[str, tuple[int, ...]], float] = {}
    for kind, v, _, n in rows:
        patterns[kind, v] = patterns.get((kind, v), 0) + n
    labelers = range(5)
    believed = lambda j, y, v: PRIORS[j] if y == (v > 0) else 1 - PRIORS[j]
    rel = {j: {(y, v): believed(j, y, v) for y in (0, 1) for v in (-1, 1)} for j in labelers}
    share = {k: 0.5 for k in KINDS}
    logit = lambda p: math.log(p / (1 - p))
    ratio = lambda j, v: math.log(rel[j][1, v] / rel[j][0, v])
    posterior: dict = {}
    for _ in range(rounds):
        for kind, v in patterns:
            odds = logit(share[kind]) + sum(ratio(j, v[j]) for j in labelers if v[j])
            posterior[kind, v] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        for j in labelers:
            spoken = [(v[j], n, posterior[k, v]) for (k, v), n in patterns.items() if k in SPEAKS_ON.get(j, KINDS)]
            for y in (0, 1):
                mass = {x: sum(n * (p if y else 1 - p) for vote, n, p in spoken if vote == x) for x in (-1, 0, 1)}
                for x in (-1, 1):  # ten imagined votes keep a labeler that has said little at its first reliability
                    rel[j][y, x] = min(0.99, max(0.001, (mass[x] + 10 * believed(j, y, x)) / (sum(mass.values()) + 10)))
        for k in KINDS:
            n = sum(c for (kind, _v), c in patterns.items() if kind == k)
            on = sum(c * posterior[kind, v] for (kind, v), c in patterns.items() if kind == k)
            share[k] = min(0.9, max(0.1, (on + 5) / (n + 10)))
    features = lambda kind, v, size: ["bias", f"kind={kind}", f"size={size}", *(f"{j}={v[j]}" for j in labelers if v[j])]
    # training starts at the label model's own odds, or vote patterns that are rare among all would hardly be learned
    weights = {f"kind={k}": logit(share[k]) for k in KINDS} | {f"{j}={v}": ratio(j, v) for j in labelers for v in (-1, 1)}
    start = dict(weights)
    total = sum(n for *_, n in rows) or 1
    for _ in range(300):
        gradient: dict[str, float] = {}
        for kind, v, size, n in rows:
            x = features(kind, v, size)
            p = 1 / (1 + math.exp(-max(-50.0, min(50.0, sum(weights.get(f, 0.0) for f in x)))))
            for f in x:
                gradient[f] = gradient.get(f, 0.0) + n / total * (posterior[kind, v] - p)
        for f, g in gradient.items():
            weights[f] = weights.get(f, 0.0) + 2.0 * g - 1e-3 * (weights.get(f, 0.0) - start.get(f, 0.0))
    return Model(rel, weights)


def fit(found: DataFrame) -> Model:
    """From the output of :func:`candidates` over all documents; only counts of vote patterns reach the driver."""
    # outer, or the optimizer infers a filter that finds all spans a second time
    flat = found.select(F.explode_outer(F.concat("base", "extra")).alias("s")).filter("s is not null")
    counts = flat.groupBy("s.kind", "s.votes", "s.size").agg(F.count("*").alias("n"))
    return estimate([(r["kind"], tuple(r["votes"]), r["size"], r["n"]) for r in counts.collect()])


PLACED = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _by_place(spans: Column) -> Column:
    one = lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))
    return F.array_sort(F.transform(spans, one).cast(PLACED))


def _reach(spans: Column, counts) -> Column:
    """For each place the furthest end of the spans up to it that count; 0 where none does."""
    return running(F.transform(spans, lambda s: F.when(counts(s), s["end"]).otherwise(0)), F.greatest)


def _free(base: Column, extra: Column) -> Column:
    """The spans of ``extra`` that touch none of ``base``, by place; one pass from either side."""
    is_base = lambda s: s["rank"] < len(BASE)
    far = 2**31 - 1

    def chosen(spans: Column) -> Column:
        behind = _reach(spans, is_base)
        starts = F.transform(F.reverse(spans), lambda s: F.when(is_base(s), s["start"]).otherwise(far))
        ahead = F.reverse(running(starts, F.least))
        touched = lambda b, a, s, i: (F.get(b, i) > s["start"]) | (F.get(a, i) < s["end"])
        return bound(behind, lambda b: bound(ahead, lambda a: F.filter(spans, lambda s, i: ~is_base(s) & ~touched(b, a, s, i))))

    return bound(F.array_sort(F.concat(base, extra)), chosen)


def _alone(spans: Column) -> Column:
    """The spans, by place, that no earlier one touches."""
    every = lambda s: F.lit(True)
    return bound(spans, lambda a: bound(_reach(a, every), lambda r: F.filter(a, lambda s, i: F.coalesce(F.get(r, i - 1), F.lit(0)) <= s["start"])))


def with_spans(found: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Adds ``spans`` (base, and accepted candidates that touch no earlier span), by start, then kind."""
    accepted = F.filter("extra", lambda s: model.probability(s) >= threshold)
    placed = found.withColumn("base", _by_place(F.col("base")))
    more = F.when(F.size("extra") > 0, _alone(_free(F.col("base"), _by_place(accepted)))).otherwise(F.array().cast(PLACED))
    return placed.withColumn("extra", more).withColumn("spans", F.array_sort(F.concat("base", "extra")))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans share the first one's."""
    every = lambda s: F.lit(True)
    done = lambda reach, i: F.coalesce(F.get(reach, i - 1), F.lit(0))

    def part(reach: Column, s: Column, i: Column) -> Column:
        gap = F.substring(text, done(reach, i) + 1, F.greatest(F.lit(0), s["start"] - done(reach, i)))
        mark = F.when(s["start"] >= done(reach, i), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise("")
        return F.concat(gap, mark)

    def parts(reach: Column) -> Column:
        rest = F.substring(text, F.element_at(reach, -1) + 1, F.length(text))
        return F.concat(F.transform(spans, lambda s, i: part(reach, s, i)), F.array(rest))

    return F.when(F.size(spans) > 0, F.array_join(bound(_reach(spans, every), parts), "")).otherwise(text)
