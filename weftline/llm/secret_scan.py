"""Secrets by fixed patterns and by a randomness test battery.

Three base patterns find assignments, access keys and hexadecimal strings. Every further
token of 16 or more key characters that holds a letter and a digit, or letters of both cases, is put through a battery
against the alphabet of its inferred encoding: chi-squared uniformity, a runs test around the
alphabet's middle and the lag-one serial correlation. Each statistic is placed among those of
``DRAWS`` random strings of the same length and alphabet (beyond ``EXACT`` characters among its
limiting distribution), and so is Fisher's sum of the three: the result is the probability of
being as uneven as this if random, uniform for keys, near 0 for words, paths and identifiers.

How much a low value says depends on length, so false discoveries are controlled per stratum
of encoding and length over the whole corpus: tokens above a cut estimate how many are random
(Storey), and the threshold is the smallest at which the estimated share of ordinary tokens among
those accepted stays within ``RATE``. A low cut counts ordinary tokens whose probability is high by
chance as random, a high one leaves few tokens to count, so the median over ``CUTS`` is taken. Strata
of fewer than ``LEAST`` tokens are judged by the counts of all lengths of their encoding, and where
these are few too, of all encodings.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.tables import written
from .shared import small_batches

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is matched whole; shorter runs fail either way
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Encodings from the narrowest to the widest: name, characters in order.
_LOW, _UP, _DIG = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: ``alpha52`` takes tokens of letters alone, of both cases; letters of one case are words too often, and digits alone numbers.
ENCODINGS = [(name, {c: i for i, c in enumerate(chars)}, re.compile(f"[{re.escape(chars)}]+")) for name, chars in [
    ("hex", _DIG + "abcdef"), ("HEX", _DIG + "ABCDEF"), ("base32", _UP + "234567"), ("lower36", _LOW + _DIG), ("upper36", _UP + _DIG), ("alpha52", _UP + _LOW),
    ("base62", _UP + _LOW + _DIG), ("base64", _UP + _LOW + _DIG + "+/"), ("base64url", _UP + _LOW + _DIG + "-_"), ("mixed66", _UP + _LOW + _DIG + "+/-_")]]
LENGTHS = (16, 20, 24, 32, 48, 64)
BINS, RATE, FLOOR = 100, 0.1, 0.01
#: Bins from which on tokens are counted to estimate the random ones.
CUTS = range(50, 91, 5)
LEAST = 30
#: Random strings drawn for each length and alphabet up to ``EXACT`` characters, from a fixed seed.
DRAWS, EXACT = 2000, 128


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def statistics(values: np.ndarray, size: int) -> np.ndarray:
    """Rows of symbols 0..size-1 to rows of (chi-squared, deviation of the runs, serial correlation), unevenness upward."""
    rows, n = values.shape
    counts = np.zeros((rows, size))
    np.add.at(counts, (np.arange(rows)[:, None], values), 1)
    chi2 = (counts * counts).sum(axis=1) * size / n - n
    high = 2 * values >= size
    a = high.sum(axis=1).astype(float)
    b = n - a
    mean = 1 + 2 * a * b / n
    var = np.maximum(2 * a * b * (2 * a * b - n) / (n * n * max(1, n - 1)), 1e-9)
    runs = np.where((a > 0) & (b > 0), np.abs(1 + (high[:, 1:] != high[:, :-1]).sum(axis=1) - mean) / np.sqrt(var), np.inf)
    centred = values - values.mean(axis=1, keepdims=True)
    spread = (centred * centred).sum(axis=1)
    r = (centred[:, 1:] * centred[:, :-1]).sum(axis=1) / np.where(spread > 0, spread, 1)
    return np.column_stack((chi2, runs, np.where(spread > 0, np.abs(r + 1 / n), np.inf)))


@lru_cache(maxsize=1024)
def _null(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The three statistics of random strings, each sorted, and Fisher's sums, sorted."""
    drawn = statistics(np.random.default_rng([n, size]).integers(0, size, (DRAWS, n)), size)
    ordered = np.sort(drawn, axis=0)
    sums = -sum(np.log(_among(ordered[:, i], drawn[:, i])) for i in range(3))
    return ordered, np.sort(sums)


def _among(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The share of drawn values at least as large, ties counted half, never 0."""
    above, at_least = len(ordered) - np.searchsorted(ordered, x, side="right"), len(ordered) - np.searchsorted(ordered, x, side="left")
    return ((above + at_least) / 2 + 0.5) / (len(ordered) + 1)


def battery(values: list[int], size: int) -> tuple[float, float, float]:
    """p-values of uniformity, runs and serial correlation for symbols 0..size-1."""
    n = len(values)
    found = statistics(np.array([values]), size)[0]
    if n <= EXACT:
        ordered = _null(n, size)[0]
        return tuple(float(_among(ordered[:, i], found[i])) for i in range(3))
    z = (found[0] - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n)
    return _tail(z), 2 * _tail(found[1]), 2 * _tail(found[2] * math.sqrt(n))


def joint(ps: tuple[float, ...], n: int, size: int) -> float:
    """The p-value of Fisher's sum: among those of random strings, or in chi-squared with two degrees per test."""
    x = -sum(math.log(max(p, 1e-300)) for p in ps)
    if n <= EXACT:
        return float(_among(_null(n, size)[1], np.array(x)))
    term = total = 1.0
    for i in range(1, len(ps)):
        term *= x / i
        total += term
    return math.exp(-x) * total


def judged(token: str) -> tuple[str, int, float] | None:
    """(encoding, length class, probability) of a token; None without a letter and a digit, or letters of both cases."""
    body = token.rstrip("=")
    if not any(c.isalpha() for c in body) or not (any(c.isdigit() for c in body) or (body.isalpha() and body.lower() != body != body.upper())):
        return None
    for name, at, whole in ENCODINGS:
        if whole.fullmatch(body):
            return name, sum(len(body) >= x for x in LENGTHS), joint(battery([at[c] for c in body], len(at)), len(body), len(at))
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), ordered."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tested(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per input row: id, ``base`` spans and all tested ``tokens`` with their stratum and
    p; ``free`` tells tokens that no base span touches."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    token = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("length", pa.int32()), ("p", pa.float64()), ("free", pa.bool_())])

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        bases, tokens = [], []
        for text in b.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            own = []
            for m in TOKEN.finditer(text):
                if j := judged(m[0]):
                    free = not any(a < m.end() and m.start() < e for a, _, e in base)
                    own.append({"start": m.start(), "end": m.end(), "encoding": j[0], "length": j[1], "p": j[2], "free": free})
            bases.append([{"start": a, "kind": k, "end": e} for a, k, e in base])
            tokens.append(own)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(bases, pa.list_(span)), pa.array(tokens, pa.list_(token))], names=[id_col, "base", "tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, base array<struct<start:int,kind:int,end:int>>, tokens array<struct<start:int,end:int,encoding:string,length:int,p:double,free:boolean>>"
    return docs.select(id_col, "text").mapInArrow(small_batches(batch), schema)


def limits(strata: dict[tuple[str, int], list[int]]) -> dict[tuple[str, int], float]:
    """The threshold of each stratum from all strata's histograms."""
    out = {}
    for (encoding, length), own in strata.items():
        n = own
        if sum(n) < LEAST:
            n = [sum(x) for x in zip(*(v for (e, _), v in strata.items() if e == encoding))]
        if sum(n) < LEAST:
            n = [sum(x) for x in zip(*strata.values())]
        random = median(sum(n[cut:]) / (1 - cut / BINS) for cut in CUTS)
        above = 0
        for i in range(BINS - 1, -1, -1):
            above += n[i]
            t = i / BINS
            if above and max(0.0, above - random * (1 - t)) / above <= RATE:
                out[encoding, length] = max(FLOOR, t)
    return out


def thresholds(found: DataFrame) -> dict[tuple[str, int], float]:
    """Per stratum the smallest p that a token must reach; strata without one accept nothing.

    Only histograms reach the driver: encodings x length classes x ``BINS`` rows at most.
    """
    flat = found.select(F.explode_outer("tokens").alias("t")).filter("t is not null")
    bins = flat.groupBy("t.encoding", "t.length", F.least(F.lit(BINS - 1), F.floor(F.col("t.p") * BINS)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    strata: dict[tuple[str, int], list[int]] = {}
    for r in bins.collect():
        strata.setdefault((r["encoding"], r["length"]), [0] * BINS)[r["bin"]] = r["n"]
    return limits(strata)


def secrets(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, ``base`` and ``spans`` (start, kind number, end), by start, then kind.

    A null text is empty. Repeated rows are scanned alike and counted alike; other columns are ignored, whatever
    their names. Texts are scanned whole, in time proportional to their length; a batch holds ``TEXT_BATCH_ROWS`` of them.
    Tied probabilities are decided alike. No rows, no rows.
    """
    found = written(tested(docs), "secret-tests")
    limits = thresholds(found)
    table = F.create_map(F.lit(""), F.lit(2.0), *[x for (e, n), t in sorted(limits.items()) for x in (F.lit(f"{e}:{n}"), F.lit(t))])
    enough = lambda t: t["p"] >= F.coalesce(F.try_element_at(table, F.concat_ws(":", t["encoding"], t["length"].cast("string"))), F.lit(2.0))
    added = F.transform(F.filter("tokens", lambda t: t["free"] & enough(t)), lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", added.cast("array<struct<start:int,kind:int,end:int>>"))).alias("spans"))


def spelled(spans):
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
