"""Fill-in-the-middle transformation by one scan of a byte automaton.

Texts of a batch are joined by a byte that no UTF-8 text holds and read once by a table-driven automaton over bytes.
Its tables are built from the sentinels: a state is the longest end of what was read that begins a sentinel, and
whether the last byte was a letter. Every transition carries what it counts: a code point begins (continuation bytes
begin none), a unit begins (a run of letters, or any other code point), a sentinel is complete. The state depends on the last few
bytes only, so the batch is cut into lanes that all advance by one byte a step, each warmed up on the bytes before it.
A second pass over the counted transitions turns unit numbers into byte cuts and code point counts.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import byte_batches

# Sentinels of prefix, suffix and middle, shares in percent of texts left plain and of suffix-first ones, the seed's text.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SUFFIX_FIRST_BELOW, SEED = 90, 20, "1"
UNIT, POINT, SENTINEL = 1, 2, 4
#: Parts the texts of a batch; not a byte of UTF-8.
BOUNDARY = 0xFF
#: Lanes that advance together.
LANES = 4096


@cache
def automaton(sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, np.ndarray, int]:
    """(next state, what is counted, both flat by 256 * state + byte; bytes that settle the state)."""
    words = [s.encode() for s in sentinels]
    begun = {w[:i] for w in words for i in range(len(w))}

    def longest(seen: bytes) -> bytes:
        return next(seen[i:] for i in range(len(seen) + 1) if seen[i:] in begun)

    number, states = {(b"", False): 0}, [(b"", False)]
    following, counted = [], []
    for begun_with, in_letters in states:  # grows as states are met
        for byte in range(256):
            letter = byte < 128 and chr(byte).isalpha()
            seen = begun_with + bytes([byte])
            to = (b"", False) if byte == BOUNDARY else (longest(seen), letter)
            if to not in number:
                number[to] = len(states)
                states.append(to)
            following.append(number[to])
            begins = byte != BOUNDARY and not 0x80 <= byte < 0xC0
            complete = any(seen.endswith(w) for w in words)
            counted.append(POINT * begins + UNIT * (begins and not (letter and in_letters)) + SENTINEL * complete)
    return np.array(following, np.int32) * 256, np.array(counted, np.uint8), max(map(len, words))


def scan(data: np.ndarray, sentinels: tuple[str, ...] = SENTINELS) -> np.ndarray:
    """What each byte of ``data`` counts."""
    following, counted, warm = automaton(sentinels)
    width = max(-(-len(data) // LANES), 4 * warm)
    lanes = -(-len(data) // width)
    padded = np.full(warm + lanes * width, BOUNDARY, np.uint8)
    padded[warm : warm + len(data)] = data
    out = np.empty((width, lanes), np.uint8)
    state = np.zeros(lanes, np.int32)
    for k in range(warm + width):
        at = state + padded[k : k + lanes * width : width]
        if k >= warm:
            out[k - warm] = counted[at]
        state = following[at]
    return out.T.reshape(-1)[: len(data)]


def _transformed(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [t.encode() for t in batch.column(1).to_pylist()]
    draws = np.array(batch.column(2).to_pylist(), np.int64).reshape(len(texts), 4)
    data = np.frombuffer(bytes([BOUNDARY]).join(texts), np.uint8)
    counts = scan(data)
    sizes = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(sizes + 1) - sizes - 1
    end = start + sizes
    units, points, complete = (np.flatnonzero(counts & kind) for kind in (UNIT, POINT, SENTINEL))
    first = np.searchsorted(units, start)
    n = np.searchsorted(units, end) - first
    plain = (sizes == 0) | (np.searchsorted(complete, end) > np.searchsorted(complete, start)) | (draws[:, 2] % 100 >= PLAIN_FROM)
    # second pass: the cuts' unit numbers to bytes; a cut after the last unit is the end
    bounded = np.append(units, len(data))
    cuts = [np.where(c < n, bounded[np.minimum(first + c, len(units))], end) for c in np.sort(draws[:, :2] % (n + 1)[:, None], axis=1).T]
    chars = [np.searchsorted(points, b) - np.searchsorted(points, a) for a, b in ((start, cuts[0]), (cuts[0], cuts[1]))]
    suffix_first = draws[:, 3] % 100 < SUFFIX_FIRST_BELOW
    before, after, between = (s.encode() for s in SENTINELS)
    form, output = [], []
    for i, text in enumerate(texts):
        a, b = int(cuts[0][i] - start[i]), int(cuts[1][i] - start[i])
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        if plain[i]:
            form.append("plain")
            output.append(text)
        elif suffix_first[i]:
            form.append("spm")
            output.append(b"".join((after, suffix, before, prefix, between, middle)))
        else:
            form.append("psm")
            output.append(b"".join((before, prefix, after, suffix, between, middle)))
    columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(form), *(pa.array(c, pa.int64(), mask=plain) for c in chars), pa.array(output, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transformed(docs: DataFrame) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each text with its middle moved to the end.

    A null text is empty, and empty texts are plain. Every row is decided by its own id and text: repeated rows give repeated
    results, rows of one id the same draws; a null id draws like an empty one. A tie of both cuts leaves an empty middle. Long
    texts are read whole, in a batch of their own. No rows, no rows; further columns end here, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)])
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), draws.alias("draws"))
    return given.mapInArrow(byte_batches(_transformed, 1), f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed. Texts with a sentinel are left plain, so the three in an output are its own."""
    part = lambda i: F.get(F.split(output, "|".join(SENTINELS), -1), F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
