"""Alignment of two tokenizers over the same texts.

Token ends of tokenizer B are a static interval index: its intervals are sorted and disjoint, so the B tokens that an A token
overlaps are found by bisection. A gap between two A tokens that no B token spans ends a group of tokens. Tokens of
A and B in one group are linked; how many documents link two ids tells which ids stand for each other.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.tables import written
from .shared import byte_batches, joined_by_frequency

#: Bytes of text aligned at a time: tokens, their pairs and their spelling take some hundred bytes for each.
BATCH_BYTES = 1 << 20
#: Links of one group that are listed pair by pair at most; in larger groups equal ids are counted first.
LISTED = 4096
LINKS = "array<struct<a:int,b:int,n:bigint>>"


class _Side:
    """Bytes and decimal text of each id of one tokenizer."""

    def __init__(self, token: list[bytes]):
        self.token = token
        self.length = np.array([len(t) for t in token], np.int64)
        self.text = np.array([f"{i}{mark}" for mark in ",|;" for i in range(len(token))], object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join([self.token[i] for i in ids])


class _Bytes(_Side):
    """A byte-level vocabulary file. Its ids are in the order of its merges, so they are encoded by rank."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        # the printable stand-ins of byte-level vocabularies: a byte that prints is itself, the others follow from 256
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*printable}))}
        token = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            token[i] = bytes(as_byte[c] for c in entry)
        super().__init__(token)
        special = {i for entry, i in vocabulary.items() if entry.startswith("<|") and entry.endswith("|>")}
        ranks = {t: i for i, t in enumerate(token) if i not in special}
        self.encode = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class _Pieces(_Side):
    """A sentencepiece model, which puts a space before a text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        bare = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(bare)])

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text[1:], num_threads=1)


@cache
def _sides(a_file: str, b_file: str) -> tuple[_Side, _Side]:
    """One pair per worker process."""
    import public_tokenizers

    at = lambda f: f if os.path.isabs(f) else public_tokenizers.path(f)
    return _Bytes(at(a_file)), _Pieces(at(b_file))


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the one after the last B token that each A token overlaps. Both partition the same bytes."""
    a_start = np.concatenate(([0], a_end[:-1]))
    b_start = np.concatenate(([0], b_end[:-1]))
    return np.searchsorted(b_end, a_start, "right"), np.searchsorted(b_start, a_end, "left")


def _pairs(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, pair of ids as one number, links) of groups of ``n_a`` and ``n_b`` consecutive tokens."""
    first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    size = n_a * n_b
    listed = np.flatnonzero(size <= LISTED)
    group = np.repeat(listed, size[listed])
    within = np.arange(len(group)) - np.repeat(np.cumsum(size[listed]) - size[listed], size[listed])
    left = a[first_a[group] + within // n_b[group]].astype(np.int64)
    right = b[first_b[group] + within % n_b[group]]
    groups, pairs, links = [group], [left << 32 | right], [np.ones(len(group), np.int64)]
    for g in np.flatnonzero(size > LISTED):
        left, times = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        right, again = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        pairs.append((left.astype(np.int64)[:, None] << 32 | right).ravel())
        links.append(np.outer(times, again).ravel())
        groups.append(np.full(len(pairs[-1]), g))
    return np.concatenate(groups), np.concatenate(pairs), np.concatenate(links)


def _aligned(batch: pa.RecordBatch, a_file: str, b_file: str) -> pa.RecordBatch:
    side_a, side_b = _sides(a_file, b_file)
    ids_a, ids_b = [], []
    for text in batch.column(2).to_pylist():
        given = " " + text
        a, b = (side_a.encode(given), side_b.encode(given)) if text else ([], [])
        data = given.encode()
        if text and not (side_a.joined(a) == data and side_b.joined(b) == data):
            a, b = [], []
        ids_a.append(a)
        ids_b.append(b)
    rows = len(ids_a)
    in_a, in_b = (np.array([len(x) for x in ids], np.int64) for ids in (ids_a, ids_b))
    a, b = (np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in ids)]) for ids in (ids_a, ids_b))
    end_a, end_b = np.cumsum(side_a.length[a]), np.cumsum(side_b.length[b])
    low, high = overlaps(end_a, end_b) if len(a) else (np.zeros(0, np.int64),) * 2
    last = np.append(high[:-1] <= low[1:], True)[: len(a)]  # the gap behind an A token is not spanned; ends of texts never are
    at = np.flatnonzero(last)
    n_a, n_b = np.diff(at, prepend=-1), np.diff(high[at], prepend=0)
    row_of_group = np.searchsorted(np.cumsum(in_a), at, "right")
    n_groups = np.bincount(row_of_group, minlength=rows)
    n_links = np.bincount(row_of_group, (n_a * n_b).astype(np.float64), rows).astype(np.int64)

    group_a, group_b = np.repeat(np.arange(len(at)), n_a), np.repeat(np.arange(len(at)), n_b)
    sep_a = last.astype(np.int64)
    sep_b = np.zeros(len(b), np.int64)
    sep_b[np.cumsum(n_b) - 1] = 2
    spelled = np.empty(len(a) + len(b), object)
    spelled[np.arange(len(a)) + (np.cumsum(n_b) - n_b)[group_a]] = side_a.text[sep_a * len(side_a.token) + a]
    spelled[np.arange(len(b)) + np.cumsum(n_a)[group_b]] = side_b.text[sep_b * len(side_b.token) + b]
    ends = np.cumsum(in_a + in_b)
    groups = ["".join(spelled[e - n : e].tolist())[:-1] for e, n in zip(ends.tolist(), (in_a + in_b).tolist())]

    of_group, pair, links = _pairs(a, b, n_a, n_b)
    row = row_of_group[of_group]
    order = np.argsort(row, kind="stable")
    row, pair, links = row[order], pair[order], links[order]
    bounds = np.searchsorted(row, np.arange(rows + 1))
    kept, summed, offsets = [], [], [0]
    for i in range(rows):
        p, n = pair[bounds[i] : bounds[i + 1]], links[bounds[i] : bounds[i + 1]]
        by = np.argsort(p, kind="stable")
        p, n = p[by], n[by]
        starts = np.flatnonzero(np.append(True, p[1:] != p[:-1])[: len(p)])
        kept.append(p[starts])
        summed.append(np.add.reduceat(n, starts) if len(p) else n)
        offsets.append(offsets[-1] + len(starts))
    p = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    n = np.concatenate(summed) if summed else np.zeros(0, np.int64)
    entries = pa.StructArray.from_arrays([pa.array((p >> 32).astype(np.int32)), pa.array((p & 0xFFFFFFFF).astype(np.int32)), pa.array(n)], names=["a", "b", "n"])
    columns = [batch.column(0), batch.column(1), pa.array(in_a), pa.array(in_b), pa.array(n_groups.astype(np.int64)), pa.array(n_links), pa.array(groups), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)]
    return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups", "links"])


def aligned(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups, links) of each text with a space before it.

    ``groups`` spells the groups in order, ids of A and of B (``a1,a2|b1;a3|b2,b3``); ``links`` has each linked pair of ids once with its
    number of links. Null and empty texts, and texts whose tokens do not spell them, have no tokens. ``row`` tells apart repeated
    rows and ids; null ids stay. Long texts come in a batch of their own. No rows, no rows; further columns end here.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    given = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    batches = byte_batches(lambda b: _aligned(b, a_file, b_file), 2, BATCH_BYTES)
    return given.mapInArrow(batches, f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, links {LINKS}")


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, count, best): in how many rows of ``links`` (row, pair) each pair stands, and whether no pair of its A id stands in more."""
    counts = written(links.groupBy("pair").agg(F.count("*").alias("count")), "pair-counts")
    a = F.shiftright("pair", 32)
    most = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return written(counts.withColumn("a", a).join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair-weights")


def weighed(table: DataFrame) -> DataFrame:
    """Adds n_best and count_sum to a written table of :func:`aligned` (row and links at least), which is read four times; links end here.

    A pair's count is the number of rows that link it. ``n_best``: links whose count is the highest of their A id, ties
    included. ``count_sum``: the counts of all links. Rows without links have 0 for both. Pairs that very many rows link are broadcast, the
    others shuffled (:func:`weftline.llm.shared.joined_by_frequency`).
    """
    links = table.select("row", F.inline("links")).select("row", F.shiftleft(F.col("a").cast("long"), 32).bitwiseOR(F.col("b").cast("long")).alias("pair"), "n")
    counts = pair_counts(links)
    total = counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n")).first()["n"]
    best = F.sum(F.when(F.col("best"), F.col("n")).otherwise(F.lit(0).cast("long"))).alias("n_best")
    parts = [p.groupBy("row").agg(best, F.sum(F.col("n") * F.col("count")).alias("count_sum")) for p in joined_by_frequency(links, counts, "pair", "count", total)]
    sums = parts[0].unionByName(parts[1]).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return table.drop("links").join(sums, "row", "left").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})
