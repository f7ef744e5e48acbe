"""Best-fit packing of tokenized documents into fixed-length sequences.

Bulk-synchronous best-fit over length classes. Pieces of one length are interchangeable, and so are sequences with equal gaps, so
documents and gaps are classes with counts, sorted by size together. A sweep matches a band of lengths with the gaps, each piece with its
successor, the smallest slot that still holds it; pieces that want the same gap are told apart by rank, gaps shrink, and the next sweep
follows until no gap takes a piece and sequences are opened. The classes are bounded by the capacity, not by the input, and their sweeps are one
short task. What grows with the input is spread over all: tokenizing, ranking the pieces of each length (in ``SALTS`` shares whose
counts are added up, for a class that holds a third of all pieces) and giving each its place and offset.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.tables import written
from .shared import TEXT_BATCH_ROWS, broadcast_if, small_batches

CAPACITY, END_ID = 2048, 0
SALTS = 256
#: White-space separated strings and word parts whose ids a worker remembers.
REMEMBERED = 700_000


class Tokenizer:
    """Ids of the lower-casing word BPE vocabulary, with a memory of words.

    White space separates and is dropped, so a text's ids are those of its words in turn.
    Words of Latin letters are encoded by merge rank (the vocabulary's ids are its merge
    order, the word end is one more byte); everything else goes through the ``tokenizers``
    library. Tests hold both against each other.
    """

    #: Fixed: the vocabulary file's own splitting pattern.
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    LATIN = regex.compile(r"[\x21-\x7eÀ-įı-ɏ]+")
    LETTERS = regex.compile(r"[a-zß-öø-ɏ]+")

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        as_byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
        ranks = {}
        for token, i in vocabulary.items():
            if not token.startswith("<|"):
                end = token.endswith("</w>") and token != "</w>"
                ranks[bytes(as_byte[c] for c in (token[:-4] if end else token)) + b"\xff" * end] = i
        ranks[b"\xff"] = 1 << 20  # never left alone: a word's last byte and its end are one symbol from the start
        self.by_rank = tiktoken.Encoding("word-bpe", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _part(self, part: str) -> bytes:
        out = self.parts.get(part)
        if out is None:
            if len(self.parts) >= REMEMBERED:
                self.parts.clear()
            out = np.array(self.by_rank(part.encode() + b"\xff"), "<u4").tobytes() if self.LETTERS.fullmatch(part) else self._library(part)
            self.parts[part] = out
        return out

    def _word(self, word: str) -> bytes:
        if self.LATIN.fullmatch(word):
            out = b"".join(map(self._part, self.PARTS.findall(word.lower())))
        else:
            out = self._library(word)
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        if len(word) <= 64:
            self.words[word] = out
        return out

    def ids(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split, not to the vocabulary's pattern
            return self._library(text)
        get = self.words.get
        return b"".join([get(w) or self._word(w) for w in text.split()])


_loaded: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """One per worker process and file."""
    if path not in _loaded:
        _loaded[path] = Tokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and its end id.

    Only documents of more than ``capacity`` ids are cut, into pieces of ``capacity``; the last
    may be shorter. A null text is empty: its end id alone. Repeated rows are cut alike.
    ``tokenizer_file`` is a path or the name of one of the installed public vocabularies.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        import os

        import public_tokenizers

        t = tokenizer(tokenizer_file if os.path.isabs(tokenizer_file) else public_tokenizers.path(tokenizer_file))
        end = np.array([END_ID], "<u4").tobytes()
        row, piece, start, length, crc, ids = [], [], [], [], [], []
        for i, text in enumerate(b.column(1).to_pylist()):
            data = t.ids(text or "") + end
            for k, at in enumerate(range(0, len(data), 4 * capacity)):
                part = data[at : at + 4 * capacity]
                row.append(i)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(np.frombuffer(part, "<u4").astype(np.int32).tolist())
        columns = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns, names = [*columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(small_batches(batch, TEXT_BATCH_ROWS), schema)


#: Gaps are offered to one band of lengths at a time, the longest first: (capacity/(k+1), capacity/k] for k up to
#: ``BANDS``, of which k fit one sequence whatever their lengths, then halves down to capacity/``LAST_BAND``, then the rest.
BANDS, LAST_BAND = 4, 32
#: Rows of the placement table that are broadcast at most.
BROADCAST_ROWS = 200_000
PLACEMENT = ("length", "rank_from", "rank_to", "first", "slot_from", "each", "sweep")


def bands(capacity: int) -> list[tuple[int, int]]:
    """(above, up to) lengths, from the longest down."""
    cuts = [capacity // k for k in range(1, BANDS + 1)]
    k = 2 * BANDS
    while k <= LAST_BAND:
        cuts.append(capacity // k)
        k *= 2
    cuts = sorted({c for c in cuts if c > 0}, reverse=True)
    return list(zip([*cuts[1:], 0], cuts))


class Sweeps:
    """Classes of gaps and pieces, matched sweep by sweep.

    ``runs`` are (gap, first sequence, how many) of sequences with equal gaps, ``left`` how many pieces of each length have no
    place yet, ``ranked`` how many have one. The rows of both are bounded by the capacity and the number of sweeps, not by the pieces.
    """

    def __init__(self, classes: dict[int, int], capacity: int):
        self.capacity, self.left, self.ranked = capacity, dict(classes), dict.fromkeys(classes, 0)
        self.runs: list[tuple[int, int, int]] = []
        self.opened, self.number = 0, 0
        self.placed: list[tuple[int, ...]] = []

    def sweep(self, above: int, longest: int, fresh: int = 0) -> int:
        """Matches pieces of lengths in (above, longest] with gaps, and with ``fresh`` new sequences; how many found a place.

        A gap offers as many slots as pieces of the longest length fit it, one at least. Gaps and pieces are sorted by size together. Pieces in turn, the
        longest first, take the smallest slot that still holds them: the last open one before them, as in a matching of parentheses. Pieces
        that want one gap are told apart by their rank. All gaps shrink at the end of the sweep.
        """
        runs = [(gap, first, n, max(1, gap // longest)) for gap, first, n in self.runs if gap > above]
        if fresh:
            runs.append((self.capacity, self.opened, fresh, max(1, self.capacity // longest)))
        size = lambda i: self.capacity + 1 if fresh and i == len(runs) - 1 else runs[i][0]
        order = sorted([(-size(i), 0, runs[i][1], i) for i in range(len(runs))] + [(-length, 1, 0, length) for length, n in self.left.items() if n and above < length <= longest])
        open_, taken, placed = [], [0] * len(runs), 0
        used: dict[int, tuple[int, int]] = {}  # sequences of a run that pieces of more than one length share, or that stay open: (gap, what it holds)
        shrunk = []
        self.number += 1
        for _, piece, _, i in order:
            if not piece:
                open_.append(i)
                continue
            while self.left[i] and open_:
                gap, first, n, each = runs[open_[-1]]
                at = taken[open_[-1]]
                many = min(self.left[i], n * each - at)
                self.placed.append((i, self.ranked[i], self.ranked[i] + many, first, at, each, self.number))
                self.ranked[i] += many
                self.left[i] -= many
                placed += many
                # whole sequences are one class again; the first and the last may be shared with other lengths
                up, down = -(-at // each), (at + many) // each
                if down > up:
                    shrunk.append((gap - each * i, first + up, down - up))
                parts = [(at // each, min(at + many, up * each) - at)] if at % each else []
                if (at + many) % each and down >= up:
                    parts.append((down, at + many - down * each))
                for sequence, pieces_ in parts:
                    used[first + sequence] = (gap, used.get(first + sequence, (gap, 0))[1] + pieces_ * i)
                taken[open_[-1]] = at + many
                if taken[open_[-1]] == n * each:
                    open_.pop()
        reached = {first: -(-t // each) for (_, first, _, each), t in zip(runs, taken)}
        kept = [(gap, first + reached.get(first, 0), n - reached.get(first, 0)) for gap, first, n in self.runs]
        if fresh:
            self.opened += reached[self.opened]
        self.runs = [r for r in [*kept, *shrunk, *((gap - held, at, 1) for at, (gap, held) in used.items())] if r[0] > 0 and r[2] > 0]
        return placed

    def run(self) -> list[tuple[int, ...]]:
        """All placements: bands of lengths from the longest down, in each sweeps until no gap takes a piece, then one that opens sequences."""
        for above, longest in bands(self.capacity):
            moved = True
            while own := {length: n for length, n in self.left.items() if n and above < length <= longest}:
                n, low, high = sum(own.values()), min(own), max(own)
                fit = self.capacity // high
                # as many as the pieces left need at least: no more than ``fit`` of them meet if all are longer than a (fit + 1)-th
                more = -(-n // fit) if low * (fit + 1) > self.capacity else -(-sum(x * k for x, k in own.items()) // self.capacity)
                opening = not moved or max((gap for gap, _, _ in self.runs), default=0) < low
                moved = bool(self.sweep(above, high, more if opening else 0))
        return self.placed


def placements(classes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Where the pieces of each class (length, n) go: (length, rank_from, rank_to, first, slot_from, each, sweep), a written table.

    The piece of rank r goes to sequence ``first + (slot_from + r - rank_from) div each``. Classes are one row per length: at most ``capacity``
    rows, whatever the input, so all sweeps run in one task, which a lost executor costs a few seconds.
    """

    def run(batches):
        given = [(x, n) for b in batches for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        if wrong := [x for x, _ in given if not 0 < x <= capacity]:
            raise ValueError(f"pieces of lengths {min(wrong)} to {max(wrong)} do not fit {capacity}")
        rows = Sweeps(dict(given), capacity).run()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(len(PLACEMENT))], names=list(PLACEMENT))

    return written(classes.select("length", "n").coalesce(1).mapInArrow(run, ", ".join(f"{c} long" for c in PLACEMENT)), "placements")


def best_fit(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to ``items`` (doc_id, piece, length and any other columns).

    ``items`` is a written table that is read three times; if it has a column ``_row`` that numbers its rows, that column ends here, else a numbered copy is
    written. Ties among pieces of one length are broken by that number, and repeated rows get places of their own. No rows, no sequences. Helper
    columns are named with a leading underscore, so columns called salt, rank or first pass through. Lengths that a third of all pieces have are ranked in ``SALTS`` shares.
    """
    if "_row" not in items.columns:
        items = written(items.withColumn("_row", F.monotonically_increasing_id()), "numbered-pieces")
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    shares = written(salted.groupBy("length", "_salt").agg(F.count("*").alias("n")), "length-shares")
    table = placements(shares.groupBy("length").agg(F.sum("n").alias("n")), capacity)
    table = table.select("length", *[F.col(c).alias(f"_{c}") for c in table.columns if c != "length"])
    before = shares.select("length", "_salt", (F.sum("n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_within", within).join(broadcast_if(before, capacity * SALTS <= 1 << 20), ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_within"))
    placed = ranked.join(broadcast_if(table, table.count() <= BROADCAST_ROWS), "length").filter("_rank >= _rank_from and _rank < _rank_to")
    slot = F.col("_slot_from") + F.col("_rank") - F.col("_rank_from")
    placed = placed.withColumn("sequence_id", (F.col("_first") + F.floor(slot / F.col("_each"))).cast("long")).withColumn("_slot", slot)
    filled = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("_sweep", "_slot").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.select(*[F.col(c) for c in items.columns if c != "_row"], "sequence_id", filled.cast("long").alias("offset"))


def packed_documents(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenize, cut and pack ``docs``: one row per piece with its sequence and offset."""
    return best_fit(written(pieces(docs, tokenizer_file, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces"), capacity)
