"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: Rows of a text column handed to Python code at a time.
TEXT_BATCH_ROWS = 512


def small_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = TEXT_BATCH_ROWS):
    """A mapInArrow function that applies ``fn`` to slices of at most ``rows`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield fn(batch.slice(at, rows))

    return run


#: Bytes of text handed to Python code at a time; a longer text comes alone.
TEXT_BATCH_BYTES = 4 << 20


def byte_batches(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: int, most: int = TEXT_BATCH_BYTES):
    """A mapInArrow function that applies ``fn`` to slices of at most ``most`` bytes in ``column``, or of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.nan_to_num(np.array(pc.binary_length(batch.column(column)).to_pylist(), np.float64)))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
                yield fn(batch.slice(at, to - at))
                at = to

    return run


#: Keys that may count as frequent at most.
FREQUENT = 1 << 18


def joined_by_frequency(rows: DataFrame, counts: DataFrame, key: str, frequency: str, total: int) -> list[DataFrame]:
    """``rows`` joined with ``counts`` (one row per key), in two parts whose union is the inner join.

    Keys met more than total/``FREQUENT`` times (``frequency``; all of them sum up to ``total``) number fewer than ``FREQUENT``, whatever the
    input, so these are broadcast and hot keys are never shuffled. The others are shuffled by key; none of them is hot.
    """
    often = F.col(frequency) > total / FREQUENT
    head, tail = counts.filter(often), counts.filter(~often)
    rare = rows.join(F.broadcast(head.select(key)), key, "left_anti")
    return [rows.join(F.broadcast(head), key), rare.join(tail, key)]


def broadcast_if(df: DataFrame, small: bool) -> DataFrame:
    """Broadcast ``df`` where its size has been checked; otherwise leave the join to shuffle."""
    return F.broadcast(df) if small else df
