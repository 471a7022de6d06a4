"""Which numbers of a block are also in another block, without shuffling a row per number.

Every block sends each bucket of the number range its own distinct numbers once, packed; the bucket answers with
those that at least two blocks have.  However often a number occurs, a block names it once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.wire import pack_sorted, unpack_sorted

ASK = "block long, bucket int, numbers binary"
REPLY = "block long, numbers binary"


def ask_rows(block: int, numbers: np.ndarray, buckets: int, bits: int) -> pa.RecordBatch:
    """One row per bucket of ascending distinct numbers below 2 ** ``bits``."""
    home = (numbers >> np.uint64(max(0, bits - 24))).astype(np.int64) * buckets >> min(bits, 24)
    places, firsts = np.unique(home, return_index=True)
    parts = np.split(numbers, firsts[1:]) if len(places) else []
    return pa.RecordBatch.from_pydict(
        {
            "block": pa.array([block] * len(places), pa.int64()),
            "bucket": pa.array(places, pa.int32()),
            "numbers": pa.array([pack_sorted(p) for p in parts], pa.binary()),
        }
    )


def _among(numbers: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which numbers are among ascending others, by bisection: short lists meet one that may be long."""
    if not len(others):
        return np.zeros(len(numbers), bool)
    return others[np.minimum(np.searchsorted(others, numbers), len(others) - 1)] == numbers


def _answer(rows: pa.Table) -> pa.Table:
    asked = [unpack_sorted(x) for x in rows.column("numbers").to_pylist()]
    found, times = np.unique(np.concatenate(asked), return_counts=True)
    shared = found[times > 1]
    hits = [x[_among(x, shared)] for x in asked]
    keep = [k for k, x in enumerate(hits) if len(x)]
    blocks = rows.column("block").to_pylist()
    return pa.table(
        {
            "block": pa.array([blocks[k] for k in keep], pa.int64()),
            "numbers": pa.array([pack_sorted(hits[k]) for k in keep], pa.binary()),
        }
    )


def answers(asks: DataFrame) -> DataFrame:
    """(block, numbers): of each asking block, the numbers that another block has too; several rows a block."""
    return asks.groupBy("bucket").applyInArrow(_answer, REPLY)


def batches_of(rows: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The values of some columns, row by row."""
    for batch in rows:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)
