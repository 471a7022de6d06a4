"""Listings gathered to blocks: texts compressed in one value, other columns beside them.

Blocks are cut from the rows of one partition in their order, so a block's size is bounded (but for a single longer
text) and no key can be hot.  They are shuffled by block number once; every later use reads that layout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.wire import pack_numbers, squeeze, unpack_numbers, unsqueeze

#: Text bytes after which a block is closed.
BLOCK_BYTES = 8 << 20

BLOCK = "block long, ids binary, lengths binary, text binary, rest binary"


def pack_ids(ids: list[int | None]) -> bytes:
    """Ids, and which of them are null."""
    known = np.array([i is not None for i in ids])
    return np.packbits(known).tobytes() + np.array([i or 0 for i in ids], "<i8").tobytes()


def unpack_ids(data: bytes, count: int) -> list[int | None]:
    known = np.unpackbits(np.frombuffer(data, np.uint8)[: -8 * count], count=count)
    return [i if k else None for i, k in zip(np.frombuffer(data[-8 * count :], "<i8").tolist(), known, strict=True)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    ids, texts, held, rest = [], [], 0, []

    def block() -> pa.RecordBatch:
        row = {
            "ids": pack_ids(ids),
            "lengths": pack_numbers(np.array(list(map(len, texts)))),
            "text": squeeze(b"".join(texts)),
            "rest": b"",
        }
        if rest[0].num_columns:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rest[0].schema) as writer:
                for part in rest:
                    writer.write_batch(part)
            row["rest"] = squeeze(sink.getvalue().to_pybytes())
        columns = {name: pa.array([x], pa.binary()) for name, x in row.items()}
        return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), **columns})

    for batch in batches:
        others = batch.select(range(2, batch.num_columns))
        first = 0
        for n, (id_, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), strict=True), 1):
            ids.append(id_)
            texts.append((text.as_py() or "").encode())
            held += len(texts[-1])
            if held >= BLOCK_BYTES:
                rest.append(others.slice(first, n - first))
                yield block()
                number, ids, texts, held, rest, first = number + 1, [], [], 0, [], n
        if first < batch.num_rows:
            rest.append(others.slice(first))
    if ids:
        yield block()


def _chosen(listings: DataFrame, rest: bool) -> DataFrame:
    columns = [F.col("id").cast("long").alias("id"), F.col("description").cast("string").alias("description")]
    others = [F.col(f"`{c}`") for c in listings.columns if c not in ("id", "description")] if rest else []
    return listings.select(*columns, *others)


def blocks(listings: DataFrame, rest: bool = False) -> DataFrame:
    """Blocks of ``id`` and ``description``, with the other columns if ``rest``, shuffled by their numbers.

    One shuffle serves all uses in one job.  Block and row numbers follow from the partitions of ``listings``:
    whoever uses them in several jobs needs listings that are read alike each time, that is, a stored table and
    not the unordered result of a shuffle.
    """
    return cut(listings, rest).repartition("block")


def cut(listings: DataFrame, rest: bool = False) -> DataFrame:
    """The same blocks where the rows lie."""
    return _chosen(listings, rest).mapInArrow(_cut, BLOCK)


def opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A block's bytes and the length of each text."""
    return np.frombuffer(unsqueeze(row["text"]), np.uint8), unpack_numbers(row["lengths"]).astype(np.int64)


def texts_of(row: dict) -> list[str]:
    data, lengths = unsqueeze(row["text"]), unpack_numbers(row["lengths"]).tolist()
    ends = np.cumsum([0, *lengths]).tolist()
    return [data[a:b].decode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def rest_of(row: dict) -> pa.Table | None:
    return pa.ipc.open_stream(unsqueeze(row["rest"])).read_all() if row["rest"] else None
