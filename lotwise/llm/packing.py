"""Vector bin packing of tokenised listings into training sequences.

Each example needs tokens, one segment and loss-bearing tokens; a sequence has a limit on each.
The open sequence takes, of the examples that fit in every dimension, the one whose demand has the
largest dot product with what is left of the limits (both as shares of them).  Where nothing fits
any more the rest is filled by cutting an example, and a sequence that must stay shorter ends at a
power of two, its remainder going back to the waiting examples: so no sequence needs padding.

Every partition packs the rows it holds, with a window of waiting examples; nothing is shuffled or
gathered, and at most a handful of short sequences per partition remain.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.wire import gives_back

PIECE = "id long, start long, length long, token_ids array<int>, total_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence, each at least 1; ``window`` is the number of examples that wait for a place."""

    max_tokens: int = 4096
    max_segments: int = 64
    max_loss_tokens: int = 4096
    window: int = 512

    def __post_init__(self):
        if min(self.max_tokens, self.max_segments, self.max_loss_tokens, self.window) < 1:
            raise ValueError("every limit is at least 1")


@dataclass
class _Example:
    """What is left of a listing: ``ids[start:]`` up to ``stop``; loss is borne from ``loss_from`` on."""

    id: int | None
    ids: np.ndarray
    loss_from: int
    start: int
    stop: int

    def loss(self) -> int:
        return self.stop - min(self.stop, max(self.start, self.loss_from))

    def head(self, n: int) -> _Example:
        """The first ``n`` tokens, taken away from this example."""
        piece = _Example(self.id, self.ids, self.loss_from, self.start, self.start + n)
        self.start += n
        return piece


class _Packer:
    def __init__(self, limits: Limits):
        self.limits = limits
        self.demand = np.zeros((limits.window, 3))  # tokens, segments, loss-bearing tokens; no tokens: no example
        self.waiting: list[_Example | None] = [None] * limits.window
        self.free = list(range(limits.window))
        self.returned: list[_Example] = []
        self.open: list[_Example] = []

    def put(self, example: _Example) -> None:
        slot = self.free.pop()
        self.waiting[slot] = example
        self.demand[slot] = example.stop - example.start, 1, example.loss()

    def left(self) -> np.ndarray:
        used = [sum(x.stop - x.start for x in self.open), len(self.open), sum(x.loss() for x in self.open)]
        return np.array([self.limits.max_tokens, self.limits.max_segments, self.limits.max_loss_tokens]) - used

    def settle(self, slot: int) -> None:
        """Frees a slot whose example is used up, else notes what is left of it."""
        example = self.waiting[slot]
        if example.start == example.stop:
            self.waiting[slot] = None
            self.free.append(slot)
            self.demand[slot] = 0
        else:
            self.demand[slot] = example.stop - example.start, 1, example.loss()

    def close(self) -> list[_Example]:
        """The open sequence, ended at a power of two unless it is full; the remainder waits again."""
        pieces, self.open = self.open, []
        total = sum(x.stop - x.start for x in pieces)
        keep = total if total == self.limits.max_tokens else 1 << (total.bit_length() - 1)
        kept = []
        for piece in pieces:
            n = min(keep, piece.stop - piece.start)
            if n:
                kept.append(piece.head(n))
                keep -= n
            if piece.start < piece.stop:
                self.returned.append(piece)
        return kept

    def run(self, examples: Iterator[_Example]) -> Iterator[list[_Example]]:
        most = np.array([self.limits.max_tokens, self.limits.max_segments, self.limits.max_loss_tokens], dtype=float)
        more = True
        left = self.left()
        while True:
            while self.free and (self.returned or more):
                example = self.returned.pop() if self.returned else next(examples, None)
                if example is None:
                    more = False
                elif example.start < example.stop:
                    self.put(example)
            if len(self.free) == self.limits.window:
                if not self.open:
                    return
                yield self.close()
                left = self.left()
                continue
            if left[0] and left[1]:
                fits = (self.demand <= left).all(axis=1) & (self.demand[:, 0] > 0)
                slot = int(np.argmax(np.where(fits, (self.demand / most) @ (left / most), -1.0)))
                if not fits[slot]:
                    slot = int(np.argmax(self.demand[:, 0]))
                example = self.waiting[slot]
                free_of_loss = max(0, example.loss_from - example.start)
                n = int(min(example.stop - example.start, left[0], free_of_loss + left[2]))
                if n:
                    piece = example.head(n)
                    self.open.append(piece)
                    left = left - [n, 1, piece.loss()]
                    self.settle(slot)
                    if left[0]:
                        continue
            yield self.close()
            left = self.left()


def pack_listings(encoded: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Pieces of tokenised listings laid into sequences.

    ``encoded`` has ``id``, ``token_ids`` and, if the first tokens of a listing bear no loss (its heading
    as the instruction, its description as the answer), ``loss_from``: the first position that does; null or
    absent is 0.  Returns (id, start, length, token_ids, total_tokens, sequence_id, offset), one row per piece:
    every token of every row lies in exactly one piece, ``offset`` runs without gaps from 0 in each sequence,
    and each sequence keeps all limits and has ``max_tokens`` or a power of two of tokens.

    A null or empty list makes no piece; null tokens count as 0; repeated rows and null ids are packed like any
    other row; other columns are not read.  ``sequence_id`` is unique within one run; which rows share a
    sequence follows from the partitioning of ``encoded``.
    """

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33

        def examples() -> Iterator[_Example]:
            for batch in batches:
                lists = batch.column(1)
                values = lists.values.to_numpy(zero_copy_only=False)
                values = np.nan_to_num(values).astype(np.int32)
                offsets = lists.offsets.to_numpy()
                starts = batch.column(2).to_pylist()
                missing = lists.is_null().to_pylist()
                for k, (id_, loss_from) in enumerate(zip(batch.column(0).to_pylist(), starts, strict=True)):
                    if not missing[k]:
                        ids = values[offsets[k] : offsets[k + 1]]
                        yield _Example(id_, ids, min(max(loss_from or 0, 0), len(ids)), 0, len(ids))

        def table(rows: list[tuple]) -> pa.RecordBatch:
            id_, start, ids, total, sequence, offset = zip(*rows, strict=True)
            lengths = [len(x) for x in ids]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *lengths]).astype(np.int32), np.concatenate(ids))
            columns = [pa.array(x, pa.int64()) for x in (id_, start, lengths, total, sequence, offset)]
            columns.insert(3, lists)
            names = ["id", "start", "length", "token_ids", "total_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows, held = [], 0
        for pieces in _Packer(limits).run(examples()):
            offset = 0
            for piece in pieces:
                ids = piece.ids[piece.start : piece.stop]
                rows.append((piece.id, piece.start, ids, len(piece.ids), number, offset))
                offset += len(ids)
            number, held = number + 1, held + offset
            if held >= 1 << 20:
                yield table(rows)
                rows, held = [], 0
        if rows:
            yield table(rows)

    loss_from = F.col("loss_from").cast("int") if "loss_from" in encoded.columns else F.lit(None).cast("int")
    columns = F.col("id").cast("long").alias("id"), F.col("token_ids").cast("array<int>"), loss_from.alias("loss_from")
    return encoded.select(*columns).mapInArrow(run, PIECE)
