"""Best-fit decreasing packing of tokenised listings, certified by lower bounds and repaired by exchange.

Pieces are dealt over partitions of a bounded number of pieces, and each partition packs its own by best-fit decreasing.
Dual feasible functions of the lengths give a lower bound on the sequences that those pieces need; a partition that
reaches its bound is certified.  Where a gap stays, full sequences are settled (nothing can be gained in them) and the
others are exchanged whole: dealt anew over as many partitions as they need, where best-fit decreasing runs again on the pieces of
sequences from many partitions.  A certified partition gives its emptiest sequence, so that roundings add up to
whole sequences.  A partition keeps what it was given if the new packing is not smaller: no round is ever worse.

Only lengths and the columns given with them travel.  Pieces of full length are sequences by themselves and are not dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from lotwise.llm import bytebpe
from lotwise.session import saved

#: Pieces expected in one partition, and most rounds.  The last round is the first of one partition, or the one after a
#: round that settled less than a tenth; it settles all.
PARTITION_PIECES = 200_000
ROUNDS = 8
#: Dual feasible functions of the rounding family that are tried.
ROUNDINGS = 64

CUT = "id long, piece int, start long, length long, token_ids array<int>"


def _cut(batches: Iterator[pa.RecordBatch], max_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(1)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        sizes = np.where(lists.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
        pieces = -(-sizes // max_tokens)
        owner = np.repeat(np.arange(len(sizes)), pieces)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        over = (sizes - (pieces - 1) * max_tokens)[owner]
        length = np.where(number == 0, over, max_tokens)
        start = np.where(number == 0, 0, over + (number - 1) * max_tokens)
        values = lists.values.fill_null(0) if lists.values.null_count else lists.values
        within = np.concatenate([[0], np.cumsum(length)])
        if within[-1] == offsets[-1] - offsets[0]:  # pieces lie end to end as the lists do
            taken = values.slice(offsets[0], within[-1])
        else:
            first = offsets[owner] + start - within[:-1]
            taken = values.take(pa.array(np.repeat(first, length) + np.arange(within[-1])))
        columns = [
            batch.column(0).take(pa.array(owner)), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
            pa.array(length, pa.int64()), pa.ListArray.from_arrays(pa.array(within, pa.int32()), taken),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "token_ids"])


def cut_listings(encoded: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """(id, piece, start, length, token_ids): listings longer than ``max_tokens`` cut, the others whole.

    All pieces of a cut listing but the first have ``max_tokens``; the first takes what is over.  ``encoded`` has ``id``
    and ``token_ids``; a null or empty list makes no piece, null tokens count as 0, repeated rows and null ids are rows
    like any other, other columns are not read.
    """
    chosen = encoded.select(F.col("id").cast("long").alias("id"), F.col("token_ids").cast("array<int>"))
    return chosen.mapInArrow(lambda batches: _cut(batches, max_tokens), CUT)


def cut_descriptions(listings: DataFrame, vocabulary: str, max_tokens: int = 1024, ended_by: int | None = None) -> DataFrame:
    """``cut_listings`` of the byte-level ids of listings (``bytebpe.encode_descriptions``), in one worker."""
    return bytebpe.chosen(listings).mapInArrow(
        lambda batches: _cut(bytebpe.encoded(batches, vocabulary, ended_by), max_tokens), CUT
    )


def best_fit_decreasing(lengths: np.ndarray, max_tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """The sequence, from 0, and the place in it of every piece: longest first, each to the fullest sequence it fits.

    Pieces of one length are placed together.  A sequence that takes one of them is the fullest that fits the next too,
    as long as there is room, so it takes as many as fit.
    """
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths, kind="stable")
    sizes, firsts = np.unique(-lengths[order], return_index=True)
    open_by_room: dict[int, list[np.ndarray]] = {}
    rooms, opened = 0, 0  # a bit for every room that some sequence has
    for size, pieces in zip((-sizes).tolist(), np.split(order, firsts[1:]), strict=True):
        done = 0
        while done < len(pieces):
            fitting = rooms >> size
            room = size + (fitting & -fitting).bit_length() - 1 if fitting else max_tokens
            each = room // size
            needed = -(-(len(pieces) - done) // each)
            if fitting:
                held = open_by_room[room].pop()
                chosen, rest = held[:needed], held[needed:]
                if len(rest):
                    open_by_room[room].append(rest)
                if not open_by_room[room]:
                    rooms &= ~(1 << room)
            else:
                chosen = np.arange(opened, opened + needed)
                opened += needed
            some = pieces[done : done + each * len(chosen)]
            done += len(some)
            sequence[some] = np.repeat(chosen, each)[: len(some)]
            offset[some] = max_tokens - room + np.arange(len(some)) % each * size
            last = len(some) - each * (len(chosen) - 1)  # what the last of them took
            for part, left in ((chosen[:-1], room - each * size), (chosen[-1:], room - last * size)):
                if len(part) and left:
                    open_by_room.setdefault(left, []).append(part)
                    rooms |= 1 << left
    return sequence, offset


def sequences_needed(sizes: np.ndarray, counts: np.ndarray, max_tokens: int) -> int:
    """A lower bound on the sequences of ``max_tokens`` for pieces of these lengths, by dual feasible functions.

    A function f of lengths for which every set of pieces that fits has a sum of f of at most 1 bounds the number from
    below by its sum over all pieces.  Tried are: the share of a sequence; that share with pieces up to t as nothing
    and those over max_tokens - t as whole sequences, for all t; and roundings of the share to k-ths (Fekete and
    Schepers, 2001).  All sums are whole numbers.
    """
    sizes, counts = sizes.astype(np.int64), counts.astype(np.int64)
    order = np.argsort(sizes)
    sizes, counts = sizes[order], counts[order]
    tokens = np.concatenate([[0], np.cumsum(sizes * counts)])
    pieces = np.concatenate([[0], np.cumsum(counts)])
    small = np.arange(max_tokens // 2 + 1)
    low, high = np.searchsorted(sizes, small, "right"), np.searchsorted(sizes, max_tokens - small, "right")
    shares = max_tokens * (pieces[-1] - pieces[high]) + np.maximum(tokens[high] - tokens[low], 0)
    best = int(-(-shares.max() // max_tokens))
    for k in range(1, ROUNDINGS + 1):
        scaled = (k + 1) * sizes
        # In units of 1 / (k * max_tokens): exact multiples keep their share, others round down to k-ths.
        values = np.where(scaled % max_tokens == 0, k * sizes, scaled // max_tokens * max_tokens)
        best = max(best, -(-int((values * counts).sum()) // (k * max_tokens)))
    return best


def least_sequences(pieces: DataFrame, max_tokens: int = 1024) -> int:
    """The lower bound over a whole table of pieces; only one row for each length (1 to ``max_tokens``) is gathered."""
    rows = pieces.filter("length > 0").groupBy("length").count().collect()
    sizes, counts = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    return sequences_needed(sizes, counts, max_tokens) if len(rows) else 0


def _pack(max_tokens: int, number: int, final: bool):
    """One partition of one round: packed, held against its bound, and what is exchanged marked by ``settled``."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        home = (number << 56) + (key[0].as_py() << 24)
        lengths = rows.column("length").to_numpy()
        given, before = np.unique(rows.column("sequence_id").to_numpy(), return_inverse=True)
        sequence, offset = best_fit_decreasing(lengths, max_tokens)
        made = int(sequence.max()) + 1
        names = home + np.arange(made)
        if number and made >= len(given):
            sequence, offset, made, names = before, rows.column("offset").to_numpy(), len(given), given
        bound = sequences_needed(*np.unique(lengths, return_counts=True), max_tokens)
        filled = np.bincount(sequence, weights=lengths, minlength=made).astype(np.int64)
        settled = filled == max_tokens
        if made == bound:
            settled = np.ones(made, bool)
            settled[np.argmin(filled)] = filled.min() == max_tokens
        if final:
            settled = np.ones(made, bool)
        out = rows.drop_columns(["partition", "sequence_id", "offset", "certified", "settled"])
        more = {
            "sequence_id": pa.array(names[sequence]), "offset": pa.array(offset),
            "certified": pa.array(np.full(len(sequence), made == bound)), "settled": pa.array(settled[sequence]),
        }
        for name, column in more.items():
            out = out.append_column(name, column)
        return out

    return run


def pack_best_fit(pieces: DataFrame, max_tokens: int = 1024) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and ``certified``, in as few sequences of ``max_tokens`` as it can.

    ``pieces`` has ``length`` (``cut_listings`` gives pieces of listings) and any other columns, which stay as they
    are; one named like the three new ones is replaced.  Every piece lies whole in one sequence, ``offset`` is gapless
    from 0, ``sequence_id`` is any number.  ``certified``: the sequence comes from a partition whose number of
    sequences is proven to be the least for its pieces.  Pieces of no length or a null one are left out; longer ones
    than ``max_tokens`` are an error; repeated rows are pieces each for itself; an empty table gives none.
    """
    added = "sequence_id", "offset", "certified"
    carried = [c for c in pieces.columns if c not in added]
    given = pieces.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), F.col("length").cast("long").alias("length"))
    too_long = F.raise_error(F.concat(F.lit("a piece is longer than the limit: "), F.col("length").cast("string")))
    checked = given.filter("length > 0").withColumn(
        "length", F.when(F.col("length") > max_tokens, too_long.cast("long")).otherwise(F.col("length"))
    )
    # Written once: the number of a row must mean the same row in every round.
    base = saved(checked.withColumn("number", F.monotonically_increasing_id()))
    whole = base.filter(F.col("length") == max_tokens).select(
        "row", (-F.col("number") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    schema = StructType(
        [f for f in base.schema if f.name in ("row", "length")]
        + [StructField("sequence_id", LongType()), StructField("offset", LongType())]
        + [StructField("certified", BooleanType()), StructField("settled", BooleanType())]
    )
    nothing = F.lit(False)
    waiting = base.filter(F.col("length") < max_tokens).select(
        "row", "length", F.col("number").alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
        nothing.alias("certified"), nothing.alias("settled"),
    )
    results, before = [whole], None
    for number in range(ROUNDS):
        found = waiting.count()
        if not found:
            break
        parts = -(-found // PARTITION_PIECES)
        stuck = before is not None and 10 * found > 9 * before
        final, before = parts == 1 or stuck or number == ROUNDS - 1, found
        home = F.pmod(F.xxhash64("sequence_id", F.lit(number)), F.lit(parts))
        dealt = waiting.withColumn("partition", home)
        packed = saved(dealt.groupBy("partition").applyInArrow(_pack(max_tokens, number, final), schema))
        results.append(packed.filter("settled").select("row", *added))
        waiting = packed.filter("NOT settled")
        if final:
            break
    done = results[0]
    for more in results[1:]:
        done = done.unionByName(more)
    return done.select("row.*", *added)
