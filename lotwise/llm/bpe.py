"""BPE encoding and decoding of listing descriptions through a table of distinct words.

Texts are split at ASCII white space, which no token of a word-level vocabulary crosses, so
that encoding a text equals joining the encodings of its words.  Every block of listings
numbers its distinct words; only those travel, to the bucket of their hash, where each
distinct word is encoded once.  Its ids go back to the blocks that asked, and each text
takes them by position.

Layout: the blocks are shuffled once and that layout serves both uses; a word costs one
entry per block that has it, however frequent it is, so no word is a hot key.  Nothing is
broadcast.  Splitting, encoding and joining are functions of their input rows alone; a lost
executor's share is worked out again.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.wire import gives_back, pack_numbers, pack_words, spread, unpack_numbers, unpack_words

#: Text bytes after which a block of listings is closed; bounds the memory of a task.
BLOCK_BYTES = 12 << 20
#: Buckets of the word table for each shuffle partition of the session.
BUCKETS_PER_PARTITION = 2

BLOCK = "block long, ids array<long>, lengths binary, codes binary, words binary"
SHARE = "block long, bucket int, slots binary, words binary"
REPLY = "block long, slots binary, counts binary, token_ids binary"


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """The public tokenizer of a vocabulary file, one per worker, on one thread, without truncation or padding."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(vocabulary)
    found.no_truncation()
    found.no_padding()
    return found


class _Numbers(dict):
    """Numbers keys in order of first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


@gives_back
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listings to blocks: ids, words per text, the word number at every position, and the distinct words."""
    at = TaskContext.get().partitionId() << 32
    numbers, ids, lengths, codes, size = _Numbers(), [], [], [], 0

    def block() -> pa.RecordBatch:
        flat = np.concatenate(codes) if codes else np.zeros(0, np.uint32)
        row = [at], [ids], [pack_numbers(np.array(lengths))], [pack_numbers(flat)], [pack_words(list(numbers))]
        kinds = pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()
        columns = [pa.array(x, type=k) for x, k in zip(row, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "lengths", "codes", "words"])

    for batch in batches:
        for id_, text in zip(batch.column(0), batch.column(1), strict=True):
            words = (text.as_py() or "").encode().split()
            ids.append(id_.as_py())
            lengths.append(len(words))
            codes.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.uint32, count=len(words)))
            size += sum(map(len, words)) + len(words)
            if size >= BLOCK_BYTES:
                yield block()
                at, numbers, ids, lengths, codes, size = at + 1, _Numbers(), [], [], [], 0
    if ids:
        yield block()


def _share_out(buckets: int):
    """Blocks to (block, bucket) rows, each with the block's words of that bucket and their numbers."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, packed in zip(batch.column("block").to_pylist(), batch.column("words").to_pylist(), strict=True):
                words = np.array(unpack_words(packed), dtype=object)
                if not len(words):
                    continue
                home = np.fromiter(map(crc32, words), dtype=np.int64, count=len(words)) % buckets
                order = np.argsort(home, kind="stable")
                places, firsts = np.unique(home[order], return_index=True)
                slots = np.split(order, firsts[1:])
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([block] * len(places), pa.int64()),
                        "bucket": pa.array(places, pa.int32()),
                        "slots": pa.array([pack_numbers(s) for s in slots], pa.binary()),
                        "words": pa.array([pack_words(list(words[s])) for s in slots], pa.binary()),
                    }
                )

    return run


def _encode(vocabulary: str):
    """One bucket of the word table: distinct words, each encoded once, and the ids each block asked for."""

    @gives_back
    def run(rows: pa.Table) -> pa.Table:
        asked = [unpack_words(x) for x in rows.column("words").to_pylist()]
        numbers = _Numbers()
        wanted = [np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words)) for words in asked]
        texts = [word.decode() for word in numbers]
        counts, flat = np.zeros(len(texts), np.int64), []
        for first in range(0, len(texts), 20_000):
            found = tokenizer(vocabulary).encode_batch_fast(texts[first : first + 20_000], add_special_tokens=False)
            ids = [x.ids for x in found]
            counts[first : first + len(ids)] = list(map(len, ids))
            flat.append(np.fromiter((i for x in ids for i in x), dtype=np.uint32))
        flat = np.concatenate(flat)
        starts = np.cumsum(counts) - counts
        return pa.table(
            {
                "block": rows.column("block"),
                "slots": rows.column("slots"),
                "counts": pa.array([pack_numbers(counts[w]) for w in wanted], pa.binary()),
                "token_ids": pa.array([pack_numbers(flat[spread(starts[w], counts[w])]) for w in wanted], pa.binary()),
            }
        )

    return run


@gives_back
def _join_back(blocks: pa.Table, replies: pa.Table) -> pa.Table:
    """The ids of every text of one block, taken by word number at every position."""
    out_ids, out_values, out_sizes = [], [np.zeros(0, np.int32)], [0]
    answers = [
        [unpack_numbers(x).astype(np.int64) for x in row]
        for row in zip(*(replies.column(c).to_pylist() for c in ("slots", "counts", "token_ids")), strict=True)
    ]
    for row in blocks.select(["ids", "lengths", "codes"]).to_pylist():
        codes, lengths = unpack_numbers(row["codes"]), unpack_numbers(row["lengths"]).astype(np.int64)
        counts = np.zeros(1 + max((int(s.max()) for s, _, _ in answers), default=0), np.int32)
        for slots, sizes, _ in answers:
            counts[slots] = sizes
        starts = np.cumsum(counts) - counts
        flat = np.zeros(int(counts.sum()), np.int32)
        for slots, sizes, ids in answers:
            flat[spread(starts[slots], sizes)] = ids
        sizes = counts[codes].astype(np.int64)
        for first in range(0, len(codes), 1 << 20):
            part = codes[first : first + (1 << 20)]
            out_values.append(flat[spread(starts[part], sizes[first : first + (1 << 20)])])
        ends = np.concatenate([[0], np.cumsum(sizes)])
        stops = np.cumsum(lengths)
        out_sizes.extend((ends[stops] - ends[stops - lengths]).tolist())
        out_ids.extend(row["ids"])
    offsets = pa.array(np.cumsum(out_sizes), pa.int32())
    values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(out_values), pa.int32()))
    return pa.table({"id": pa.array(out_ids, pa.int64()), "token_ids": values})


def encode_descriptions(listings: DataFrame, vocabulary: str) -> DataFrame:
    """(id, token_ids): the BPE ids of every listing's ``description``, no special tokens added.

    Ids equal those of the tokenizers library for a vocabulary whose normaliser and splitter never
    join text across white space; special tokens spelt inside a text get their own ids.  A null or
    empty description, and one of white space only, has an empty list.  One row per input row:
    repeated rows stay, ``id`` may be null, other columns are not read, an empty table gives none.
    """
    conf = listings.sparkSession.conf
    buckets = int(conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    texts = listings.select(F.col("id").cast("long").alias("id"), F.col("description").cast("string"))
    blocks = texts.mapInArrow(_cut, BLOCK).repartition("block")
    asked = blocks.mapInArrow(_share_out(buckets), SHARE)
    replies = asked.groupBy("bucket").applyInArrow(_encode(vocabulary), REPLY)
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(
        _join_back, "id long, token_ids array<int>"
    )


def vocabulary_pieces(vocabulary: str) -> list[str]:
    """The piece of every id; ids without one are empty.  As long as the vocabulary file, never longer."""
    found = tokenizer(vocabulary).get_vocab(with_added_tokens=True)
    pieces = [""] * (1 + max(found.values(), default=-1))
    for piece, number in found.items():
        pieces[number] = piece
    return pieces


def decode_descriptions(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(id, token_ids, description): the text of every list of ids, pieces joined by one space.

    The id-to-piece table has one row per vocabulary entry, so each worker holds it whole and every
    batch of ids is joined with it by id.  That is the tokenizers library's decoding, specials kept,
    for a vocabulary that names no decoder of its own.  Ids outside the vocabulary and nulls give
    nothing; a null list gives an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.array(vocabulary_pieces(vocabulary), pa.large_string())
        known = np.array(vocabulary_pieces(vocabulary), dtype=object) != ""
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                lists = part.column(1)
                ids = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
                owners = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
                good = ~np.isnan(ids) if ids.dtype.kind == "f" else np.ones(len(ids), bool)
                good &= (ids >= 0) & (ids < len(table))
                ids, owners = ids[good].astype(np.int64), owners[good]
                kept = known[ids]
                ids, owners = ids[kept], owners[kept]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=part.num_rows))])
                found = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), table.take(pa.array(ids)))
                texts = pc.binary_join(found, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, texts], names=["id", "token_ids", "description"]
                )

    wanted = encoded.select(F.col("id").cast("long").alias("id"), F.col("token_ids").cast("array<int>"))
    return wanted.mapInArrow(run, "id long, token_ids array<int>, description string")
