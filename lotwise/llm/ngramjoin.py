"""Near copies of listing descriptions: an exact Jaccard self-join of word shingles with PartEnum signatures.

Sets are grouped by size into bands of ratio 3/2.  Within a band two sets of the wanted similarity differ in at most
k shingles.  The shingle domain is cut into first-level parts, so many that one of them holds at most one difference,
and each of those into three; every two of the three make a signature, and one of these is untouched by the
difference.  So sufficiently similar sets share a signature (Arasu, Ganti and Kaushik, 2006).

Copies are folded to one set first.  Signatures stay packed in blocks, which ask only whether a signature is known to
another block (``elsewhere``); rows are made of shared ones alone and compared in ``linking``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import elsewhere
from lotwise.llm.linking import linked_groups
from lotwise.llm.wire import gives_back, pack_numbers, pack_sorted, unpack_numbers, unpack_sorted
from lotwise.session import discard, saved

#: Text bytes, and bytes of signatures, after which a block is closed.
BLOCK_BYTES = 12 << 20
BLOCK_SIGNATURES = 256 << 10
#: Buckets of the signature range for each shuffle partition.
BUCKETS_PER_PARTITION = 2
SIGNATURE_BITS = 48
#: Bits of a shingle's hash by which two sets are compared in the end.
COMPARED_BITS = 48
#: Word hashes that a worker remembers.
MOST_WORDS = 200_000
SECOND_LEVEL = 3
BLOCK = "block long, ids binary, sizes binary, keys binary, owners binary, counts binary, signatures binary"

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, each worked out once; forgotten when there are too many to hold."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_set(text: str | None, hashes: WordHashes, width: int = 4) -> np.ndarray:
    """Ascending distinct hashes of the text's word shingles, A-Z in lower case; fewer words are one shingle."""
    words = hashes.of((text or "").encode().lower().split())
    if not len(words):
        return words
    n = max(1, len(words) - width + 1)
    total = np.full(n, min(len(words), width), np.uint64)
    for k in range(min(width, len(words))):
        total = (total ^ words[k : k + n]) * M1
        total ^= total >> np.uint64(29)
    return np.unique(mixed(total))


def most_differences(total: int, percent: int) -> int:
    """The largest symmetric difference of two sets of ``total`` elements together with that Jaccard similarity."""
    return (100 - percent) * total // (100 + percent)


def bands(size: int, percent: int) -> list[tuple[int, int]]:
    """(band, largest size) of the instances in which a set of ``size`` takes part.

    A set belongs to its own band, and to the next if it can be similar to that band's smallest set.
    """
    band, low = 0, 1
    while low + low // 2 + 1 <= size:
        band, low = band + 1, low + low // 2 + 1
    following = low + low // 2 + 1
    own = [(band, following - 1)]
    if 100 * size >= percent * following:
        own.append((band + 1, following + following // 2))
    return own


def signatures(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The PartEnum signatures of one set; sets that reach the similarity and are not equal share one.

    Parts are ranges of the hash value.  A signature of no shingle says little, and most sets can do without:
    with some parts more than needed, only a set with more such parts than that has to give them.
    """
    found = []
    if not len(shingles):
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(shingles ^ M3), dtype=np.uint64)])
    for band, largest in bands(len(shingles), percent):
        k = most_differences(2 * largest, percent)
        if not k:
            continue  # only equal sets are similar enough
        spare = (k // 2 + 1) // 16
        first = k // 2 + 1 + spare
        parts = first * SECOND_LEVEL
        edges = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        ends = np.concatenate([[0], np.searchsorted(shingles, edges), [len(shingles)]])
        inside = (sums[ends[1:]] - sums[ends[:-1]]).reshape(first, SECOND_LEVEL)
        counts = np.diff(ends).reshape(first, SECOND_LEVEL)
        place = np.arange(first, dtype=np.uint64)
        made, empty = [], []
        for number, pair in enumerate(combinations(range(SECOND_LEVEL), SECOND_LEVEL - 1)):
            seed = (np.uint64(band) << np.uint64(40)) + (np.uint64(number) << np.uint64(32)) + place
            total = mixed(seed * M1 + M2)
            for part in pair:
                total = mixed(total * M3 + inside[:, part])
            made.append(total)
            empty.append(counts[:, pair].sum(axis=1) == 0)
        made, empty = np.stack(made), np.stack(empty)
        needed = ~empty if empty.any(axis=0).sum() <= spare else np.ones_like(empty)
        found.append(made[needed] >> np.uint64(64 - SIGNATURE_BITS))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _cut(percent: int, width: int):
    """Listings to blocks: ids, set sizes and keys of all, and the signatures of each different set."""

    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        hashes = WordHashes()
        ids, sizes, keys, owners, counts, parts, seen, held, kept = [], [], [], [], [], [], set(), 0, 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            six = np.ascontiguousarray(flat.view(np.uint8).reshape(-1, 8)[:, : SIGNATURE_BITS // 8])
            row = [
                np.array(ids, "<i8").tobytes(), pack_numbers(np.array(sizes)), np.concatenate(keys).tobytes(),
                pack_numbers(np.array(owners)), pack_numbers(np.array(counts)), six.tobytes(),
            ]
            names = ["ids", "sizes", "keys", "owners", "counts", "signatures"]
            columns = {name: pa.array([x], pa.binary()) for name, x in zip(names, row, strict=True)}
            return pa.RecordBatch.from_pydict({"block": pa.array([number], pa.int64()), **columns})

        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                shingles = shingle_set(text, hashes, width)
                key = np.array([mixed(shingles).sum(dtype=np.uint64), mixed(shingles * M1 + M2).sum(dtype=np.uint64)])
                ids.append(id_)
                sizes.append(len(shingles))
                keys.append(key)
                if (same := (key.tobytes(), len(shingles))) not in seen:
                    seen.add(same)
                    made = signatures(shingles, percent)
                    if len(made):
                        owners.append(len(ids) - 1)
                        counts.append(len(made))
                        parts.append(made)
                        kept += len(made) * SIGNATURE_BITS // 8
                held += len(text)
                if held >= BLOCK_BYTES or kept >= BLOCK_SIGNATURES:
                    yield block()
                    number += 1
                    ids, sizes, keys, owners, counts, parts, seen, held, kept = [], [], [], [], [], [], set(), 0, 0
        if ids:
            yield block()

    return run


def _open_signatures(data: bytes) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, SIGNATURE_BITS // 8)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, : SIGNATURE_BITS // 8] = six
    return wide.view("<u8").ravel()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to one narrow row per listing: id, size and the two halves of the set's key."""
    for ids, sizes, keys in elsewhere.batches_of(batches, "ids", "sizes", "keys"):
        halves = np.frombuffer(keys, "<i8").reshape(-1, 2)
        columns = np.frombuffer(ids, "<i8"), unpack_numbers(sizes).astype(np.int64), halves[:, 0], halves[:, 1]
        names = ["id", "size", "key", "key2"]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


def _asks(buckets: int):
    @gives_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, packed in elsewhere.batches_of(batches, "block", "signatures"):
            yield elsewhere.ask_rows(block, np.unique(_open_signatures(packed)), buckets, SIGNATURE_BITS)

    return run


@gives_back
def _shared(blocks: pa.Table, replies: pa.Table) -> pa.Table:
    """(key, id) of the signatures that another block, or another set of this block, has too."""
    out_keys, out_ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    known = [unpack_sorted(x) for x in replies.column("numbers").to_pylist()]
    for row in blocks.select(["ids", "owners", "counts", "signatures"]).to_pylist():
        flat = _open_signatures(row["signatures"])
        found, times = np.unique(flat, return_counts=True)
        wanted = np.unique(np.concatenate([found[times > 1], *known]))
        ids = np.frombuffer(row["ids"], "<i8")[unpack_numbers(row["owners"])]
        keep = np.isin(flat, wanted)
        out_keys.append(flat[keep])
        out_ids.append(np.repeat(ids, unpack_numbers(row["counts"]))[keep])
    keys = np.concatenate(out_keys).astype(np.int64)
    return pa.table({"key": pa.array(keys), "id": pa.array(np.concatenate(out_ids), pa.int64())})


def sketch(shingles: np.ndarray) -> bytes:
    """The set's size and a bitmap with the parity of its shingles per bit, one or two bits a shingle.

    The bits in which two sets' bitmaps differ are at most as many as the shingles in which they do.
    """
    bits = max(64, 1 << (len(shingles) - 1).bit_length())
    place = mixed(shingles * M3 + M1) & np.uint64(bits - 1)
    odd = np.bincount(place.astype(np.int64), minlength=bits) & 1
    return np.array([len(shingles)], "<i8").tobytes() + np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def prepare_sketches(marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and bitmaps, all folded to the shortest length: halves are added up modulo 2."""
    maps = [np.frombuffer(m, "<u8")[1:] for m in marks]
    shortest = min(map(len, maps))
    folded = np.stack([np.bitwise_xor.reduce(m.reshape(-1, shortest), axis=0) for m in maps])
    return np.array([np.frombuffer(m[:8], "<i8")[0] for m in marks]), folded


def near_sketches(percent: int):
    def near(ready: tuple[np.ndarray, np.ndarray], k: int, others: np.ndarray) -> np.ndarray:
        sizes, maps = ready
        apart = np.bitwise_count(maps[others] ^ maps[k]).sum(axis=1, dtype=np.int64)
        return apart <= (100 - percent) * (sizes[others] + sizes[k]) // (100 + percent)

    return near


def body(shingles: np.ndarray) -> bytes:
    """The set as it is compared in full: the upper bits of its hashes, ascending."""
    return pack_sorted(np.unique(shingles >> np.uint64(64 - COMPARED_BITS)))


def similar(percent: int):
    def linked(a: bytes, b: bytes) -> bool:
        left, right = unpack_sorted(a), unpack_sorted(b)
        if 100 * min(len(left), len(right)) < percent * max(len(left), len(right)):
            return False
        common = len(np.intersect1d(left, right, assume_unique=True))
        return 100 * common >= percent * (len(left) + len(right) - common)

    return linked


def near_copies(listings: DataFrame, percent: int = 80, width: int = 5) -> DataFrame:
    """(id, size, component): the number of ``description``'s distinct word shingles and its group of near copies.

    Two listings are linked if the Jaccard similarity of their shingle sets is at least ``percent`` / 100; the
    component is the smallest id connected by links, the listing's own included.  Words are runs without ASCII
    white space, A-Z in lower case; fewer than ``width`` words are one shingle.  A null, empty or blank
    description has size 0 and is linked with nothing, not even with another such.  One row per input row; rows
    with a null id are left out, equal ids count as one listing, other columns are not read.

    Sets are told equal by 64-bit hashes of their shingles, and compared by the upper 48 bits of those.
    """
    texts = listings.filter(F.col("id").isNotNull()).select(
        F.col("id").cast("long").alias("id"), F.col("description").cast("string").alias("description")
    )
    buckets = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    # Written once: several jobs read the blocks, and their numbers must mean the same rows in all of them.
    cut = saved(texts.mapInArrow(_cut(percent, width), BLOCK))
    asks = cut.select("block", "signatures").mapInArrow(_asks(buckets), elsewhere.ASK)
    replies = saved(elsewhere.answers(asks))
    packed = cut.select("block", "ids", "owners", "counts", "signatures")
    wanted = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_shared, "key long, id long")
    wanted = saved(wanted)

    profiles = saved(cut.mapInArrow(_profiles, "id long, size long, key long, key2 long"))
    same = ["size", "key", "key2"]
    first = profiles.filter(F.col("size") > 0).groupBy(*same).agg(F.min("id").alias("node"), F.count("id").alias("copies"))
    named = profiles.join(first, same, "left").withColumn("node", F.coalesce("node", "id"))
    named = saved(named.select("id", "size", "node"))
    discard(profiles, cut, replies)
    rows = wanted.join(named.select("id", "node").distinct(), "id").select("key", "node").distinct()

    def sets(nodes: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            for batch in batches:
                found = [shingle_set(text.as_py(), hashes, width) for text in batch.column(1)]
                marks = pa.array([sketch(x) for x in found], pa.binary())
                bodies = pa.array([body(x) for x in found], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0), marks, bodies], names=["node", "mark", "body"])

        chosen = texts.join(nodes.withColumnRenamed("node", "id"), "id", "left_semi")
        return chosen.mapInArrow(run, "node long, mark binary, body binary")

    compare = prepare_sketches, near_sketches(percent), similar(percent)
    groups = linked_groups(rows, sets, *compare, read=lambda: discard(wanted))
    found = named.join(groups, "node", "left")
    # A listing whose id has several rows: all its rows are one listing.
    return found.select("id", "size", F.coalesce("component", "node").alias("component"))
