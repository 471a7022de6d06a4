"""Removal of near-identical lines over all listing descriptions; one occurrence of each group stays.

Lines are normalised (lower case, single spaces) and equal ones folded.  Every different line has a
64-bit SimHash of its words.  Two lines whose hashes differ in at most ``DISTANCE`` of the ``PIECES`` pieces' bits
agree on ``PIECES - DISTANCE`` whole pieces; every such choice of pieces is a bucket.  Lines that meet in a bucket,
differ in at most ``DISTANCE`` bits and reach the edit similarity are linked, and of every connected group the first
occurrence is kept.

Buckets are asked for packed (``elsewhere``), compared in ``linking``; texts are shuffled once, in blocks.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import combinations
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import elsewhere, textblocks
from lotwise.llm.linking import linked_groups
from lotwise.llm.ngramjoin import M1, M2, mixed
from lotwise.llm.wire import gives_back, unpack_sorted
from lotwise.session import discard, saved

DISTANCE = 3
PIECES = 6
#: Bits of a bucket's number: 5 for the choice of pieces, 33 for the largest three.
KEY_BITS = 38
#: Different lines whose buckets are asked for together.
ASK_LINES = 50_000
BUCKETS_PER_PARTITION = 2
#: Words whose hash bits are added up together.
WORDS_AT_ONCE = 50_000
MOST_WEIGHT = 9

_EDGES = [round(k * 64 / PIECES) for k in range(PIECES + 1)]


def normalised(line: str) -> bytes:
    return b" ".join(line.lower().encode().split())


def simhashes(lines: Iterable[list[bytes]]) -> np.ndarray:
    """The SimHash of every line of words: each bit is that of most of its different words.

    A word weighs as much as its length over three bytes, at least 1 and at most ``MOST_WEIGHT``: else the few short
    words that all prose shares would make unrelated lines alike.
    """
    out, words, counts = [], [], []

    def close() -> None:
        hashes = mixed(np.fromiter(map(crc32, words), np.uint64, len(words)) * M1 + M2)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        weight = np.clip(np.fromiter(map(len, words), np.int64, len(words)) - 3, 1, MOST_WEIGHT).astype(np.uint8)
        starts = np.cumsum(counts) - counts
        ones = np.add.reduceat(bits * weight[:, None], starts, axis=0, dtype=np.int32)
        whole = np.add.reduceat(weight, starts, dtype=np.int32)
        out.append(np.packbits(2 * ones > whole[:, None], axis=1).view(np.uint64).ravel())

    for line in lines:
        own = dict.fromkeys(line)
        words += own
        counts.append(len(own))
        if len(words) >= WORDS_AT_ONCE:
            close()
            words, counts = [], []
    if words:
        close()
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def bucket_keys(marks: np.ndarray) -> np.ndarray:
    """One row per choice of pieces: the bucket of every hash, the number of the choice before the pieces' bits."""
    sizes = np.diff(_EDGES).tolist()
    pieces = [(marks >> np.uint64(a)) & np.uint64((1 << n) - 1) for a, n in zip(_EDGES, sizes, strict=False)]
    out = []
    for number, chosen in enumerate(combinations(range(PIECES), PIECES - DISTANCE)):
        key = np.full(len(marks), number, np.uint64)
        width = 0
        for k in chosen:
            key = (key << np.uint64(sizes[k])) | pieces[k]
            width += sizes[k]
        spare = np.uint64(KEY_BITS - 5 - width)
        out.append((key << spare) if spare else key)
    return np.stack(out)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger: bit vectors of a whole row at once (Myers, 1999)."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, distance = full, 0, len(a)
    for n, x in enumerate(b, 1):
        match = places.get(x, 0)
        cross = (((match & plus) + plus) ^ plus) | match
        up = minus | (full & ~(cross | plus))
        down = plus & cross
        distance += 1 if up & top else -1 if down & top else 0
        if distance - (len(b) - n) > most:
            return most + 1
        up = (up << 1 | 1) & full
        down = (down << 1) & full
        match |= minus
        plus = down | (full & ~(match | up))
        minus = up & match
    return distance


def alike(percent: int):
    """Whether two bodies, SimHash before line, are within the distance and reach the edit similarity."""

    def linked(left: bytes, right: bytes) -> bool:
        if (int.from_bytes(left[:8]) ^ int.from_bytes(right[:8])).bit_count() > DISTANCE:
            return False
        a, b = left[8:].decode(), right[8:].decode()
        longest = max(len(a), len(b))
        most = (100 - percent) * longest // 100
        return edit_distance(a, b, most) <= most

    return linked


def _prepare(marks: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(marks), np.uint64)


def _near(marks: np.ndarray, k: int, others: np.ndarray) -> np.ndarray:
    return np.bitwise_count(marks[others] ^ marks[k]) <= DISTANCE


@gives_back
def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to one narrow row per line that is not blank."""
    for batch in batches:
        for row in batch.to_pylist():
            texts = textblocks.texts_of(row)
            ids = textblocks.unpack_ids(row["ids"], len(texts))
            nodes, at, line = array("Q"), array("i"), array("i")

            def words_of_lines() -> Iterator[list[bytes]]:
                for n, text in enumerate(texts):
                    for k, raw in enumerate(text.lower().encode().split(b"\n")):
                        if words := raw.split():
                            nodes.append(xxhash.xxh3_64_intdigest(b" ".join(words)))
                            at.append(n)
                            line.append(k)
                            yield words

            marks = simhashes(words_of_lines())
            columns = {
                "node": pa.array(np.array(nodes, np.uint64).astype(np.int64), pa.int64()),
                "mark": pa.array(marks.astype(np.int64), pa.int64()),
                "id": pa.array([ids[n] for n in at], pa.int64()),
                "block": pa.array(np.full(len(at), row["block"]), pa.int64()),
                "row": pa.array(at, pa.int32()),
                "line": pa.array(line, pa.int32()),
            }
            yield pa.RecordBatch.from_pydict(columns)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Different lines to packs that ask for their buckets together."""
    number = TaskContext.get().partitionId() << 32

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        columns = {"block": pa.array([number], pa.int64()), "lines": pa.array([np.concatenate(parts).tobytes()], pa.binary())}
        return pa.RecordBatch.from_pydict(columns)

    parts, held = [], 0
    for batch in batches:
        parts.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1).astype("<i8"))
        held += batch.num_rows
        if held >= ASK_LINES:
            yield pack(parts)
            number, parts, held = number + 1, [], 0
    if held:
        yield pack(parts)


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(data, "<i8").reshape(-1, 2)
    return pairs[:, 0], bucket_keys(np.ascontiguousarray(pairs[:, 1]).view(np.uint64))


def _asks(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in elsewhere.batches_of(batches, "block", "lines"):
            yield elsewhere.ask_rows(block, np.unique(_opened(data)[1]), buckets, KEY_BITS)

    return run


@gives_back
def _shared(packs: pa.Table, replies: pa.Table) -> pa.Table:
    """(key, node) of the buckets in which a line is not alone."""
    known = [unpack_sorted(x) for x in replies.column("numbers").to_pylist()]
    out_keys, out_nodes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for data in packs.column("lines").to_pylist():
        nodes, keys = _opened(data)
        found, times = np.unique(keys, return_counts=True)
        wanted = np.concatenate([found[times > 1], *known])
        keep = np.isin(keys, wanted)
        out_keys.append(keys[keep])
        out_nodes.append(np.broadcast_to(nodes, keys.shape)[keep])
    keys = np.concatenate(out_keys).astype(np.int64)
    return pa.table({"key": pa.array(keys, pa.int64()), "node": pa.array(np.concatenate(out_nodes), pa.int64())})


@gives_back
def _bodies(blocks: pa.Table, wanted: pa.Table) -> pa.Table:
    """The normalised text of the wanted lines of one block."""
    rows = wanted.to_pylist()
    bodies = []
    for row in blocks.to_pylist() if rows else []:
        texts, split = textblocks.texts_of(row), {}
        for r in rows:
            if r["row"] not in split:
                split[r["row"]] = texts[r["row"]].split("\n")
            bodies.append(normalised(split[r["row"]][r["line"]]))
    marks = [np.array([r["mark"]], "<i8").tobytes() for r in rows]
    return pa.table(
        [
            pa.array([r["node"] for r in rows], pa.int64()),
            pa.array(marks, pa.binary()),
            pa.array([m + b for m, b in zip(marks, bodies, strict=True)], pa.binary()),
        ],
        names=["node", "mark", "body"],
    )


def _without(columns: list[str]):
    """A block's listings without the lines to remove."""

    @gives_back
    def run(blocks: pa.Table, removed: pa.Table) -> pa.Table:
        gone: dict[int, set[int]] = {}
        for row, line in zip(removed.column("row").to_pylist(), removed.column("line").to_pylist(), strict=True):
            gone.setdefault(row, set()).add(line)
        parts = []
        for block in blocks.to_pylist():
            texts = textblocks.texts_of(block)
            lost = [len(gone.get(n, ())) for n in range(len(texts))]
            for n in gone:
                texts[n] = "\n".join(x for k, x in enumerate(texts[n].split("\n")) if k not in gone[n])
            made = {
                "id": pa.array(textblocks.unpack_ids(block["ids"], len(texts)), pa.int64()),
                "description": pa.array(texts, pa.string()),
                "removed_lines": pa.array(lost, pa.int32()),
            }
            rest = textblocks.rest_of(block)
            parts.append(pa.table([made[c] if c in made else rest.column(c) for c in columns], names=columns))
        return pa.concat_tables(parts)

    return run


def remove_near_lines(listings: DataFrame, percent: int = 80) -> DataFrame:
    """The listings without repeated and near-repeated lines of ``description``, and ``removed_lines``.

    Two lines are linked if they are equal once normalised, or if their SimHashes differ in at most ``DISTANCE`` bits
    and one less their edit distance over the longer length is at least ``percent`` / 100.  Of each group connected by
    links one occurrence stays: that of the smallest id (a null id counts as the smallest), then the first line.
    Blank lines stay and link with nothing.  A null description becomes an empty one.  One row per input row,
    repeated rows included: of those the first in the table's layout keeps its lines.  Other columns stay as they are
    but a column named ``removed_lines`` is replaced.  Lines are told apart by 64-bit hashes.
    """
    names = [c for c in listings.columns if c != "removed_lines"]
    listings = listings.select(*[f"`{c}`" for c in names])
    partitions = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written once: several jobs name rows by block and place, which must mean the same rows in all of them.
    cut = saved(textblocks.cut(listings, rest=True))
    blocks = cut.repartition("block")
    kinds = "node long, mark long, id long, block long, row int, line int"
    lines = saved(cut.mapInArrow(_lines, kinds))

    place = F.struct("id", "block", "row", "line")
    different = saved(lines.groupBy("node").agg(F.min("mark").alias("mark"), F.min(place).alias("first")))
    packs = different.select("node", "mark").mapInArrow(_gather, "block long, lines binary").repartition("block")
    replies = elsewhere.answers(packs.mapInArrow(_asks(partitions * BUCKETS_PER_PARTITION), elsewhere.ASK))
    shared = packs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_shared, "key long, node long")

    def items(nodes: DataFrame) -> DataFrame:
        texts = cut.select("block", "lengths", "text").repartition("block")
        wanted = different.join(nodes, "node").select("node", "mark", "first.block", "first.row", "first.line")
        whole = texts.groupBy("block").cogroup(wanted.groupBy("block"))
        return whole.applyInArrow(_bodies, "node long, mark binary, body binary")

    groups = linked_groups(shared, items, _prepare, _near, alike(percent))
    grouped = different.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    kept = grouped.groupBy("component").agg(F.min("first").alias("kept"))
    # Only what is left of a line's own group decides: (node, kept) for every different line.
    fate = grouped.select("node", "component").join(kept, "component").select("node", "kept")
    removed = saved(lines.join(fate, "node").filter(~place.eqNullSafe(F.col("kept"))).select("block", "row", "line"))
    discard(lines, different)

    schema = listings.select(
        *[
            F.col(f"`{c}`").cast({"id": "long", "description": "string"}.get(c, listings.schema[c].dataType)).alias(c)
            for c in names
        ],
        F.lit(0).alias("removed_lines"),
    ).schema
    run = _without([*names, "removed_lines"])
    return blocks.groupBy("block").cogroup(removed.groupBy("block")).applyInArrow(run, schema)
