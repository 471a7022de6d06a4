"""Removal of byte strings that listing descriptions share, over all listings, by collection suffix sorting.

Any two equal strings of ``width`` bytes hold the same least hash of a ``GRAM``-byte string.  Consecutive starts with
the same least hash make a run, a string of at most ``2 * width - 1`` bytes, and the hash is its key: equal strings
meet under one key, and starts of different keys need no comparison.

1. Blocks of listings name their keys, each once, with a hash of the run if it is the only one they have.  A key met
   once is done with; one that always has the same run marks all its starts.
2. Runs of keys with different runs go to shards by key; a shard builds the transform and common prefixes of its
   runs column by column (``columnbwt``), one part of its keys after another, and answers which starts repeat.
3. A key with more than ``HOT_RUNS`` different runs, such as the edge of a passage that a large share of all listings
   hold, would fill a shard; its starts are named by hash, once per block, and matched across blocks instead.

Buckets and shards are as many as the bytes of the table need, so a task's memory does not grow with it.  A key is a
least hash and so a small number: it is dealt out by its remainder, not by its size.

Blocks are shuffled once and used three times; only keys, the differing runs and answers move besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import textblocks
from lotwise.llm.columnbwt import repeated_starts
from lotwise.llm.ngramjoin import mixed
from lotwise.llm.textblocks import opened, unpack_ids
from lotwise.llm.wire import pack_numbers, pack_sorted, spread, squeeze, unpack_numbers, unpack_sorted, unsqueeze

#: Window starts looked at together.
PIECE = 1 << 19
#: Buckets for each shuffle partition of the session, at least.
BUCKETS_PER_PARTITION = 2
#: Bytes of text for each bucket, at most: a bucket's keys and a shard's runs are held by one task.
BUCKET_BYTES = 8 << 20
#: Parts of a shard's keys whose transforms are built one after another; one takes some 90 bytes for a byte of runs.
PARTS = 16
#: Different runs of a key, counted block by block, above which its starts are matched one by one.
HOT_RUNS = 20_000

NAMED = "block long, kind int, place int, numbers binary, first binary, second binary"
ALONE, SAME, DIFFER, HOT = range(4)
KEYS, RUNS, STARTS = range(3)

_random = np.random.default_rng(20_240_101)
BYTE_HASH = _random.integers(0, 2**64, 256, dtype=np.uint64)
FACTORS = _random.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
BASE = int(FACTORS[-1])


def _powers(base: int) -> np.ndarray:
    factors = np.full(PIECE + 1024, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def powers() -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, made when first needed."""
    if not _POWERS:
        _POWERS.extend([_powers(BASE), _powers(pow(BASE, -1, 1 << 64))])
    return _POWERS


def gram_of(width: int) -> int:
    """Bytes of the strings whose hashes are compared: the largest power of two within two thirds of the width.

    The longer it is, the fewer short phrases bring runs together that share no string of the full width.
    """
    return 1 << max(0, (2 * width // 3).bit_length() - 1)


@dataclass
class Runs:
    """Runs of a block in order: key, first start, number of starts, a hash of the run's bytes, and whether its least
    hash occurs twice inside it, so that its starts may repeat one another."""

    key: np.ndarray
    start: np.ndarray
    count: np.ndarray
    hash: np.ndarray
    several: np.ndarray


def _sliding_least(values: np.ndarray, window: int) -> np.ndarray:
    reach = 1
    while 2 * reach <= window:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = window - reach
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def find_runs(data: np.ndarray, lengths: np.ndarray, width: int) -> Runs:
    gram = gram_of(width)
    window = width - gram + 1
    ends = np.cumsum(lengths)
    up, down = powers()
    found: list[tuple[np.ndarray, ...]] = []
    for origin in range(0, len(data) - width + 1, PIECE):
        buffer = data[origin : origin + PIECE + width - 1]
        starts = len(buffer) - width + 1
        byte = BYTE_HASH[buffer]
        grams, reach = byte, 1
        while reach < gram:
            grams = grams[:-reach] * FACTORS[reach.bit_length()] + grams[reach:]
            reach *= 2
        grams = mixed(grams)
        least = _sliding_least(grams, window)

        # No string crosses the end of a text.
        inside = np.ones(starts, bool)
        low, high = np.searchsorted(ends, [origin, origin + starts + width], side="right")
        near = ends[low:high] - origin
        froms = np.maximum(near - width + 1, 0)
        crossing = spread(froms, np.maximum(near - froms, 0))
        inside[crossing[crossing < starts]] = False

        change = np.ones(starts, bool)
        change[1:] = (least[1:] != least[:-1]) | ~inside[:-1]
        first = np.flatnonzero(change & inside)
        stop = np.ones(starts, bool)
        stop[:-1] = (least[1:] != least[:-1]) | ~inside[1:]
        count = np.flatnonzero(stop & inside) + 1 - first
        if not len(first):
            continue
        pieces = -(-count // width)
        nth = spread(np.zeros(len(first), np.int64), pieces)
        owner = np.repeat(np.arange(len(first)), pieces)
        begin = first[owner] + nth * width
        size = np.minimum(width, count[owner] - nth * width)
        key = least[begin]

        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * up[: len(buffer)], dtype=np.uint64)])
        whole = (sums[begin + size + width - 1] - sums[begin]) * down[begin]
        last = begin + size - 1 + window - 1
        low_ones = np.flatnonzero(grams <= key.max())
        from_run, to_run = np.searchsorted(last, low_ones), np.searchsorted(begin, low_ones, side="right")
        runs = spread(from_run, np.maximum(to_run - from_run, 0))
        same = np.repeat(grams[low_ones], np.maximum(to_run - from_run, 0)) == key[runs]
        times = np.bincount(runs[same], minlength=len(begin))
        found.append((key, begin + origin, size, mixed(whole + size.astype(np.uint64)), times > 1))
    if not found:
        none = np.zeros(0, np.uint64)
        return Runs(none, none.astype(np.int64), none.astype(np.int64), none, none.astype(bool))
    return Runs(*(np.concatenate(x) for x in zip(*found, strict=True)))


def start_hashes(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the ``width`` bytes from each start; the starts ascend."""
    up, down = powers()
    out = []
    for origin in range(0, len(data), PIECE):
        here = starts[np.searchsorted(starts, origin) : np.searchsorted(starts, origin + PIECE)] - origin
        if len(here):
            byte = BYTE_HASH[data[origin : origin + PIECE + width]]
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(byte * up[: len(byte)], dtype=np.uint64)])
            out.append(mixed((sums[here + width] - sums[here]) * down[here]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


@dataclass
class Keys:
    """A block's runs sorted by key and hash: groups of equal runs, and groups of equal keys."""

    order: np.ndarray
    run_of: np.ndarray  # per sorted run, the number of its equal-run group
    run_first: np.ndarray  # per equal-run group, its first sorted run
    key_of: np.ndarray  # per equal-run group, the number of its key
    keys: np.ndarray
    different: np.ndarray  # per key, equal-run groups
    total: np.ndarray  # per key, runs
    several: np.ndarray  # per key


def by_key(runs: Runs) -> Keys:
    order = np.lexsort((runs.start, runs.hash, runs.key))
    key, hash_ = runs.key[order], runs.hash[order]
    new_key = np.ones(len(order), bool)
    new_key[1:] = key[1:] != key[:-1]
    new_run = new_key.copy()
    new_run[1:] |= hash_[1:] != hash_[:-1]
    run_first = np.flatnonzero(new_run)
    key_of = (np.cumsum(new_key) - 1)[run_first]
    keys = key[new_key]
    several = np.zeros(len(keys), bool)
    several[(np.cumsum(new_key) - 1)[runs.several[order]]] = True
    total = np.diff(np.append(np.flatnonzero(new_key), len(order)))
    different = np.bincount(key_of, minlength=len(keys))
    return Keys(order, np.cumsum(new_run) - 1, run_first, key_of, keys, different, total, several)


def _shared_out(numbers: np.ndarray, buckets: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ascending numbers by bucket: the places, and where the numbers of each stand, still ascending."""
    home = (numbers % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    places, firsts = np.unique(home[order], return_index=True)
    return places, np.split(order, firsts[1:]) if len(places) else []


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()
    names = ["block", "kind", "place", "numbers", "first", "second"]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _name_keys(width: int, buckets: int):
    """Every key of a block once: its run's hash, the number of its different runs, and whether it repeats here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, lengths = opened(row)
                runs = find_runs(data, lengths, width)
                found = by_key(runs)
                if not len(found.keys):
                    continue
                firsts = np.concatenate([[0], np.cumsum(found.different)[:-1]])
                hash_ = runs.hash[found.order][found.run_first[firsts]]
                note = found.different * 4 + (found.total > 1) * 2 + found.several
                places, slices = _shared_out(found.keys, buckets)
                yield from _rows(
                    [
                        (row["block"], KEYS, p, pack_sorted(found.keys[s]), hash_[s].tobytes(), pack_numbers(note[s]))
                        for p, s in zip(places.tolist(), slices, strict=True)
                    ]
                ).to_batches()

    return run


def _judge_keys(rows: pa.Table) -> pa.Table:
    """One bucket of keys: for every block the keys that need more than nothing, and their class."""
    found = rows.to_pylist()
    keys = [unpack_sorted(r["numbers"]) for r in found]
    flat = np.concatenate(keys)
    hash_ = np.concatenate([np.frombuffer(r["first"], "<u8") for r in found])
    note = np.concatenate([unpack_numbers(r["second"]) for r in found]).astype(np.int64)
    _, at = np.unique(flat, return_inverse=True)
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.diff(at[order], prepend=-1))
    different = np.add.reduceat(note[order] // 4, first)
    low, high = np.minimum.reduceat(hash_[order], first), np.maximum.reduceat(hash_[order], first)
    blocks = np.diff(np.append(first, len(order)))
    here = np.maximum.reduceat(note[order] & 2, first) > 0
    inner = np.maximum.reduceat((note[order] & 1) | (note[order] >= 8), first) > 0
    one = (low == high) & ~inner
    kind = np.where(one, np.where((blocks > 1) | here, SAME, ALONE), DIFFER)
    kind = np.where((kind == DIFFER) & (different > HOT_RUNS), HOT, kind)[at]
    out, stops = [], np.cumsum(list(map(len, keys)))
    for r, stop, own in zip(found, stops, keys, strict=True):
        mine = kind[stop - len(own) : stop]
        keep = mine != ALONE
        if keep.any():
            packed = squeeze(mine[keep].astype(np.uint8).tobytes())
            out.append((r["block"], KEYS, r["place"], pack_sorted(own[keep]), packed, b""))
    return _rows(out)


def _classes(found: Keys, replies: list[dict]) -> np.ndarray:
    """The class of each of a block's keys."""
    kind = np.zeros(len(found.keys), np.uint8)
    for r in replies:
        if r["kind"] == KEYS:
            kind[np.searchsorted(found.keys, unpack_sorted(r["numbers"]))] = np.frombuffer(unsqueeze(r["first"]), np.uint8)
    return kind


def _differing(found: Keys, kind: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of equal runs that go to shards, the shard of each and the part of its keys; in a fixed order."""
    groups = np.flatnonzero(kind[found.key_of] == DIFFER)
    keys = found.keys[found.key_of[groups]]
    home, part = (keys % np.uint64(shards)).astype(np.int64), (keys // np.uint64(shards) % np.uint64(PARTS)).astype(np.int64)
    order = np.lexsort((part, home))
    return groups[order], home[order], part[order]


def _hot_starts(runs: Runs, found: Keys, kind: np.ndarray) -> np.ndarray:
    hot = np.sort(found.order[kind[found.key_of[found.run_of]] == HOT])
    return spread(runs.start[hot], runs.count[hot])


def _name_runs(width: int, shards: int):
    """The differing runs of a block for each shard, and the hashes of its hot starts for each bucket."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        answers, out = replies.to_pylist(), []
        for row in blocks.to_pylist():
            data, lengths = opened(row)
            runs = find_runs(data, lengths, width)
            found = by_key(runs)
            kind = _classes(found, answers)
            groups, home, parts = _differing(found, kind, shards)
            places, firsts = np.unique(home, return_index=True)
            split = np.split(np.arange(len(groups)), firsts[1:]) if len(places) else []
            for place, mine in zip(places.tolist(), split, strict=True):
                part, counts = groups[mine], np.bincount(parts[mine], minlength=PARTS)
                chosen = found.order[found.run_first[part]]
                sizes = runs.count[chosen] + width - 1
                body = data[spread(runs.start[chosen], sizes)].tobytes()
                times = np.diff(np.append(found.run_first, len(found.order)))[part] > 1
                note = sizes * 2 + times
                out.append((row["block"], RUNS, place, pack_numbers(counts), squeeze(body), pack_numbers(note)))
            hot = np.unique(start_hashes(data, _hot_starts(runs, found, kind), width))
            places, slices = _shared_out(hot, shards)
            for place, s in zip(places.tolist(), slices, strict=True):
                out.append((row["block"], STARTS, place, pack_sorted(hot[s]), b"", b""))
        return _rows(out)

    return run


def _judge_runs(width: int):
    """A shard of runs: which of their starts repeat.  A bucket of starts: which of them two blocks have."""

    def run(rows: pa.Table) -> pa.Table:
        found, out = rows.to_pylist(), []
        if found and found[0]["kind"] == STARTS:
            asked = [unpack_sorted(r["numbers"]) for r in found]
            numbers, times = np.unique(np.concatenate(asked), return_counts=True)
            for r, own in zip(found, asked, strict=True):
                hits = own[np.isin(own, numbers[times > 1], assume_unique=True)]
                if len(hits):
                    out.append((r["block"], STARTS, r["place"], pack_sorted(hits), b"", b""))
            return _rows(out)
        bodies = [unsqueeze(r.pop("first")) for r in found]
        notes = [np.split(unpack_numbers(r["second"]), np.cumsum(unpack_numbers(r["numbers"]))[:-1]) for r in found]
        at, marks = [0] * len(found), [[] for _ in found]
        for part in range(PARTS):
            # Equal strings have one key and so lie in one part.
            numbers: dict[bytes, int] = {}
            again: list[bool] = []
            asked = []
            for n, body in enumerate(bodies):
                mine = []
                for value in notes[n][part].tolist():
                    string = body[at[n] : at[n] + value // 2]
                    at[n] += value // 2
                    if string in numbers:
                        again[numbers[string]] = True
                    else:
                        numbers[string] = len(numbers)
                        again.append(bool(value & 1))
                    mine.append(numbers[string])
                asked.append(mine)
            starts = repeated_starts(list(numbers), width)
            for k, twice in enumerate(again):
                if twice:
                    starts[k][:] = True
            for own, mine in zip(marks, asked, strict=True):
                own.extend(starts[k] for k in mine)
        for r, own in zip(found, marks, strict=True):
            bits = np.packbits(np.concatenate(own))
            out.append((r["block"], RUNS, r["place"], b"", squeeze(bits.tobytes()), b""))
        return _rows(out)

    return run


def _remove(width: int, shards: int):
    """The descriptions of a block without the bytes of repeated strings."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        answers = replies.to_pylist()
        ids, sizes, spans, kept = [], [], [], []
        for row in blocks.to_pylist():
            data, lengths = opened(row)
            runs = find_runs(data, lengths, width)
            found = by_key(runs)
            kind = _classes(found, answers)
            repeated = np.zeros(len(data) + 1, bool)
            same = found.order[kind[found.key_of[found.run_of]] == SAME]
            repeated[spread(runs.start[same], runs.count[same])] = True

            groups, home, _ = _differing(found, kind, shards)
            marks = {r["place"]: r["first"] for r in answers if r["kind"] == RUNS}
            ends = np.append(found.run_first[1:], len(found.order))
            places, firsts = np.unique(home, return_index=True)
            for place, part in zip(places.tolist(), np.split(groups, firsts[1:]) if len(places) else [], strict=True):
                counts = runs.count[found.order[found.run_first[part]]]
                bits = np.unpackbits(np.frombuffer(unsqueeze(marks[place]), np.uint8), count=int(counts.sum()))
                stops = np.cumsum(counts)
                # Every run of a group of equal runs has the starts of the one that was sent.
                times = ends[part] - found.run_first[part]
                members = found.order[spread(found.run_first[part], times)]
                from_bit = np.repeat(stops - counts, times)
                width_each = np.repeat(counts, times)
                hits = bits[spread(from_bit, width_each)].astype(bool)
                repeated[spread(runs.start[members], width_each)[hits]] = True

            hot = _hot_starts(runs, found, kind)
            if len(hot):
                hashes = start_hashes(data, hot, width)
                names, times = np.unique(hashes, return_counts=True)
                parts = [unpack_sorted(r["numbers"]) for r in answers if r["kind"] == STARTS]
                repeated[hot[np.isin(hashes, np.concatenate([names[times > 1], *parts]))]] = True

            edge = np.zeros(len(data) + width + 1, np.int32)
            starts = np.flatnonzero(repeated)
            edge[starts] += 1
            edge[starts + width] -= 1
            covered = np.cumsum(edge[: len(data)]) > 0
            stops = np.cumsum(lengths)
            # Spans begin and end inside one text: a text's last and the next one's first bytes are apart.
            begins = covered.copy()
            begins[1:] &= ~covered[:-1]
            heads = (stops - lengths)[lengths > 0]
            begins[heads] |= covered[heads]
            finish = covered.copy()
            finish[:-1] &= ~covered[1:]
            tails = (stops - 1)[lengths > 0]
            finish[tails] |= covered[tails]
            begins, finish = np.flatnonzero(begins), np.flatnonzero(finish) + 1
            low = np.searchsorted(begins, stops - lengths)
            high = np.searchsorted(begins, stops)
            rest = data[~covered].tobytes()
            left = np.concatenate([[0], np.cumsum(~covered)])
            for n, id_ in enumerate(unpack_ids(row["ids"], len(lengths))):
                start, stop = int(stops[n] - lengths[n]), int(stops[n])
                mine = slice(low[n], high[n])
                ids.append(id_)
                sizes.append(stop - start)
                edges = zip((begins[mine] - start).tolist(), (finish[mine] - start).tolist(), strict=True)
                spans.append([{"start": a, "end": b} for a, b in edges])
                kept.append(rest[left[start] : left[stop]])
        return pa.table(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
            names=["id", "n_bytes", "spans", "kept"],
        )

    return run


def remove_repeats(listings: DataFrame, width: int = 200) -> DataFrame:
    """(id, n_bytes, spans, kept): every ``description`` as UTF-8 bytes, the removed spans, and what is left.

    A byte is removed if a string of ``width`` bytes covers it that also begins at any other place, in the same or
    another description; strings are judged on the input, may overlap and never cross descriptions.  ``spans`` are the
    maximal removed runs of bytes, end exclusive.  A null or empty description has 0 bytes and no span.  One row per
    input row, repeated rows and null ids included (repeats of a row remove one another); other columns are not
    read; an empty table gives none.  ``width`` is 2 to 254.
    """
    if not 2 <= width <= 254:
        raise ValueError("width is 2 to 254")
    text_bytes = listings.agg(F.sum(F.octet_length(F.col("description").cast("string")).cast("long"))).first()[0] or 0
    partitions = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions * BUCKETS_PER_PARTITION, -(-text_bytes // BUCKET_BYTES))
    blocks = textblocks.blocks(listings)
    named = blocks.mapInArrow(_name_keys(width, buckets), NAMED)
    classes = named.groupBy("place").applyInArrow(_judge_keys, NAMED)
    by_block = blocks.groupBy("block")
    differing = by_block.cogroup(classes.groupBy("block")).applyInArrow(_name_runs(width, buckets), NAMED)
    judged = differing.groupBy("kind", "place").applyInArrow(_judge_runs(width), NAMED)
    answers = classes.unionByName(judged)
    out = "id long, n_bytes long, spans array<struct<start: int, end: int>>, kept binary"
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(_remove(width, buckets), out)
