"""Burrows-Wheeler transform and common prefixes of a collection, one symbol per string and round.

The column-wise construction of Bauer, Cox and Rosone: round j inserts the suffix of length j of every string.  Where
it goes follows from the rank of its first symbol in the transform so far, and its common prefix with its neighbours
from the smallest common prefix between two occurrences of that symbol.  The transform is kept by symbol and then place,
so that a rank is looked up and a round merges its new symbols in instead of sorting all.  Transform and common prefixes
lie in files that every round reads and writes from beginning to end; they are unnamed scratch of the running task, gone
with it, and never read by another.  No suffix array is kept: the finished transform is walked from the strings'
ends to find each suffix's place.

A symbol is a number of bytes that divides the width, a fifth of it at most, named by its rank among those that occur
(two names of half its bytes make one of the whole).  Every string is as many sequences, from its first byte, its second
and so on: the suffixes are the same, the rounds as many times fewer.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

import numpy as np

from lotwise.llm.wire import spread

#: Common prefixes whose least is kept for ranges that cover them.
STRETCH = 8
LOW, HIGH = np.uint64(0xFFFFFFFF), np.uint64(32)
#: Stands before a whole sequence; no name is as high.
START = ~LOW

class _Sequential:
    """A column in two scratch files: the one of the last round is read, the other written."""

    def __init__(self, kind: type):
        self.files, self.kind, self.size = [tempfile.TemporaryFile(), tempfile.TemporaryFile()], np.dtype(kind), 0

    def read(self) -> np.ndarray:
        self.files[0].seek(0)
        return np.frombuffer(self.files[0].read(self.size), self.kind)

    def write(self, values: np.ndarray) -> None:
        self.files.reverse()
        self.files[0].seek(0)
        self.files[0].write(values.data)
        self.files[0].flush()
        self.size = values.nbytes

    def close(self) -> None:
        for file in self.files:
            file.close()


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low:high]) of every range, none empty: its ends, and by doubled steps the whole stretches between."""
    whole = len(values) // STRETCH
    levels = [values[: whole * STRETCH].reshape(-1, STRETCH).min(axis=1)]
    while len(levels[-1]) > 1 << len(levels) - 1:
        step = 1 << len(levels) - 1
        wider = levels[-1].copy()
        np.minimum(wider[:-step], levels[-1][step:], out=wider[:-step])
        levels.append(wider)
    near = np.arange(STRETCH)
    found = np.minimum(
        values[np.minimum(low[:, None] + near, high[:, None] - 1)].min(axis=1),
        values[np.maximum(high[:, None] - 1 - near, low[:, None])].min(axis=1),
    )
    first, last = -(-low // STRETCH), high // STRETCH
    long = np.flatnonzero(last > first)
    if len(long):
        first, last = first[long], last[long]
        level = np.frexp(last - first)[1] - 1
        table = np.stack(levels)
        between = np.minimum(table[level, first], table[level, last - (1 << level)])
        found[long] = np.minimum(found[long], between)
    return found


def _names(data: np.ndarray, unit: int) -> np.ndarray:
    """The rank of the ``unit`` bytes from every place of the data, padded with zeros behind its end."""
    length, names = min(unit, 8), np.zeros(len(data), np.uint64)
    padded = np.append(data, np.zeros(length, np.uint8))
    for k in range(length):
        names = names << np.uint64(8) | padded[k : k + len(data)]
    while True:
        names = np.unique(names, return_inverse=True)[1].astype(np.uint64)
        if length == unit:
            return names
        ahead = min(length, unit - length)
        names = names << HIGH | np.append(names[ahead:], np.zeros(min(ahead, len(names)), np.uint64))
        length += ahead


def _sequences(strings: Sequence[bytes], unit: int) -> tuple[np.ndarray, np.ndarray]:
    """All symbols, and the length of each sequence: every string from its first byte, then from its second, and so on."""
    names = _names(np.frombuffer(b"".join(strings), np.uint8), unit)
    sizes = np.array(list(map(len, strings)), dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    symbols, lengths = [], []
    for shift in range(unit):
        counts = np.maximum(sizes - shift, 0) // unit
        nth = spread(np.zeros(len(counts), np.int64), counts)
        symbols.append(names[np.repeat(starts + shift, counts) + unit * nth])
        lengths.append(counts)
    return np.concatenate(symbols), np.concatenate(lengths)


def repeated_starts(strings: Sequence[bytes], width: int) -> list[np.ndarray]:
    """Per string and start, whether the ``width`` bytes from there also begin at another place of the collection.

    ``width`` is at most 254.
    """
    if not strings:
        return []
    unit = next(u for u in range(max(1, width // 5), 0, -1) if width % u == 0)
    symbols, lengths = _sequences(strings, unit)
    data = np.append(symbols, np.uint64(0)) << HIGH
    total, most, depth = len(lengths), int(lengths.max()), width // unit
    ends = np.cumsum(lengths)
    transform, prefixes = _Sequential(np.uint64), _Sequential(np.uint8)
    try:
        place = np.arange(total)
        transform.write(np.sort(np.where(lengths > 0, data[np.maximum(ends - 1, 0)], START) | place.astype(np.uint64)))
        prefixes.write(np.zeros(total, np.uint8))
        active = np.flatnonzero(lengths > 0)
        for length in range(1, most + 1):
            active = active[lengths[active] >= length]
            sorted_, common = transform.read(), prefixes.read()
            count = len(sorted_)
            at = place[active]
            by = np.argsort(at)
            active, at = active[by], at[by]
            first = data[ends[active] - length]
            rank = np.searchsorted(sorted_, first | at.astype(np.uint64))
            new = total + rank
            before, after = sorted_[np.maximum(rank - 1, 0)], sorted_[np.minimum(rank + 1, count - 1)]
            has_before = (rank > 0) & (before >> HIGH == first >> HIGH)
            has_after = (rank + 1 < count) & (after >> HIGH == first >> HIGH)

            old = np.ones(count + len(active), bool)
            old[new] = False
            deeper = np.empty(len(old), np.uint8)
            deeper[old] = common
            deeper[new] = 0
            found = np.flatnonzero(has_before)
            left = _least(common, (before[found] & LOW).astype(np.int64) + 1, at[found] + 1)
            deeper[new[found]] = np.minimum(left, depth - 1) + 1
            found = np.flatnonzero(has_after)
            right = _least(common, at[found] + 1, (after[found] & LOW).astype(np.int64) + 1)
            deeper[new[found] + 1] = np.minimum(right, depth - 1) + 1
            prefixes.write(deeper)

            moved = np.flatnonzero(old).astype(np.uint64)[sorted_ & LOW] | sorted_ & ~LOW
            ahead = np.where(lengths[active] > length, data[np.maximum(ends[active] - length - 1, 0)], START)
            fresh = np.sort(ahead | new.astype(np.uint64))
            spots = np.searchsorted(moved, fresh) + np.arange(len(fresh))
            old[:] = True
            old[spots] = False
            merged = np.empty(len(old), np.uint64)
            merged[old], merged[spots] = moved, fresh
            transform.write(merged)
            place[active] = new

        order, common = (transform.read() & LOW).astype(np.int64), np.append(prefixes.read(), np.uint8(0))
    finally:
        transform.close()
        prefixes.close()
    step = np.empty(len(order), np.int64)
    step[order] = total + np.arange(len(order))

    sizes = np.array(list(map(len, strings)), dtype=np.int64)
    starts = np.maximum(sizes - width + 1, 0)
    flat = np.zeros(int(starts.sum()), bool)
    firsts = np.cumsum(starts) - starts
    string = np.arange(total) % len(sizes)
    shift = np.arange(total) // len(sizes)
    place, active = np.arange(total), np.arange(total)
    for length in range(1, most + 1):
        active = active[lengths[active] >= length]
        place[active] = step[place[active]]
        if length >= depth:
            at = place[active]
            start = shift[active] + unit * (lengths[active] - length)
            flat[firsts[string[active]] + start] = (common[at] >= depth) | (common[at + 1] >= depth)
    return np.split(flat, np.cumsum(starts)[:-1])
