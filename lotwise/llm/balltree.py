"""Exact ranked text search over listings: sparse ball trees searched best-first, whole-number scores at the leaves.

A listing's vector holds a weight for each of its terms, and a search's score for it is the inner product with the
search's own terms.  Terms of all listings are counted once and kept in blocks (``term_blocks``); they give the corpus
statistics and serve every search.  Searches are gathered to blocks of bounded size, and every block of listings meets
every block of searches.  There the listings, projected on the terms of those searches, which are all an inner product
can see, form a ball tree: each node has the centroid of its listings and the largest distance from it.  No listing
below a node can score more than <q, centroid> + |q| * radius.  Nodes are opened best-first while that bound, rounded
up by more than the error of its sums, reaches the worst of the search's best k so far; at leaves listings are scored
in whole numbers.  A worker carries the best k from block to block, so that later trees are cut off early.

No listing or term is a key of a shuffle: the only grouped rows are document frequencies, combined before they move,
and each worker's best lists, merged in two steps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.wire import pack_numbers, pack_words, spread, unpack_numbers, unpack_words
from lotwise.session import saved

#: Text bytes and listings of a block of listings; term bytes and searches expected in a block of searches.
BLOCK_BYTES, BLOCK_LISTINGS = 12 << 20, 4096
SEARCH_BYTES, SEARCHES = 32 << 10, 512
#: Listings of a leaf; a split with less than one part in so many on one side is made at the middle instead.
LEAF, LOPSIDED = 32, 8
#: Lists merged at once below the root.
FAN_IN = 64
#: Room for the rounding of sums: relative to what is added up.
SLACK = 1e-9

BLOCK = "block long, ids binary, sizes binary, words binary, holders binary, starts binary, codes binary, counts binary"
QUERY_BLOCK = "searches int, search_ids binary, words binary, weights binary, starts binary, codes binary, repeats binary"
LISTS = "search_id long, part int, entries array<struct<order: long, id: long>>"

#: Bytes to terms: A-Z in lower case, 0-9, a-z and all bytes of other characters as they are, the rest a space.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and digits and of any character beyond ASCII, A-Z in lower case."""
    return (text or "").encode().translate(_TERMS).split(b" ")


class _Numbers(dict):
    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def _binary(**values: bytes) -> dict:
    return {name: pa.array([value], pa.binary()) for name, value in values.items()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listings to blocks: ids, terms per listing, distinct terms with the listings that hold them, and counts."""
    at = TaskContext.get().partitionId() << 32
    numbers, ids, sizes, starts, codes, counts, held = _Numbers(), [], [], [0], [], [], 0

    def block() -> pa.RecordBatch:
        every = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        times = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        row = _binary(
            ids=np.array(ids, "<i8").tobytes(), sizes=pack_numbers(np.array(sizes)), words=pack_words(list(numbers)),
            holders=pack_numbers(np.bincount(every, minlength=len(numbers))), starts=pack_numbers(np.array(starts)),
            codes=pack_numbers(every), counts=pack_numbers(times),
        )
        return pa.RecordBatch.from_pydict({"block": pa.array([at], pa.int64()), **row})

    for batch in batches:
        for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = [w for w in terms_of(text.as_py()) if w]
            if not words:
                continue
            own, times = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            ids.append(id_)
            sizes.append(len(words))
            codes.append(own)
            counts.append(times)
            starts.append(starts[-1] + len(own))
            held += sum(map(len, words)) + len(words)
            if held >= BLOCK_BYTES or len(ids) >= BLOCK_LISTINGS:
                yield block()
                at, numbers, ids, sizes, starts, codes, counts, held = at + 1, _Numbers(), [], [], [0], [], [], 0
    if ids:
        yield block()


def term_blocks(listings: DataFrame) -> DataFrame:
    """The counted terms of all listings, for any number of searches; one narrow row per block of 12 MB of text.

    Listings without a term or without an id take no part.  Whoever uses them more than once stores them.
    """
    chosen = listings.filter(F.col("id").isNotNull()).select(
        F.col("id").cast("long").alias("id"), F.col("description").cast("string").alias("description")
    )
    return chosen.mapInArrow(_cut, BLOCK)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [unpack_numbers(x) for x in batch.column(0).to_pylist()]
        listings, terms = [len(x) for x in sizes], [int(x.sum(dtype=np.int64)) for x in sizes]
        yield pa.RecordBatch.from_arrays([pa.array(listings, pa.int64()), pa.array(terms, pa.int64())], names=["n", "terms"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words, holders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            terms = pa.array(unpack_words(words), pa.binary())
            yield pa.RecordBatch.from_arrays([terms, pa.array(unpack_numbers(holders).astype(np.int64))], names=["term", "df"])


@dataclass
class _Searches:
    """A block of searches: sparse whole-number weights over the block's terms."""

    ids: np.ndarray
    words: list[bytes]
    weights: np.ndarray
    starts: np.ndarray
    codes: np.ndarray
    repeats: np.ndarray


def _gathered(rows: pa.Table) -> pa.Table:
    """The searches (search_id, entries) of one block, packed."""
    numbers, ids, weights, starts, codes, repeats = _Numbers(), [], [], [0], [], []
    for row in rows.to_pylist():
        ids.append(row["search_id"])
        for entry in row["entries"]:
            code = numbers[entry["term"]]
            if code == len(weights):
                weights.append(entry["weight"])
            codes.append(code)
            repeats.append(entry["repeats"])
        starts.append(len(codes))
    packed = _binary(
        search_ids=np.array(ids, "<i8").tobytes(), words=pack_words(list(numbers)), weights=np.array(weights, "<i8").tobytes(),
        starts=pack_numbers(np.array(starts)), codes=pack_numbers(np.array(codes)), repeats=pack_numbers(np.array(repeats)),
    )
    return pa.table({"searches": pa.array([len(ids)], pa.int32()), **packed})


def _opened(row: dict) -> _Searches:
    return _Searches(
        np.frombuffer(row["search_ids"], "<i8"), unpack_words(row["words"]), np.frombuffer(row["weights"], "<i8"),
        unpack_numbers(row["starts"]).astype(np.int64), unpack_numbers(row["codes"]).astype(np.int64),
        unpack_numbers(row["repeats"]).astype(np.int64),
    )


class BallTree:
    """A ball tree over sparse rows of non-negative whole numbers: ``values`` at columns ``codes``, ``starts`` by row."""

    def __init__(self, width: int, starts: np.ndarray, codes: np.ndarray, values: np.ndarray):
        self.width, self.starts, self.codes, self.values = width, starts, codes, values
        self.order: list[np.ndarray] = []
        self.first, self.stop, self.below = [], [], []
        self.centroids, self.radii = [], []
        self.squares = self._summed(np.arange(len(starts) - 1), values.astype(np.float64) ** 2)
        self._grow(np.arange(len(starts) - 1), 0)
        rows = np.concatenate(self.order)
        lengths = np.diff(starts)[rows]
        self.rows = rows
        self.leaf_starts = np.concatenate([[0], np.cumsum(lengths)])
        taken = spread(starts[rows], lengths)
        self.leaf_codes, self.leaf_values = codes[taken], values[taken]
        self.centroids, self.radii = np.stack(self.centroids), np.array(self.radii)

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.diff(self.starts)[rows]
        return spread(self.starts[rows], lengths), np.repeat(np.arange(len(rows)), lengths)

    def _summed(self, rows: np.ndarray, weighted: np.ndarray) -> np.ndarray:
        taken, owner = self._entries(rows)
        return np.bincount(owner, weights=weighted[taken], minlength=len(rows))

    def _distances(self, rows: np.ndarray, point: np.ndarray, square: float) -> np.ndarray:
        """Squared distances from a point, each rounded up by more than its error."""
        taken, owner = self._entries(rows)
        products = np.bincount(owner, weights=self.values[taken] * point[self.codes[taken]], minlength=len(rows))
        return np.maximum(self.squares[rows] - 2 * products + square, 0) + SLACK * (self.squares[rows] + square)

    def _point(self, row: int) -> np.ndarray:
        point, own = np.zeros(self.width), slice(self.starts[row], self.starts[row + 1])
        point[self.codes[own]] = self.values[own]
        return point

    def _grow(self, every: np.ndarray, first: int) -> None:
        """Nodes by a stack of their own: the row farthest from the centroid and the one farthest from it divide the rest."""
        stack = [(every, first, None)]
        while stack:
            rows, first, parent = stack.pop()
            node = len(self.radii)
            if parent is not None:
                self.below[parent].append(node)
            taken, _ = self._entries(rows)
            centroid = np.bincount(self.codes[taken], weights=self.values[taken], minlength=self.width) / len(rows)
            apart = self._distances(rows, centroid, float(centroid @ centroid))
            self.centroids.append(centroid)
            self.radii.append(float(np.sqrt(apart.max())))
            self.first.append(first)
            self.stop.append(first + len(rows))
            self.below.append([])
            if len(rows) <= LEAF:
                self.order.append(rows)
                continue
            one = rows[int(np.argmax(apart))]
            from_one = self._distances(rows, self._point(one), self.squares[one])
            two = rows[int(np.argmax(from_one))]
            side = from_one - self._distances(rows, self._point(two), self.squares[two])
            order = np.argsort(side, kind="stable")
            cut = int((side <= 0).sum())
            if min(cut, len(rows) - cut) * LOPSIDED < len(rows):
                cut = len(rows) // 2
            nearer = np.zeros(len(rows), bool)
            nearer[order[:cut]] = True
            left, right = rows[nearer], rows[~nearer]
            stack.append((right, first + len(left), node))
            stack.append((left, first, node))

    def search(self, codes: np.ndarray, repeats: np.ndarray, ids: np.ndarray, best: list[tuple[int, int]], k: int) -> int:
        """Puts rows of positive score into ``best``, a heap of (score, -id); returns how many rows were scored."""
        query = np.zeros(self.width, np.int64)
        query[codes] = repeats
        norm = float(np.sqrt((repeats.astype(np.float64) ** 2).sum())) * (1 + SLACK)
        bounds = (self.centroids[:, codes] @ repeats.astype(np.float64) + norm * self.radii) * (1 + SLACK) + 1
        waiting, scored = [(-bounds[0], 0)], 0
        while waiting:
            bound, node = heapq.heappop(waiting)
            if len(best) == k and -bound < best[0][0]:
                break
            if self.below[node]:
                for child in self.below[node]:
                    heapq.heappush(waiting, (max(bound, -bounds[child]), child))
                continue
            low, high = self.leaf_starts[self.first[node]], self.leaf_starts[self.stop[node]]
            products = self.leaf_values[low:high] * query[self.leaf_codes[low:high]]
            edges = self.leaf_starts[self.first[node] : self.stop[node]] - low
            rows = self.rows[self.first[node] : self.stop[node]]
            scores = np.add.reduceat(products, edges)
            scored += len(rows)
            for place in np.flatnonzero(scores >= max(1, best[0][0] if len(best) == k else 1)).tolist():
                entry = int(scores[place]), -int(ids[rows[place]])
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return scored


def _vectors(row: dict, searches: _Searches, n: int, total: int):
    """A block's listings over the searches' terms: ids, starts, codes and whole-number values; others are left out."""
    wanted = {word: number for number, word in enumerate(searches.words)}
    place = np.fromiter((wanted.get(w, -1) for w in unpack_words(row["words"])), np.int64)
    codes, counts = unpack_numbers(row["codes"]).astype(np.int64), unpack_numbers(row["counts"]).astype(np.int64)
    starts, sizes = unpack_numbers(row["starts"]).astype(np.int64), unpack_numbers(row["sizes"]).astype(np.int64)
    ids = np.frombuffer(row["ids"], "<i8")
    known = place[codes] >= 0
    owner = np.repeat(np.arange(len(ids)), np.diff(starts))[known]
    codes, counts = place[codes[known]], counts[known]
    length = 25 + np.array([75 * size * n // total for size in sizes.tolist()], np.int64)
    values = searches.weights[codes] * (1_000_000_000 * counts // (1000 * counts + 8 * length[owner]))
    kept, lengths = np.unique(owner, return_counts=True)
    return ids[kept], np.concatenate([[0], np.cumsum(lengths)]), codes, values


def _search(searches: _Searches, n: int, total: int, k: int):
    """Blocks of listings to one best list per search and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, int]]] = [[] for _ in searches.ids]
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts, codes, values = _vectors(row, searches, n, total)
                if not len(ids):
                    continue
                tree = BallTree(len(searches.words), starts, codes, values)
                for number, own in enumerate(best):
                    part = slice(searches.starts[number], searches.starts[number + 1])
                    if part.start < part.stop:
                        tree.search(searches.codes[part], searches.repeats[part], ids, own, k)
        found = [(id_, sorted(own, reverse=True)) for id_, own in zip(searches.ids.tolist(), best, strict=True) if own]
        entries = [[{"order": -score, "id": -id_} for score, id_ in own] for _, own in found]
        kind = pa.list_(pa.struct([("order", pa.int64()), ("id", pa.int64())]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([id_ for id_, _ in found], pa.int64()),
                pa.array([TaskContext.get().partitionId()] * len(found), pa.int32()), pa.array(entries, kind),
            ],
            names=["search_id", "part", "entries"],
        )

    return run


def _query_blocks(searches: DataFrame, blocks: DataFrame, n: int) -> DataFrame:
    """The searches with their terms' weights, in blocks of bounded size."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = [w for w in terms_of(text) if w]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([id_] * len(words), pa.int64()), pa.array(words, pa.binary())], names=["search_id", "term"]
                )

    chosen = searches.filter(F.col("search_id").isNotNull()).select(
        F.col("search_id").cast("long").alias("search_id"), F.col("text").cast("string").alias("text")
    )
    asked = chosen.mapInArrow(split, "search_id long, term binary").groupBy("search_id", "term").agg(F.count("term").alias("repeats"))
    asked = saved(asked)
    listed = blocks.select("words", "holders").mapInArrow(_frequencies, "term binary, df long")
    wanted = listed.join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    odds = (F.lit(2 * n + 2).cast("double")) / (2 * F.col("df") + 1)
    weighed = asked.join(wanted.withColumn("weight", F.floor(1000 * F.log(odds)).cast("long")), "term")
    entries = F.sort_array(F.collect_list(F.struct("term", "weight", "repeats"))).alias("entries")
    held = F.sum(F.length("term") + 1).alias("held")
    whole = saved(weighed.groupBy("search_id").agg(entries, held))
    found, size = whole.agg(F.count("held"), F.sum("held")).first()
    parts = max(-(-found // SEARCHES), -(-(size or 0) // SEARCH_BYTES), 1)
    dealt = whole.withColumn("part", F.pmod(F.xxhash64("search_id"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(_gathered, QUERY_BLOCK)


def rank_listings(listings: DataFrame, searches: DataFrame, k: int = 10) -> DataFrame:
    """(search_id, rank, id, score): for every search text, the ``k`` listings of highest score, best first.

    ``listings`` has ``id`` and ``description``, ``searches`` has ``search_id`` and ``text``; terms are those of
    ``terms_of``, over whole texts.  With N listings that have a term, L their terms in all and df the listings that hold
    a term, its weight is floor(1000 * ln((2N + 2) / (2df + 1))).  A listing of n terms has m = 25 + 75nN div L, and a
    term that occurs tf times in it is worth 1000000000 tf div (1000 tf + 8m); its score adds up weight times worth over
    the search's terms, repeats included, exactly.  Scores of 0 are not listed; equal ones go to the smaller id; fewer
    than ``k`` are all listed.

    Null, empty and termless texts take no part, neither do rows with a null id.  A repeated listing row is a listing of
    its own and may be listed beside its copy; rows of one search id are one search, their terms together.  Other columns
    are not read; an empty table on either side gives no rows.
    """
    blocks = saved(term_blocks(listings))
    n, total = blocks.select("sizes").mapInArrow(_sums, "n long, terms long").agg(F.sum("n"), F.sum("terms")).first()
    asked = saved(_query_blocks(searches, blocks, n or 0))
    lists = None
    # One pass over the blocks for each block of searches, which is bounded and goes to the tasks as it is.
    for row in asked.toLocalIterator() if n else ():
        found = blocks.mapInArrow(_search(_opened(row.asDict()), n, total, k), LISTS)
        lists = found if lists is None else lists.unionByName(found)
    if lists is None:
        return listings.sparkSession.createDataFrame([], "search_id long, rank int, id long, score long")

    def smallest(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy(*key).agg(F.slice(F.sort_array(F.flatten(F.collect_list("entries"))), 1, k).alias("entries"))

    leaves = lists.withColumn("branch", (F.col("part") / FAN_IN).cast("int"))
    root = smallest(smallest(leaves, "search_id", "branch"), "search_id")
    ranked = root.select("search_id", F.posexplode("entries").alias("place", "entry"))
    return ranked.select(
        "search_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("entry.id").alias("id"), (-F.col("entry.order")).alias("score")
    )
