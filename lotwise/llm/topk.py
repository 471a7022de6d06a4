"""Exact top-k search by inner product: tiles of queries and shards, partial selection, a tree of merges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.tiles import in_cells, merged

#: Queries and candidates of one matrix product.
TILE_QUERIES = 512
TILE_CANDIDATES = 2048


def scaled(vectors: DataFrame, factor: float = 64.0) -> DataFrame:
    """Vectors with each component x, as a double, turned into floor(factor * x)."""
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: _floor(x * F.lit(factor)))
    return vectors.select("vec_id", whole.alias("embedding"))


def _floor(x):
    """Floor that stays a double, so that infinities and NaN are still seen."""
    return F.when(F.abs(x) < F.lit(2.0**52), F.floor(x).cast("double")).otherwise(x)


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """A mask of each row's ``k`` largest, of equal ones the first columns."""
    if scores.shape[1] <= k:
        return np.ones(scores.shape, bool)
    limit = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k, None]
    above, equal = scores > limit, scores == limit
    room = k - above.sum(axis=1, keepdims=True)
    return above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact whole-number products: in doubles while every sum stays below 2^53, else in 64-bit integers."""
    largest = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if largest < 2**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def top_products(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row, the ``k`` candidates of largest inner product.

    Both tables have ``vec_id`` and ``embedding`` with whole-number components; the project has no
    vectors of its own, so any table of these two columns will do.  Candidates of the query's own id and of
    another length are left out; fewer than ``k`` candidates are all listed; ties go to the smaller ``vec_id``.
    Null ids or vectors, empty vectors and ones with null or non-finite components take no part.  A query row
    that repeats is answered once per row; scores must fit a long.  Other columns are not read.
    """

    def search(query_ids, asked, ids, matrix):
        for first in range(0, len(asked), TILE_QUERIES):
            rows, own = asked[first : first + TILE_QUERIES], query_ids[first : first + TILE_QUERIES, None]
            places, values = [], []
            for start in range(0, len(ids), TILE_CANDIDATES):
                shard = ids[start : start + TILE_CANDIDATES]
                scores = _product(rows, matrix[start : start + TILE_CANDIDATES])
                lowest = -np.inf if scores.dtype.kind == "f" else np.iinfo(np.int64).min
                scores[own == shard] = lowest
                row, column = np.nonzero(_best(scores, k))
                kept = own[row, 0] != shard[column]
                places.append(np.column_stack([row[kept], column[kept] + start]))
                values.append(scores[row[kept], column[kept]].astype(np.int64))
            place, value = np.concatenate(places), np.concatenate(values)
            order = np.lexsort((place[:, 1], -value, place[:, 0]))  # candidates lie by id
            place, value = place[order], value[order]
            ends = np.searchsorted(place[:, 0], np.arange(len(rows) + 1))
            for low, high in zip(ends[:-1], np.minimum(ends[1:], ends[:-1] + k), strict=True):
                yield ids[place[low:high, 1]], value[low:high]

    return merged(in_cells(queries, candidates, search, "long", skip_zero=False), k, descending=True)
