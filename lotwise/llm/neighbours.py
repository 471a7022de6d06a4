"""Nearest neighbours by a block matrix join with int8 products and quantisation bounds.

Every vector is rounded to int8 components with a scale of its own, and the length of its rounding error is
kept.  Products of int8 tiles give the distance of the rounded vectors exactly; the true distance differs by at
most the two errors.  A pair whose lower bound exceeds the query's k-th upper bound cannot count; the others are
worked out in doubles from the original vectors and kept in a heap per query.  The bounds are safe, so the answer
is the exact one: recall is 1.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame

from lotwise.llm.tiles import in_cells, merged

#: Queries and candidates of one product tile; pairs recomputed at once.
TILE_QUERIES = 256
TILE_CANDIDATES = 2048
RECOMPUTED = 16_384
#: Allowance for rounding in the bounds themselves, relative to the vectors' lengths.
SLACK = 1e-6


def quantised(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 components, each row's scale, and the length of each row's rounding error."""
    scale = np.abs(matrix).max(axis=1) / 127
    scale[scale == 0] = 1
    small = np.rint(matrix / scale[:, None]).astype(np.int8)
    error = np.sqrt(((matrix - small * scale[:, None]) ** 2).sum(axis=1))
    return small, scale, error


def _int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of int8 rows; sums of up to 1,000 of them are exact in single precision."""
    total = np.zeros((len(a), len(b)))
    for first in range(0, a.shape[1], 1000):
        part = slice(first, first + 1000)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of paired rows, summed from the first component to the last."""
    total = np.zeros(len(a))
    for k in range(a.shape[1]):
        total += (a[:, k] - b[:, k]) ** 2
    return np.sqrt(total)


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): for every query row, the ``k`` candidates of least Euclidean distance.

    Both tables have ``vec_id`` and ``embedding``; the project has no vectors of its own, so any table of
    these two columns will do.  Candidates of the query's own id and of another length are left out; fewer than
    ``k`` are all listed; ties go to the smaller ``vec_id``.  Null ids or vectors, empty and zero vectors and ones
    with null or non-finite components take no part.  A query row that repeats is answered once per row.
    """

    def search(query_ids, asked, ids, matrix):
        small, scale, error = quantised(matrix)
        length = (small.astype(np.float64) ** 2).sum(axis=1) * scale**2
        for first in range(0, len(asked), TILE_QUERIES):
            rows, own = asked[first : first + TILE_QUERIES], query_ids[first : first + TILE_QUERIES]
            q_small, q_scale, q_error = quantised(rows)
            q_length = (q_small.astype(np.float64) ** 2).sum(axis=1) * q_scale**2
            heaps: list[list[tuple[float, int]]] = [[] for _ in rows]
            worst = np.full(len(rows), np.inf)
            for start in range(0, len(ids), TILE_CANDIDATES):
                tile = slice(start, start + TILE_CANDIDATES)
                products = _int8_products(q_small, small[tile]) * (q_scale[:, None] * scale[None, tile])
                about = np.sqrt(np.maximum(q_length[:, None] + length[None, tile] - 2 * products, 0))
                room = q_error[:, None] + error[None, tile]
                room += SLACK * np.sqrt(q_length[:, None] + length[None, tile])
                upper = about + room
                upper[own[:, None] == ids[None, tile]] = np.inf
                if upper.shape[1] > k:
                    bound = np.minimum(worst, np.partition(upper, k - 1, axis=1)[:, k - 1])
                else:
                    bound = worst
                alive = (about - room <= bound[:, None]) & (own[:, None] != ids[None, tile])
                row, column = np.nonzero(alive)
                column = column + start
                exact = np.empty(len(row))
                for at in range(0, len(row), RECOMPUTED):
                    part = slice(at, at + RECOMPUTED)
                    exact[part] = _distances(rows[row[part]], matrix[column[part]])
                order = np.lexsort((column, exact, row))  # candidates lie by id
                row, column, exact = row[order], column[order], exact[order]
                ends = np.searchsorted(row, np.arange(len(rows) + 1))
                for n in range(len(rows)):
                    heap, low, high = heaps[n], ends[n], min(ends[n + 1], ends[n] + k)
                    for distance, id_ in zip(exact[low:high].tolist(), ids[column[low:high]].tolist(), strict=True):
                        entry = (-distance, -id_)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        else:
                            break
                    if len(heap) == k:
                        worst[n] = -heap[0][0]
            for heap in heaps:
                best = sorted((-d, -i) for d, i in heap)
                yield [i for _, i in best], [d for d, _ in best]

    return merged(in_cells(queries, candidates, search, "double", skip_zero=True), k, descending=False)
