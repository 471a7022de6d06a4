"""Block matrices of vectors: rows gathered to blocks, blocks met in cells of a grid, top lists merged in a tree.

A block holds some rows of one partition as a matrix, whatever their ids or values, so no key can be hot.
Query blocks and candidate blocks are dealt over the sides of a grid whose size follows the numbers of rows;
each cell gets a bounded number of rows of either.  A query meets every candidate: that is what exact search
asks for, in blocks and not in pairs of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = "block long, dims int, ids binary, vectors binary"
LISTS = "query_row long, query_id long, part int, ids array<long>, scores array<{kind}>"
#: Rows of one block, and expected rows of a cell on either side.
BLOCK_ROWS = 1024
CELL_QUERIES = 4096
CELL_CANDIDATES = 8192
#: Lists merged at once below the root of the tree.
FAN_IN = 64


def blocks(vectors: DataFrame, skip_zero: bool) -> DataFrame:
    """Usable vectors as matrices; null ids, null vectors and ones with null or non-finite components fall out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dims: int) -> pa.RecordBatch:
            nonlocal number
            ids, rows = zip(*held.pop(dims), strict=True)
            number += 1
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([number], pa.int64()),
                    "dims": pa.array([dims], pa.int32()),
                    "ids": pa.array([np.array(ids, dtype="<i8").tobytes()], pa.binary()),
                    "vectors": pa.array([np.concatenate(rows).astype("<f8").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            lists = batch.column(1)
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)  # a null component becomes NaN
            offsets = lists.offsets.to_numpy()
            missing = lists.is_null().to_pylist()
            for k, id_ in enumerate(batch.column(0).to_pylist()):
                row = values[offsets[k] : offsets[k + 1]]
                if missing[k] or id_ is None or not len(row) or not np.isfinite(row).all():
                    continue
                if skip_zero and not row.any():
                    continue
                held.setdefault(len(row), []).append((id_, row))
                if len(held[len(row)]) == BLOCK_ROWS:
                    yield block(len(row))
        for dims in list(held):
            yield block(dims)

    wanted = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return wanted.mapInArrow(run, BLOCK)


def opened(table: pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each number of dimensions: row keys, ids and the matrix of all blocks, by id."""
    by_dims: dict[int, list] = {}
    for row in table.to_pylist():
        ids = np.frombuffer(row["ids"], dtype="<i8")
        rows = (row["block"] << 10) + np.arange(len(ids))
        by_dims.setdefault(row["dims"], []).append((rows, ids, np.frombuffer(row["vectors"]).reshape(len(ids), -1)))
    for dims, parts in sorted(by_dims.items()):
        rows, ids, matrix = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((rows, ids))
        yield dims, rows[order], ids[order], matrix[order]


def in_cells(
    queries: DataFrame, candidates: DataFrame, search: Callable, score_kind: str, skip_zero: bool
) -> DataFrame:
    """Per query and candidate part, the list that ``search`` returns for one cell of the grid.

    ``search(query_ids, query_matrix, ids, matrix)`` gives, per query, the chosen ids and scores, best first.
    """

    def side(vectors: DataFrame, rows: int):
        total = vectors.agg(F.ceil(F.count("vec_id") / F.lit(rows))).scalar()
        return F.greatest(total, F.lit(1)).cast("int")

    def dealt(parts: DataFrame, own: str, across: str, own_size, across_size) -> DataFrame:
        home = F.pmod(F.xxhash64("block"), own_size).cast("int")
        placed = parts.withColumns({own: home, across: F.explode(F.sequence(F.lit(0), across_size - 1))})
        return placed.select("candidate_part", "query_part", "block", "dims", "ids", "vectors")

    rows_across, columns_across = side(queries, CELL_QUERIES), side(candidates, CELL_CANDIDATES)
    left = dealt(blocks(queries, skip_zero), "query_part", "candidate_part", rows_across, columns_across)
    right = dealt(blocks(candidates, skip_zero), "candidate_part", "query_part", columns_across, rows_across)
    kind = pa.int64() if score_kind == "long" else pa.float64()

    def run(key, asked: pa.Table, there: pa.Table) -> pa.Table:
        found = {dims: (ids, matrix) for dims, _, ids, matrix in opened(there)}
        out = {"query_row": [], "query_id": [], "ids": [], "scores": []}
        for dims, rows, query_ids, matrix in opened(asked):
            if dims in found:
                out["query_row"].extend(rows.tolist())
                out["query_id"].extend(query_ids.tolist())
                for ids, scores in search(query_ids, matrix, *found[dims]):
                    out["ids"].append(ids)
                    out["scores"].append(scores)
        kinds = {"query_row": pa.int64(), "query_id": pa.int64(), "ids": pa.list_(pa.int64()), "scores": pa.list_(kind)}
        columns = {name: pa.array(values, kinds[name]) for name, values in out.items()}
        part = pa.array([key[0].as_py()] * len(out["ids"]), pa.int32())
        return pa.table([columns["query_row"], columns["query_id"], part, columns["ids"], columns["scores"]],
                        names=["query_row", "query_id", "part", "ids", "scores"])

    cell = "candidate_part", "query_part"
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(run, LISTS.format(kind=score_kind))


def merged(lists: DataFrame, k: int, descending: bool) -> DataFrame:
    """(query_id, rank, vec_id, score) from partial lists: some parts' lists first, then those results.

    No task gathers more than ``FAN_IN`` lists of a query at the leaves; at the root there are parts / FAN_IN.
    """
    sign = -1 if descending else 1

    def smallest(rows: DataFrame, *key: str) -> DataFrame:
        entries = F.slice(F.sort_array(F.flatten(F.collect_list("entries"))), 1, k)
        return rows.groupBy(*key).agg(entries.alias("entries"))

    entry = F.transform(
        F.arrays_zip("ids", "scores"), lambda x: F.struct((x["scores"] * sign).alias("order"), x["ids"].alias("vec_id"))
    )
    leaves = lists.select("query_row", "query_id", (F.col("part") / FAN_IN).cast("int").alias("branch"), entry.alias("entries"))
    root = smallest(smallest(leaves, "query_row", "query_id", "branch"), "query_row", "query_id")
    ranked = root.select("query_id", F.posexplode("entries").alias("place", "entry"))
    score = F.col("entry.order") * sign
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("entry.vec_id").alias("vec_id"), score.alias("score"))
