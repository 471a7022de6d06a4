"""Groups of linked items from buckets of candidates, without writing a bucket's pairs.

Items that share a bucket may be linked.  First every item is compared with the smallest and the largest item of
its buckets: that connects most of a group of near copies with few comparisons.  Buckets whose items are still
in several components are then searched whole, in cells of bounded size: a cheap exact bound on small marks drops
pairs that cannot be linked, pairs already connected are passed over, and what is left is compared in full.  So no
link between different items is lost, whatever a bucket's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.components import components
from lotwise.session import discard, saved

#: Items of one bucket in a cell, per side.
CELL_ITEMS = 1024


def _passing(pairs: DataFrame, items: DataFrame, column: str, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The (a, b) whose values of ``column`` pass a test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left").to_pylist(), batch.column("right").to_pylist()
            good = pa.array([test(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield batch.select(["a", "b"]).filter(good)

    one = items.select(F.col("node").alias("a"), F.col(column).alias("left"))
    two = items.select(F.col("node").alias("b"), F.col(column).alias("right"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "left", "right")
    return both.mapInArrow(run, "a long, b long")


def _cells(rows: DataFrame, prepare: Callable, near: Callable) -> DataFrame:
    """Pairs of different components, in one bucket, that the bound lets through."""
    slices = F.ceil(F.col("bucket_items") / F.lit(CELL_ITEMS)).cast("int")
    own = F.pmod(F.xxhash64("node"), slices).cast("int")
    placed = rows.withColumns({"slice": own, "across": F.explode(F.sequence(F.lit(0), slices - 1))})
    placed = placed.select(
        "key", F.least("slice", "across").alias("low"), F.greatest("slice", "across").alias("high"),
        "slice", "node", "component", "mark",
    )

    def pairs_of(group: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        side, node, component = (np.array([r[k] for r in group]) for k in (3, 4, 5))
        if component.min() == component.max():
            return
        ready = prepare([r[6] for r in group])
        crossing = group[0][1] != group[0][2]
        for k in range(len(group) - 1):
            others = np.arange(k + 1, len(group))
            others = others[component[others] != component[k]]
            if crossing:
                others = others[side[others] != side[k]]
            if len(others):
                hits = others[near(ready, k, others)]
                if len(hits):
                    yield np.minimum(node[k], node[hits]), np.maximum(node[k], node[hits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def found() -> Iterator[pa.RecordBatch]:
            parts = list(pairs_of(group)) if len(group) > 1 else []
            if parts:
                a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and row[:3] != group[0][:3]:
                    yield from found()
                    group = []
                group.append(row)
        yield from found()

    keys = "key", "low", "high"
    sorted_ = placed.repartition(*keys).sortWithinPartitions(*keys, "node")
    return sorted_.mapInArrow(run, "a long, b long").distinct()


def linked_groups(
    buckets: DataFrame,
    items: Callable[[DataFrame], DataFrame],
    prepare: Callable[[list[bytes]], object],
    near: Callable[[object, int, np.ndarray], np.ndarray],
    linked: Callable[[bytes, bytes], bool],
    read: Callable[[], None] = lambda: None,
) -> DataFrame:
    """(node, component) of every linked item, saved.

    ``buckets`` has distinct (key, node).  ``items(nodes)`` gives (node, mark, body) of the wanted nodes.
    ``near(prepare(marks), k, others)`` must be true wherever ``linked(body, body)`` is.  ``read`` is called when
    the buckets have been read for the last time.
    """
    ends = buckets.groupBy("key").agg(
        F.min("node").alias("low"), F.max("node").alias("high"), F.count(F.lit(1)).alias("bucket_items")
    )
    shared = saved(buckets.join(ends.filter(F.col("low") < F.col("high")), "key"))
    read()
    known = saved(items(shared.select("node").distinct()))

    starts = shared.select(F.col("low").alias("a"), F.col("node").alias("b"))
    stars = starts.unionByName(shared.select(F.col("node").alias("a"), F.col("high").alias("b")))
    tried = saved(stars.filter(F.col("a") < F.col("b")).distinct())

    def verified(pairs: DataFrame) -> DataFrame:
        """Linked pairs, saved: the small marks are brought together first, and bodies for pairs that pass the bound."""
        second = np.array([1])
        close = saved(_passing(pairs, known, "mark", lambda x, y: bool(near(prepare([x, y]), 0, second)[0])))
        passed = saved(_passing(close, known, "body", linked))
        discard(close)
        return passed

    links = verified(tried)
    first = components(links)

    labelled = shared.select("key", "node", "bucket_items").join(first, "node", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "node"))
    several = labelled.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
    several = several.filter(F.col("least") < F.col("most")).select("key")
    rows = labelled.join(several, "key", "left_semi").join(known.select("node", "mark"), "node")
    left = _cells(rows, prepare, near).join(tried, ["a", "b"], "left_anti")
    more = saved(_passing(left, known, "body", linked))
    discard(shared, known, tried)
    found = first
    if not more.isEmpty():
        found = components(links.unionByName(more))
        discard(first)
    discard(links, more)
    return found
