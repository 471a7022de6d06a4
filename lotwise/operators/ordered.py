"""Neighbour rows in a long history, safe when one key holds much of the table.

A window over a whole key puts that key in one task.  Ordinary keys are handled that
way; a key with very many rows is cut into segments (days, batches)
that follow its order: rows look back inside their segment, and only each segment's
last row is carried over the boundary.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.session import saved

#: A key is hot above this many rows, whatever the table's size.
HOT_ROWS = 100_000


def hot_keys(rows: DataFrame, key: Sequence[str], floor: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``floor`` rows and their ``_rows``; counts are combined before the shuffle.

    Their number grows with the table, so joins with them carry no hint: Spark hands the list to every task only
    where its measured size allows that.
    """
    sizes = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"))
    return sizes.filter(F.col("_rows") > F.lit(floor))


def known_hot_keys(rows: DataFrame, key: Sequence[str], floor: int = HOT_ROWS) -> DataFrame | tuple[()]:
    """``hot_keys`` written first; an empty tuple where there are none, so that nothing is planned for them."""
    hot = saved(hot_keys(rows, key, floor))
    return () if hot.isEmpty() else hot


def with_previous(
    rows: DataFrame,
    key: Sequence[str],
    order: Sequence[str],
    segment: Column,
    value: Column,
    name: str = "previous",
    hot: DataFrame | tuple[()] | None = None,
) -> DataFrame:
    """Add ``name``: ``value`` of the row before in (key, order), null at the start.

    ``segment`` must never decrease along ``order``.  ``hot`` may name the hot keys when the
    caller has them already; keys are not null.  The table is shuffled once, by (key, segment),
    and the join with the carried rows keeps that layout.  With no hot keys (an empty tuple) it is shuffled by the key
    alone, a layout that an aggregate by the key shares.
    """
    if isinstance(hot, tuple):
        return rows.withColumn(name, F.lag(value).over(Window.partitionBy(*key).orderBy(*order)))
    hot = hot_keys(rows, key) if hot is None else hot
    cut = rows.join(hot, list(key), "left").withColumns(
        {"_segment": F.when(F.col("_rows").isNotNull(), segment), "_value": value}
    )
    place = [*key, "_segment"]
    inside = Window.partitionBy(*place).orderBy(*order)
    local = cut.withColumns({"_before": F.lag("_value").over(inside), "_nth": F.row_number().over(inside)})

    tails = (
        rows.join(hot, list(key), "left_semi")
        .withColumns({"_segment": segment, "_value": value})
        .groupBy(*place)
        .agg(F.max_by("_value", F.struct(*order)).alias("_tail"))
    )
    across = Window.partitionBy(*key).orderBy("_segment")
    carried = tails.select(*place, F.lag("_tail").over(across).alias("_carried"))
    joined = local.join(carried, place, "left")
    previous = F.when(F.col("_nth") == 1, F.col("_carried")).otherwise(F.col("_before"))
    return joined.withColumn(name, previous).drop("_segment", "_value", "_before", "_nth", "_carried", "_rows")
