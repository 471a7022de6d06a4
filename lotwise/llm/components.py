"""Connected components of links by alternating large and small stars (Kiveris et al., 2014).

Every step is a grouped minimum, combined before the shuffle, and a join that Spark may split where a node has
very many links.  Each round is written to the shared checkpoint folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.session import discard, saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over (a, b) with a > b."""
    both = links if not large else links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    around = both.join(lowest, "a")
    if large:
        moved = around.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = lowest.select("a", F.col("m").alias("b"))
        moved = around.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(own)
    return moved.filter(F.col("a") > F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node that has a link, saved: the smallest node it is connected with.

    ``links`` has two columns of whole numbers in any order, repeated and self links allowed.
    """
    first, second = links.columns
    pairs = links.select(F.greatest(first, second).alias("a"), F.least(first, second).alias("b"))
    now, mark = saved(pairs.filter(F.col("a") > F.col("b")).distinct()), None
    while True:
        sign = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.bit_xor(F.xxhash64("b", "a"))).first()
        if tuple(sign) == mark or not sign[0]:
            break
        before, mark, now = now, tuple(sign), saved(_star(_star(now, large=True), large=False))
        discard(before)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = saved(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots))
    discard(now)
    return found
