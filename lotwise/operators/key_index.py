"""Linkage kept up to date batch by batch, against a standing table of blocking keys.

``add_batch`` folds the batch's new listings to profiles, lets these meet one another and the stored profiles of the same
keys, stores the batch's tally, and adds its own rows to the key table.  Stored profiles never meet one another again:
after any number of batches the tallies add up to those of ``linkage.scan`` over all listings.

The table has one row per (class, key, profile), partitioned by batch and by a bucket of the key and sorted by key, so a
batch opens the buckets of its keys only, and of these the row groups in their range.  A key that holds very many stored
or new profiles is cut into slices on either side, and each pair of slices is a task of its own.  A batch that is run
again, under its number, reads the batches before it and replaces what it wrote.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import linkage, pair_blocks
from lotwise.operators.linkage import CELL_ROWS, KEY, REVIEW_FROM, earlier_kind, keyed, with_marks
from lotwise.operators.ordered import hot_keys
from lotwise.session import discard, saved, shuffles_removed

BUCKETS = 256


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def read_keys(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The key table, or its batches before a number; None where there is none yet."""
    try:
        stored = spark.read.option("basePath", f"{path}/keys").parquet(f"{path}/keys")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored if before is None else stored.filter(F.col("batch") < before)


def _cut(fresh: DataFrame, stored: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with the slices in which their rows meet."""

    def sliced(rows: DataFrame, own: str, sizes: DataFrame) -> DataFrame:
        """Rows with the slice of their own side; ``sizes`` has the slices of both sides for hot keys."""
        joined = rows.join(sizes, list(KEY), "left")
        other = "stored" if own == "fresh" else "fresh"
        count = {side: F.coalesce(F.col(f"{side}_slices"), F.lit(1)) for side in (own, other)}
        placed = joined.withColumns(
            {
                f"{own}_slice": F.pmod(F.xxhash64("profile_id"), count[own]).cast("int"),
                f"{other}_slice": F.explode(F.sequence(F.lit(0), count[other] - 1)),
            }
        )
        return placed.drop("fresh_slices", "stored_slices")

    def slices(rows: DataFrame, name: str) -> DataFrame:
        return hot_keys(rows, KEY, cell_rows).select(*KEY, F.ceil(F.col("_rows") / cell_rows).cast("int").alias(f"{name}_slices"))

    # Written first: where Spark knows the list's size it need not shuffle the rows to join it.
    sizes = saved(slices(fresh, "fresh").join(slices(stored, "stored"), list(KEY), "full"))
    return sliced(fresh, "fresh", sizes), sliced(stored, "stored", sizes)


def _met(fresh: DataFrame, stored: DataFrame, cell_rows: int) -> DataFrame:
    """Pairs (``a`` fresh, ``b`` stored) that share a key, each at the first kind they share."""
    a, b = (rows.alias(name) for rows, name in zip(_cut(fresh, stored, cell_rows), "ab", strict=True))
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEY, "fresh_slice", "stored_slice")]
    return a.join(b, reduce(lambda x, y: x & y, same) & ~earlier_kind())


def _tally_across(fresh: DataFrame, stored: DataFrame, cell_rows: int) -> DataFrame:
    """(relationship, pairs) of the same pairs that are not distinct, to be summed."""
    cells = F.col("fresh_slice").alias("cell_row"), F.col("stored_slice").alias("cell_column")
    known = F.col("asset_class").isNotNull()
    both = [
        rows.filter(known).select(*linkage.block_columns([]), *cells, F.lit(side).alias("side"))
        for side, rows in enumerate(_cut(fresh, stored, cell_rows), 1)
    ]
    run = pair_blocks.tallies(linkage.RULES, distinct=False)
    found = linkage.in_blocks(both[0].unionAll(both[1]), run, "relationship string, pairs long, leading_pairs long")
    return found.select("relationship", "pairs")


def touched(fresh: DataFrame, stored: DataFrame, buckets: int) -> DataFrame:
    """The stored rows of the buckets in which a batch has keys; at most ``buckets`` numbers reach the driver."""
    homes = [r[0] for r in fresh.select(_bucket(buckets)).distinct().collect()]
    return stored.filter(F.col("bucket").isin(homes))


def _store_keys(folded: DataFrame, path: str, batch: int, buckets: int) -> None:
    """The batch's rows of the key table, laid out by ranges of bucket and key, with the marks that later batches need."""
    rows = keyed(with_marks(folded)).drop("leading").withColumn("bucket", _bucket(buckets))
    laid = rows.repartitionByRange("bucket", *KEY, "profile_id").sortWithinPartitions("bucket", *KEY)
    with shuffles_removed(folded.sparkSession):
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/keys/batch={batch}")


def add_keys(listings: DataFrame, path: str, batch: int, buckets: int = BUCKETS) -> None:
    """Stores a batch of new listings without comparing them, for a table that only answers ``matches_of``.

    No pair is worked out, so the work grows with the batch.  ``read_tally`` knows nothing of such a batch.
    """
    folded = saved(linkage.profiles(listings))
    _store_keys(folded, path, batch, buckets)
    discard(folded)


def add_batch(listings: DataFrame, path: str, batch: int, buckets: int = BUCKETS, cell_rows: int = CELL_ROWS) -> None:
    """Links a batch of new listings with one another and with all stored ones, and stores them.

    Batches are numbered from 0 in the order they are added; ids are new in each.  A batch without listings stores an
    empty tally.
    """
    spark = listings.sparkSession
    folded = saved(with_marks(linkage.profiles(listings)))
    inside = linkage.pair_tally(folded, cell_rows).select("relationship", "pairs")
    rows = keyed(folded).drop("leading")
    stored = read_keys(spark, path, before=batch)
    if stored is not None:
        known = touched(rows, stored, buckets).drop("bucket", "batch")
        inside = inside.unionByName(_tally_across(rows, known, cell_rows))
    with shuffles_removed(spark):
        linkage.tally(inside).coalesce(1).write.mode("overwrite").parquet(f"{path}/tallies/batch={batch}")
    _store_keys(folded, path, batch, buckets)
    discard(folded)


def read_tally(spark: SparkSession, path: str) -> DataFrame:
    """One row as ``linkage.scan`` gives it, from the batches' tallies."""
    told = spark.read.schema("relationship string, pairs long, batch int").parquet(f"{path}/tallies")

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("relationship") == name, F.col("pairs"))), F.lit(0)).alias(name)

    return told.agg(of("duplicate"), of("reauction"), of("review"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("compared"))


def matches_of(listings: DataFrame, path: str, listing_id: int, buckets: int = BUCKETS) -> DataFrame:
    """(profile_id, members, relationship, score): the stored profiles that one listing is not distinct from.

    ``members`` listings have equal attributes; the listing's own profile counts one less.  Only the buckets of the
    listing's few keys are opened, and no key of another listing is worked out.
    """
    one = saved(keyed(linkage.profiles(listings.filter(F.col("id") == listing_id))).drop("leading"))
    stored = read_keys(listings.sparkSession, path)
    if stored is None:
        raise ValueError("no batch has been added")
    near = linkage.with_similarity(_met(one, touched(one, stored, buckets).drop("bucket", "batch"), CELL_ROWS))
    relationship, _ = linkage.verdict(F.col("score"))
    own = reduce(
        lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in linkage.COMPARED]
    )
    seen = F.col("b.members") - own.cast("int")
    kept = near.filter((F.col("score") >= REVIEW_FROM) & (seen > 0))
    return kept.select(F.col("b.profile_id").alias("profile_id"), seen.alias("members"), relationship.alias("relationship"), "score")
