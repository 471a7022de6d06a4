"""Facet counts kept beside the listings and altered by what a batch changes.

The table holds how many listings have a value of a facet, and how many have it together with a value of another facet
that may be asked for, published and unpublished ones apart.  A batch adds one signed row per count that it moves: what
its listings were before counts down, what they are now counts up, and rows that stayed as they were cancel out before
anything is spread.  A page without filters, or with one facet chosen, reads counts instead of listings.

Batches lie side by side, partitioned by the chosen facet and sorted by its value, and are summed by the reader;
``fold_batches`` sums them once for all.  A batch that is run again, under its number, replaces what it wrote.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.operators.search import EQUALITY_FACETS, FACET_COLUMNS, SearchQuery
from lotwise.schemas import FACET_SIZE

#: The facet of the row that counts every listing, and the chosen facet where none is.
EVERYTHING = "everything"
NONE = "none"
COUNTS = "published boolean, facet string, value string, by_value string, n long"


def _combinations(listings: DataFrame, sign: int) -> DataFrame:
    values = [F.col(column).cast("string").alias(name) for name, column in FACET_COLUMNS.items()]
    published = F.coalesce(F.col("is_published"), F.lit(False)).alias("published")
    return listings.select(published, *values, F.lit(sign).cast("long").alias("n"))


def _slots() -> Column:
    """The counts in which one combination of values takes part."""

    def slot(facet: str, value: Column, by: str, by_value: Column) -> Column:
        return F.struct(
            F.lit(facet).alias("facet"), value.alias("value"), F.lit(by).alias("by"), by_value.alias("by_value")
        )

    blank = F.lit("")
    alone = [slot(name, F.col(name), NONE, blank) for name in FACET_COLUMNS]
    chosen = [
        slot(name, F.col(name), other, F.col(other)) for name in FACET_COLUMNS for other in EQUALITY_FACETS if other != name
    ]
    every = F.array(slot(EVERYTHING, blank, NONE, blank), *alone, *chosen)
    return F.filter(every, lambda s: s["value"].isNotNull() & s["by_value"].isNotNull())


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts moved by listings that were ``before`` and are ``after``; listings missing on one side are new or gone.

    Combinations of values are summed first, so only those whose number changed are spread over their counts.
    """
    both = _combinations(before, -1).unionByName(_combinations(after, 1))
    moved = both.groupBy("published", *FACET_COLUMNS).agg(F.sum("n").alias("n")).filter("n <> 0")
    spread = moved.select("published", "n", F.explode(_slots()).alias("s"))
    keys = [F.col(f"s.{name}").alias(name) for name in ("facet", "value", "by", "by_value")]
    return spread.groupBy("published", *keys).agg(F.sum("n").alias("n")).filter("n <> 0")


def _write(counts: DataFrame, folder: str) -> None:
    laid = counts.repartition("by", "by_value", "facet").sortWithinPartitions("by", "by_value", "facet", "value")
    laid.write.mode("overwrite").partitionBy("by").parquet(folder)


def add_batch(before: DataFrame, after: DataFrame, path: str, batch: int) -> None:
    """Stores what one batch moved; ``before`` and ``after`` need hold only the listings that it touched."""
    _write(deltas(before, after), f"{path}/batch={batch}")


def read_counts(spark: SparkSession, path: str, by: str = NONE, where: Column | None = None, upto: int | None = None) -> DataFrame:
    """(published, facet, value, by_value, n) beside the values of one chosen facet, after the batches up to a number."""
    try:
        stored = spark.read.schema(f"{COUNTS}, batch int, by string").option("basePath", path).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], f"{COUNTS}, batch int, by string")
    rows = stored.filter(F.col("by") == by)
    if where is not None:
        rows = rows.filter(where)
    if upto is not None:
        rows = rows.filter(F.col("batch") <= upto)
    return rows.groupBy("published", "facet", "value", "by_value").agg(F.sum("n").alias("n")).filter("n <> 0")


def fold_batches(spark: SparkSession, path: str, folded: str) -> None:
    """The same counts as one batch 0 of a new table ``folded``; the next batch there is 1."""
    parts = [read_counts(spark, path, by).withColumn("by", F.lit(by)) for by in (NONE, *EQUALITY_FACETS)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    _write(whole, f"{folded}/batch=0")


def _seen(include_unpublished: bool) -> Column:
    return F.lit(True) if include_unpublished else F.col("published")


def facets(spark: SparkSession, path: str, query: SearchQuery, size: int = FACET_SIZE, upto: int | None = None) -> DataFrame:
    """``search.facets`` of a query without filters or with one facet of ``EQUALITY_FACETS`` chosen.

    Any other filter is refused: no kept count answers it.
    """
    chosen = [(name, getattr(query, name)) for name in EQUALITY_FACETS if getattr(query, name)]
    others = (query.min_price, query.max_price, query.auction_after, query.auction_before)
    if len(chosen) > 1 or query.words or query.status or any(x is not None for x in others):
        raise ValueError("kept counts answer a query with at most one chosen facet")
    seen = _seen(query.include_unpublished)
    rows = read_counts(spark, path, NONE, seen & (F.col("facet") != EVERYTHING), upto)
    for name, value in chosen:
        beside = read_counts(spark, path, name, seen & (F.col("by_value") == value), upto)
        rows = rows.filter(F.col("facet") == name).unionByName(beside)
    counts = rows.groupBy("facet", "value").agg(F.sum("n").alias("n"))
    place = Window.partitionBy("facet").orderBy(F.col("n").desc(), F.col("value").asc())
    return counts.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= size).drop("place")


def totals(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """``search.totals``: published listings, and the states and banks they cover."""
    rows = read_counts(spark, path, NONE, F.col("published") & F.col("facet").isin(EVERYTHING, "state", "bank"), upto)
    return rows.agg(
        F.coalesce(F.sum(F.when(F.col("facet") == EVERYTHING, F.col("n"))), F.lit(0)).alias("listings"),
        F.count_if(F.col("facet") == "state").alias("states"),
        F.count_if(F.col("facet") == "bank").alias("banks"),
    )


def count_by(spark: SparkSession, path: str, facet: str, upto: int | None = None) -> DataFrame:
    """``search.count_by`` of a facet's column, unpublished listings included."""
    rows = read_counts(spark, path, NONE, F.col("facet") == facet, upto)
    return rows.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), F.col("value"))


def count_listings(spark: SparkSession, path: str, published: bool = False, upto: int | None = None) -> DataFrame:
    rows = read_counts(spark, path, NONE, _seen(not published) & (F.col("facet") == EVERYTHING), upto)
    return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
