"""Listings kept by a stream of parsed records, and run reports kept by a stream of attempts.

The store is cut into buckets by a hash of the listing key.  A batch rewrites the buckets it touches and nothing
else; a small pointer table, written last, names the version in which each bucket now lies and the batch that
put it there.  Readers follow the newest pointers, so a batch that fails half way leaves the store as it was.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.crawl import crawl_report
from lotwise.operators.upsert import KEY, busy_listings, merge_listings, revisions, snapshot, with_fingerprint
from lotwise.schemas import LISTING

#: Buckets of a store; fixed for its life, in proportion to its size.
BUCKETS = 256
POINTERS = "bucket int, in_version long, token string"


@dataclass(frozen=True)
class Pointers:
    """The newest state of a store: its version, the batch that made it, and the version of each bucket."""

    version: int
    token: str | None
    buckets: dict[int, int]

    def paths(self, root: str, wanted: set[int] | None = None) -> list[str]:
        return [data_path(root, v, b) for b, v in sorted(self.buckets.items()) if wanted is None or b in wanted]


def data_path(root: str, version: int, bucket: int) -> str:
    return f"{root}/listings/version={version}/bucket={bucket}"


def read_pointers(spark: SparkSession, root: str) -> Pointers:
    """At most one row per bucket; a store that does not exist yet has version 0 and no buckets."""
    try:
        rows = spark.read.schema(f"{POINTERS}, version long").parquet(f"{root}/pointers")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return Pointers(0, None, {})
    newest = rows.filter(F.col("version") == rows.agg(F.max("version")).scalar()).collect()
    return Pointers(newest[0].version, newest[0].token, {r.bucket: r.in_version for r in newest})


def read_listings(spark: SparkSession, root: str, wanted: set[int] | None = None) -> DataFrame:
    """The listings as the last whole batch left them, or those of some buckets."""
    paths = read_pointers(spark, root).paths(root, wanted)
    return spark.read.schema(LISTING).parquet(*paths) if paths else spark.createDataFrame([], LISTING)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int")


def upsert_batch(root: str, stream: str = "listings", buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: the store merged with batch after batch.

    ``stream`` names one run of a query with its checkpoint; a query that starts anew over an existing store takes
    a new name and goes on from what is stored.  A batch that is run again after it was committed changes nothing;
    one that failed before is written again over its own paths.  The merge is written once, and both the snapshot
    and the history are read from it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        token, now = f"{stream}:{number}", read_pointers(spark, root)
        if now.token == token:
            return
        version = now.version + 1
        touched = {r.bucket for r in batch.select(_bucket(buckets).alias("bucket")).distinct().collect()}
        if not touched:
            return
        paths = now.paths(root, touched)
        stored = spark.read.schema(LISTING).parquet(*paths) if paths else spark.createDataFrame([], LISTING)
        busy = busy_listings(batch)
        merged_at = f"{root}/merges/version={version}"
        merge_listings(stored, with_fingerprint(batch), hot=busy).write.mode("overwrite").parquet(merged_at)
        merged = spark.read.parquet(merged_at)
        whole = snapshot(merged).withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/listings/version={version}")
        revisions(merged, hot=busy).write.mode("overwrite").parquet(f"{root}/revisions/version={version}")
        rows = [(b, v, token) for b, v in sorted({**now.buckets, **dict.fromkeys(touched, version)}.items())]
        pointers = spark.createDataFrame(rows, POINTERS)
        pointers.coalesce(1).write.mode("overwrite").parquet(f"{root}/pointers/version={version}")

    return write


def report_stream(attempts: DataFrame) -> DataFrame:
    """Counters per (run, source) over a stream of attempts (complete or update mode)."""
    return crawl_report(attempts)


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """Revisions of all committed batches."""
    last = read_pointers(spark, root).version
    history = spark.read.parquet(f"{root}/revisions").filter(F.col("version") <= last)
    return history.withColumnRenamed("version", "batch").orderBy(F.col("batch"))
