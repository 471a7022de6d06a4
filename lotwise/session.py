"""Session helpers.

A cluster session is used as it is: only the time zone is pinned, because every
stored moment is UTC and naive text is read as UTC.  ``local_session`` is for
tests and the benchmark.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether the shuffle files of a query are removed when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: How saved tables are written.  Rows may hold whole blocks: pages and row groups are closed by their bytes, looked at
#: after every row and not after a hundred, and zstd needs no buffers of a page's size outside the heap.
SAVED_AS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size.row.check.min": "1",
    "parquet.block.size.row.check.min": "1",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the session zone to UTC; leave every other setting to the cluster."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for cut lineage and stream checkpoints.

    The cluster names it in ``spark.checkpoint.dir``; a private folder is made
    only when that is unset and the session runs inside one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
    return tempfile.mkdtemp(prefix="lotwise-")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside are removed when each ends; for writes that nothing shares shuffles with."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def saved(rows: DataFrame) -> DataFrame:
    """Rows written once as a table under the checkpoint folder and read from there by every later use.

    For results that are costly to work out and read several times; they survive lost executors.
    A written table rather than a checkpoint call, which works its input out twice.  Shuffle files of the write are
    removed when it ends: nothing reads them again.
    """
    spark = rows.sparkSession
    path = f"{checkpoint_root(spark)}/saved-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        rows.write.options(**SAVED_AS).parquet(path)
    table = spark.read.schema(rows.schema).parquet(path)
    table.saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes ``saved`` tables that no later job reads: what was made of them has been saved itself."""
    for table in tables:
        session = table.sparkSession
        path = session._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def local_session(cores: int | str = 8, partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lotwise")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LOTWISE_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
