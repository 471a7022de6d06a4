"""The document archive as a partitioned table, bytes and provenance in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators.documents import new_for_archive
from lotwise.schemas import RAW_DOCUMENT

ARCHIVE_SCHEMA = (
    "storage_key string, "
    + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RAW_DOCUMENT.fields)
    + ", sha256 string, size_bytes long, fetched_date date"
)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The archive; source and day are folders, so filters on them prune files."""
    return spark.read.schema(ARCHIVE_SCHEMA).parquet(path)


def append_archive(spark: SparkSession, path: str, docs: DataFrame, first_write: bool = False) -> None:
    """Append documents whose key is new; a repeated call adds nothing, and a first write refuses an archive that exists.

    Rows are brought together by folder before the write in parts of the size that the session advises: small
    folders share a task, and one source's busy day is split over as many as its bytes need.
    """
    folder = ["source_id", "fetched_date"]
    if first_write:
        known = spark.createDataFrame([], ARCHIVE_SCHEMA)
    else:
        # A key names its source and day: only the folders of this batch can hold it.
        wanted = docs.select("source_id", F.to_date("fetched_at").alias("fetched_date")).distinct()
        known = read_archive(spark, path).join(wanted, folder, "left_semi")
    fresh = new_for_archive(known, docs).withColumn("fetched_date", F.to_date("fetched_at"))
    spread = fresh.hint("rebalance", "source_id", "fetched_date")
    spread.write.mode("error" if first_write else "append").partitionBy(*folder).parquet(path)


def append_table(rows: DataFrame, path: str, by: list[str]) -> None:
    """Append rows to a history table (health, revisions) laid out in folders."""
    rows.write.mode("append").partitionBy(*by).parquet(path)


def write_snapshot(rows: DataFrame, path: str) -> None:
    """A new listing snapshot in its own folder; the one before stays readable."""
    rows.hint("rebalance", "source_id").write.mode("error").partitionBy("source_id").parquet(path)
