"""Archived documents: hashes, keys, lookups, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Media type -> file ending.
EXTENSIONS = {
    "application/pdf": ".pdf",
    "text/html": ".html",
    "application/xhtml+xml": ".html",
    "application/json": ".json",
    "text/plain": ".txt",
    "text/xml": ".xml",
    "application/xml": ".xml",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": ".xlsx",
    "application/vnd.ms-excel": ".xls",
    "image/jpeg": ".jpg",
    "image/png": ".png",
}
# Counters that differ on every download without the page changing.
VISITOR_COUNTER = r"(?s)(itor Count.{0,200}?)[0-9]{4,}"
PAYLOAD_COUNTER = r'(\\"children\\":)[0-9]{6,}(\]\]\}\],\[\\"\$\\",\\"div)'


def mime_extension(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.substring_index(mime, ";", 1)))), F.lit(".bin"))


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def canonical_sha256(content: Column) -> Column:
    """Hash with the volatile counters removed; bytes pass through Latin-1 unchanged.

    Of the payload counter only what stands before the digits is kept.
    """
    text = F.decode(content, "ISO-8859-1")
    text = F.regexp_replace(text, VISITOR_COUNTER, "$1")
    text = F.regexp_replace(text, PAYLOAD_COUNTER, "$1")
    return F.sha2(F.encode(text, "ISO-8859-1"), 256)


def storage_key() -> Column:
    """``source/yyyy/mm/dd/<sha256><ending>`` from source_id, fetched_at, sha256, mime_type."""
    return F.concat(
        F.col("source_id"), F.lit("/"), F.date_format("fetched_at", "yyyy/MM/dd"), F.lit("/"),
        F.col("sha256"), mime_extension(F.col("mime_type")),
    )


def with_archive_key(docs: DataFrame) -> DataFrame:
    """Raw documents with hash, size and storage key."""
    return docs.withColumns(
        {"sha256": content_sha256(F.col("content")), "size_bytes": F.octet_length("content").cast("long")}
    ).withColumn("storage_key", storage_key())


def new_for_archive(archive: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents whose key the archive lacks, one per key, earliest fetch first.

    Keys are settled on narrow columns; the bytes are moved once, to meet the chosen keys, and rows that are alike
    to the moment and URL are numbered where they then lie.
    """
    keyed = with_archive_key(docs)
    narrow = keyed.select("storage_key", "fetched_at", "url")
    fresh = narrow.join(archive.select("storage_key"), "storage_key", "left_anti")
    chosen = fresh.groupBy("storage_key").agg(F.min(F.struct("fetched_at", "url")).alias("first"))
    chosen = chosen.select("storage_key", F.col("first.fetched_at").alias("_at"), F.col("first.url").alias("_url"))
    same = F.col("fetched_at").eqNullSafe(F.col("_at")) & F.col("url").eqNullSafe(F.col("_url"))
    met = keyed.join(chosen, "storage_key").filter(same)
    nth = F.row_number().over(Window.partitionBy("storage_key").orderBy(F.col("mime_type")))
    picked = met.withColumn("_nth", nth).filter(F.col("_nth") == 1)
    return picked.select("storage_key", *[c for c in keyed.columns if c != "storage_key"])


def provenance(docs: DataFrame) -> DataFrame:
    """Metadata without the bytes."""
    return with_archive_key(docs).drop("content")


def contains_hash(archive: DataFrame, wanted: DataFrame) -> DataFrame:
    """(source_id, sha256) pairs already archived on any date."""
    return wanted.join(archive.select("source_id", "sha256"), ["source_id", "sha256"], "left_semi")


def count_per_source(docs: DataFrame) -> DataFrame:
    return (
        docs.groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("documents"))
        .orderBy(F.col("documents").desc(), F.col("source_id"))
    )


def scan_archive(archive: DataFrame, source_id: str, limit: int | None = None) -> DataFrame:
    """A source's documents, newest first."""
    rows = archive.filter(F.col("source_id") == source_id).orderBy(F.col("fetched_at").desc(), F.col("storage_key"))
    return rows.limit(limit) if limit else rows


def recent(docs: DataFrame, moment: str, tie: str, limit: int) -> DataFrame:
    return docs.orderBy(F.col(moment).desc(), F.col(tie)).limit(limit)


def stamp_documents(listings: DataFrame, documents: DataFrame) -> DataFrame:
    """Listings with the id of the document of the same (url, sha256), null when none is archived."""
    found = documents.select("url", "sha256", F.col("id").alias("source_document_id"))
    return listings.drop("source_document_id").join(found, ["url", "sha256"], "left")


def state_with_document(state: DataFrame, documents: DataFrame) -> DataFrame:
    """URL state beside its current document, if any."""
    return state.join(documents, ["url", "document"], "left")


def split_seen(discovered: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(never fetched, fetched before)."""
    known = state.select("url")
    return discovered.join(known, "url", "left_anti"), discovered.join(known, "url", "left_semi")


def many_versions(docs: DataFrame) -> DataFrame:
    """URLs with more than one archived version."""
    return docs.groupBy("url").agg(F.count(F.lit(1)).alias("versions")).filter(F.col("versions") > 1)


def first_and_last(docs: DataFrame) -> DataFrame:
    """First and last version of each URL with several.

    The combined aggregate carries times, lengths and hashes, not the texts, so a URL
    with very many versions costs no more than one row per partial result.
    """
    body = F.struct(
        F.length("content").cast("long").alias("chars"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256")
    )
    moment = F.struct("fetched_at", "sha256") if "sha256" in docs.columns else F.col("fetched_at")
    ends = docs.groupBy("url").agg(
        F.count(F.lit(1)).alias("versions"),
        F.min("fetched_at").alias("first_at"),
        F.max("fetched_at").alias("last_at"),
        F.min_by(body, moment).alias("older"),
        F.max_by(body, moment).alias("newer"),
    )
    return ends.filter(F.col("versions") > 1).select(
        "url", "versions", "first_at", "last_at",
        F.col("older.chars").alias("first_chars"), F.col("newer.chars").alias("last_chars"),
        F.col("older.sha256").eqNullSafe(F.col("newer.sha256")).alias("identical"),
    )
