"""Declared schemas and the fixed numbers shared by several operators."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)
AREA = T.DecimalType(14, 2)
DEGREES = T.DecimalType(9, 6)
CONFIDENCE = T.DecimalType(3, 2)

# Thresholds that decide what is published, kept or reported.
PUBLISH_THRESHOLD = 0.70
RETENTION_DAYS = 90
STALE_SOURCE_HOURS = 48
IMMINENT_DAYS = 7
PAGE_SIZE = 20
MAX_PAGE_SIZE = 100
FACET_SIZE = 15

# Statuses that the clock cannot change.
TERMINAL_STATUSES = ("cancelled", "withdrawn", "stayed", "sold", "unknown")

# Fields whose changes make a history row.
TRACKED_FIELDS = (
    "reserve_price",
    "emd_amount",
    "bid_increment",
    "auction_start_at",
    "auction_end_at",
    "emd_deadline_at",
    "status",
    "possession_type",
    "address",
    "city",
    "state",
)

#: Normalised fields a source may state about one listing, in storage order.
CONTENT_FIELDS: tuple[tuple[str, T.DataType], ...] = (
    ("canonical_url", T.StringType()),
    ("asset_class", T.StringType()),
    ("asset_type", T.StringType()),
    ("asset_subtype", T.StringType()),
    ("title", T.StringType()),
    ("description", T.StringType()),
    ("address", T.StringType()),
    ("locality", T.StringType()),
    ("city", T.StringType()),
    ("district", T.StringType()),
    ("state", T.StringType()),
    ("pincode", T.StringType()),
    ("latitude", DEGREES),
    ("longitude", DEGREES),
    ("area_value", AREA),
    ("area_unit", T.StringType()),
    ("area_sqft", AREA),
    ("reserve_price", MONEY),
    ("emd_amount", MONEY),
    ("bid_increment", MONEY),
    ("outstanding_dues", MONEY),
    ("auction_start_at", T.TimestampType()),
    ("auction_end_at", T.TimestampType()),
    ("emd_deadline_at", T.TimestampType()),
    ("inspection_from", T.TimestampType()),
    ("inspection_to", T.TimestampType()),
    ("bank_name", T.StringType()),
    ("branch_name", T.StringType()),
    ("possession_type", T.StringType()),
    ("symbolic_possession_date", T.DateType()),
    ("physical_possession_date", T.DateType()),
    ("npa_date", T.DateType()),
    ("legal_basis", T.StringType()),
    ("authorised_officer_name", T.StringType()),
    ("authorised_officer_phone", T.StringType()),
    ("status", T.StringType()),
    ("asset_key", T.StringType()),
)
CONTENT_NAMES = tuple(name for name, _ in CONTENT_FIELDS)

#: One parsed listing: identity, content, quality, cleaned payload.
PARSED_LISTING = T.StructType(
    [T.StructField("source_id", T.StringType()), T.StructField("external_id", T.StringType())]
    + [T.StructField(name, kind) for name, kind in CONTENT_FIELDS]
    + [
        T.StructField("confidence", CONFIDENCE),
        T.StructField("quality_flags", T.ArrayType(T.StringType())),
        T.StructField("raw_payload", T.StringType()),
    ]
)

#: One stored listing.
LISTING = T.StructType(
    [T.StructField("id", T.LongType())]
    + PARSED_LISTING.fields
    + [
        T.StructField("round_number", T.IntegerType()),
        T.StructField("source_document_id", T.LongType()),
        T.StructField("is_published", T.BooleanType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_verified_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
    ]
)

REVISION = T.StructType(
    [
        T.StructField("listing_id", T.LongType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("field_name", T.StringType()),
        T.StructField("old_value", T.StringType()),
        T.StructField("new_value", T.StringType()),
        T.StructField("source_document_id", T.LongType()),
    ]
)

#: One fetched page as received, with how and when it was got.
RAW_DOCUMENT = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("content", T.BinaryType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("http_status", T.IntegerType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("etag", T.StringType()),
        T.StructField("last_modified", T.StringType()),
    ]
)

#: What is known about one URL.
URL_STATE = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("etag", T.StringType()),
        T.StructField("first_seen_at", T.TimestampType()),
        T.StructField("last_fetched_at", T.TimestampType()),
        T.StructField("last_changed_at", T.TimestampType()),
        T.StructField("fetch_count", T.LongType()),
        T.StructField("unchanged_streak", T.LongType()),
    ]
)

#: One crawl run of one source.
SOURCE_HEALTH = T.StructType(
    [
        T.StructField("source_id", T.StringType()),
        T.StructField("ran_at", T.TimestampType()),
        T.StructField("duration_seconds", T.DecimalType(10, 2)),
        T.StructField("discovered", T.LongType()),
        T.StructField("fetched", T.LongType()),
        T.StructField("unchanged", T.LongType()),
        T.StructField("failed", T.LongType()),
        T.StructField("parse_failures", T.LongType()),
        T.StructField("listings_created", T.LongType()),
        T.StructField("listings_updated", T.LongType()),
        T.StructField("listings_seen", T.LongType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("notes", T.StringType()),
    ]
)
