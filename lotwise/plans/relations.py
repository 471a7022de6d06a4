"""Relations of the listing domain derived from the given tables.

Each is one portable SELECT, so the Spark side and the checking SQL start from the
same rows.  All work grows with the tables; nothing is cut or sampled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Clock of every clock-driven query: about half the proxy auctions have started.
CLOCK = "1998-06-15 00:00:00"
#: Clock of the crawl history, which lies in January 2024.
CRAWL_CLOCK = "2024-02-01 00:00:00"

LISTINGS = """
SELECT o_orderkey AS id, r_name AS source_id, CAST(o_orderkey AS VARCHAR(20)) AS external_id,
  'https://x.test/lot/' || CAST(o_orderkey AS VARCHAR(20)) AS canonical_url,
  CASE WHEN o_custkey % 5 = 0 THEN 'vehicle' ELSE 'property' END AS asset_class,
  lower(o_orderpriority) AS asset_type,
  CASE o_custkey % 4 WHEN 0 THEN 'FLAT' WHEN 1 THEN 'Shop' WHEN 2 THEN 'LAND AND BUILDING' END AS asset_subtype,
  'unit ' || CAST(o_custkey % 300 AS VARCHAR(20)) || ' at ' || c_mktsegment AS title,
  CASE WHEN o_orderkey % 2 = 0 THEN 'Lot of ' || c_name END AS description,
  'Flat No. ' || CAST(o_custkey % 300 AS VARCHAR(20)) || ', ' || c_name || ' Towers, Phase '
    || CAST(o_orderkey % 3 AS VARCHAR(20)) || ' Wing ' || CAST(o_orderkey % 5 AS VARCHAR(20)) || ', '
    || c_mktsegment || ' Road' AS address,
  c_mktsegment || ' Sector ' || CAST(o_orderkey % 3 AS VARCHAR(20)) AS locality,
  n_name || '-' || CAST(o_custkey % 20 AS VARCHAR(20)) AS city, n_name || ' District' AS district, n_name AS state,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(100000 + o_custkey % 900 AS VARCHAR(20)) END AS pincode,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(8 + o_custkey % 29 AS DECIMAL(9,6)) END AS latitude,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(68 + o_orderkey % 29 AS DECIMAL(9,6)) END AS longitude,
  CAST(500 + (o_custkey * 37) % 4000 AS DECIMAL(14,2)) AS area_value, 'sqft' AS area_unit,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL
    ELSE CAST(500 + (o_custkey * 37) % 4000 + (o_orderkey % 9) * 60 AS DECIMAL(14,2)) END AS area_sqft,
  CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE CAST(round(o_totalprice * 100) AS DECIMAL(18,2)) END AS reserve_price,
  CAST(round(o_totalprice * (2 + o_orderkey % 25)) AS DECIMAL(18,2)) AS emd_amount,
  CAST(10000 AS DECIMAL(18,2)) AS bid_increment, CAST(round(o_totalprice * 150) AS DECIMAL(18,2)) AS outstanding_dues,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS auction_start_at,
  CASE WHEN o_orderkey % 3 = 0 OR o_orderkey % 23 = 0 THEN NULL
    WHEN o_orderkey % 3 = 1 THEN CAST(o_orderdate + INTERVAL '1' DAY AS TIMESTAMP)
    ELSE CAST(o_orderdate + INTERVAL '9' DAY AS TIMESTAMP) END AS auction_end_at,
  CAST(o_orderdate - INTERVAL '2' DAY AS TIMESTAMP) AS emd_deadline_at,
  CAST(o_orderdate - INTERVAL '9' DAY AS TIMESTAMP) AS inspection_from,
  CAST(o_orderdate - INTERVAL '8' DAY AS TIMESTAMP) AS inspection_to,
  'Bank ' || CAST(o_custkey % 12 AS VARCHAR(20)) AS bank_name, n_name || ' Main' AS branch_name,
  CASE o_custkey % 3 WHEN 0 THEN 'physical' WHEN 1 THEN 'symbolic' ELSE 'unknown' END AS possession_type,
  CAST(CAST(NULL AS VARCHAR(20)) AS DATE) AS symbolic_possession_date,
  CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderdate AS DATE) END AS physical_possession_date,
  CAST(CAST(NULL AS VARCHAR(20)) AS DATE) AS npa_date,
  'sarfaesi' AS legal_basis, CAST(NULL AS VARCHAR(20)) AS authorised_officer_name,
  CAST(NULL AS VARCHAR(20)) AS authorised_officer_phone,
  CASE WHEN o_orderkey % 29 = 0 THEN 'cancelled' WHEN o_orderstatus = 'O' THEN 'upcoming'
    WHEN o_orderstatus = 'P' THEN 'live' ELSE 'closed' END AS status,
  CASE WHEN o_orderkey % 31 = 0 THEN 'A' || CAST(o_custkey AS VARCHAR(20)) END AS asset_key,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN 0.30 ELSE 1.00 END AS DECIMAL(3,2)) AS confidence,
  1 AS round_number, CAST(NULL AS BIGINT) AS source_document_id, (o_orderkey % 7 <> 0) AS is_published,
  CAST(o_orderdate - INTERVAL '40' DAY AS TIMESTAMP) AS first_seen_at,
  CAST(o_orderdate + INTERVAL '2' DAY AS TIMESTAMP) AS last_verified_at,
  CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderdate - INTERVAL '5' DAY AS TIMESTAMP) END AS updated_at
FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
  JOIN {region} ON n_regionkey = r_regionkey
"""

FETCH_LOG = """
SELECT event_id AS seq, 'https://x.test/property-detail/' || CAST(user_id AS VARCHAR(20)) || '/ab' AS url,
  CAST(ts AS TIMESTAMP) AS fetched_at,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'not_modified' ELSE 'ok' END AS outcome,
  CASE WHEN event_type IN ('error','signup') THEN NULL
    ELSE CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR(20)) END AS content_hash,
  CASE WHEN event_type IN ('error','signup') THEN NULL ELSE 'W/' || CAST(event_id AS VARCHAR(20)) END AS etag,
  CASE WHEN event_type IN ('error','signup') THEN NULL
    ELSE 'd' || CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR(20)) END AS document
FROM {events}
"""

#: The same log with the source of each URL and the date header of each body.
FETCH_LOG_OF_SOURCES = FETCH_LOG.replace(
    "AS document", "AS document, 's' || CAST(user_id % 3 AS VARCHAR(20)) AS source_id, "
    "CASE WHEN event_type IN ('error','signup') THEN NULL ELSE 'lm' || CAST(event_id AS VARCHAR(20)) END AS last_modified"
)

#: Runs of a crawl: one per event type and day.
CRAWL_RUNS = """
SELECT event_type AS source_id, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS run_id,
  count(*) AS discovered, sum(CASE WHEN value > 5 THEN 1 ELSE 0 END) AS fetched,
  sum(CASE WHEN value <= 5 THEN 1 ELSE 0 END) AS failed,
  sum(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS listings_seen,
  sum(CASE WHEN value > 5 AND value <= 60 THEN 1 ELSE 0 END) AS parse_failures,
  CAST(max(ts) AS TIMESTAMP) AS ran_at
FROM {events} GROUP BY event_type, CAST(ts AS DATE)
"""

#: One row per URL attempt of a run.
ATTEMPTS = """
SELECT event_id AS position, event_type AS source_id, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS run_id,
  CASE WHEN user_id % 10 = 0 THEN 'blocked_by_robots' WHEN user_id % 10 = 1 THEN 'failed'
    WHEN user_id % 10 IN (2, 3) THEN 'not_modified' WHEN user_id % 10 = 4 THEN 'unchanged' ELSE 'new' END AS outcome,
  CASE WHEN value <= 5 THEN 0 ELSE 1 END AS listings,
  CASE WHEN value > 60 THEN 1 ELSE 0 END AS created, CASE WHEN value > 30 AND value <= 60 THEN 1 ELSE 0 END AS updated,
  CASE WHEN value > 5 AND value <= 30 THEN 1 ELSE 0 END AS same,
  CASE WHEN user_id % 10 = 1 THEN 'u' || CAST(event_id AS VARCHAR(20)) || ': TimeoutError' END AS message,
  CAST(ts AS TIMESTAMP) AS attempted_at
FROM {events}
"""

#: Texts as documents of their source's URL; exact copies exist.
DOCUMENTS_LOG = """
SELECT doc_id AS id, lang AS source_id, 'https://x.test/' || source AS url, text,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS fetched_at,
  CASE doc_id % 5 WHEN 0 THEN 'text/html; charset=utf-8' WHEN 1 THEN ' Application/PDF ' WHEN 2 THEN 'text/plain'
    WHEN 3 THEN 'image/jpeg' ELSE 'application/octet-stream' END AS mime_type
FROM {documents}
"""

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its footer is read for the schema once per path, not once per use."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def relation(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A portable SELECT over the given tables, as a DataFrame."""
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in set(re.findall(r"\{(\w+)\}", sql))})


def plain(sql: str) -> str:
    """The same SELECT over registered views."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def given(**relations: str) -> str:
    """``WITH name AS (...)`` of portable relations, for checking SQL."""
    return "WITH " + ", ".join(f"{name} AS ({plain(sql)})" for name, sql in relations.items()) + " "


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, LISTINGS)


def clock(text: str = CLOCK) -> Column:
    return F.lit(text).cast("timestamp")


def stamp(column: str | Column, name: str | None = None) -> Column:
    """Comparable text of a moment."""
    value = F.col(column) if isinstance(column, str) else column
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss").alias(name or str(column))


def stamp_sql(expression: str, name: str | None = None) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') AS {name or expression}"


def money(column: str) -> Column:
    return F.col(column).cast("double").alias(column)
