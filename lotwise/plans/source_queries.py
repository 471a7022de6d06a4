"""Discovery, payload extraction and record parsing over pages built from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import upsert
from lotwise.plans.catalogue import query
from lotwise.plans.relations import clock, given, relation, stamp, table
from lotwise.schemas import LISTING
from lotwise.sources import fields, payload, property, registry, sitemap
from lotwise.sources.registry import Source

PARSE_CLOCK = "2024-01-20 00:00:00"
NOW = f"TIMESTAMP '{PARSE_CLOCK}'"
PER_SITEMAP = 50


def _script(fragment: Column) -> Column:
    """One streamed push holding the fragment as a JSON string."""
    escaped = F.replace(F.replace(fragment, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('<script>self.__next_f.push([1,"'), escaped, F.lit('"])</script>'))


def _page(body: Column) -> Column:
    """Page text: the payload in two pushes around one that cannot be decoded."""
    bad = F.lit('<script>self.__next_f.push([1,"\\x"])</script>')
    return F.concat(
        F.lit("<html><head>"), _script(F.substring(body, 1, 40)), bad, _script(F.substr(body, F.lit(41))), F.lit("</head></html>")
    )


# --- discovery ------------------------------------------------------------


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sitemap per ``PER_SITEMAP`` pages, so bodies stay small however many pages there are."""
    pages = table(spark, sf_dir, "pages").withColumn("sitemap_no", F.expr(f"page_id div {PER_SITEMAP}"))
    grouped = pages.groupBy("sitemap_no").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("urls"))
    lines = F.transform("urls", lambda p: F.concat(F.lit("<url><loc>"), p["url"], F.lit("</loc></url>\n")))
    return grouped.select("sitemap_no", F.array_join(lines, "").alias("body"))


FOUND = f"""WITH found AS (SELECT url, min(page_id) AS page_id FROM pages WHERE url LIKE '%/en/%' GROUP BY url)
 SELECT url, page_id // {PER_SITEMAP} AS sitemap_no, CAST(page_id % {PER_SITEMAP} AS INTEGER) AS pos FROM found"""


@query("a1_discover_urls", FOUND)
def discover_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sitemap.discover_urls(sitemaps(spark, sf_dir), "/en/").select("url", "position.sitemap_no", "position.pos")


@query("a1_discover_limited", f"{FOUND} ORDER BY found.page_id LIMIT 30")
def discover_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sitemap.discover_urls(sitemaps(spark, sf_dir), "/en/", 30)
    return found.select("url", "position.sitemap_no", "position.pos")


# --- payload --------------------------------------------------------------

SMALL = """SELECT event_id AS id, 'https://x.test/property-detail/' || CAST(event_id AS VARCHAR(20)) || '/ab' AS url, event_type,
  CAST(round(value * 1000) AS BIGINT) AS n FROM {events}"""
SMALL_BODY = """'{"propertyDetailId":0}{"propertyDetailId":' || id || ',"city":{"name":"' || event_type || ' {x}"},"reservePrice":' || n || '}'"""


def small_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relation(spark, sf_dir, SMALL)
    body = F.concat(
        F.lit('{"propertyDetailId":0}{"propertyDetailId":'), F.col("id").cast("string"), F.lit(',"city":{"name":"'),
        F.col("event_type"), F.lit(' {x}"},"reservePrice":'), F.col("n").cast("string"), F.lit("}"),
    )
    return rows.select("id", "url", _page(body).alias("html"))


def _small_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_pages(spark, sf_dir).withColumn("payload", payload.extract_payload(F.col("html")))


@query("a9_extract_payload", f"{given(src=SMALL)} SELECT id, {SMALL_BODY} AS payload FROM src")
def extract_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _small_payloads(spark, sf_dir).select("id", "payload")


PAGE_BODY = """'{"propertyDetailId":' || page_id || ',"size":{"chars":' || length(html) || '}}'"""


def given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given pages, each with one object about itself pushed at its end."""
    pages = table(spark, sf_dir, "pages")
    body = F.concat(
        F.lit('{"propertyDetailId":'), F.col("page_id").cast("string"), F.lit(',"size":{"chars":'),
        F.length("html").cast("string"), F.lit("}}"),
    )
    html = F.concat("html", _script(body))
    return pages.select("page_id", F.col("page_id").cast("string").alias("url"), payload.extract_payload(html).alias("payload"))


@query("a9_given_pages", f"SELECT page_id, {PAGE_BODY} AS payload FROM pages")
def extract_given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given_pages(spark, sf_dir).select("page_id", "payload")


@query(
    "a10_given_pages",
    f"""SELECT CAST(page_id AS VARCHAR) AS url, 'propertyDetailId' AS key, CAST(0 AS BIGINT) AS position, {PAGE_BODY} AS object_json,
    CAST(2 AS BIGINT) AS n_fields FROM pages UNION ALL SELECT CAST(page_id AS VARCHAR), 'chars', 0, '{{"chars":' || length(html) || '}}', 1
    FROM pages""",
)
def find_objects_on_given_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.find_objects(given_pages(spark, sf_dir), ("propertyDetailId", "chars"))


_FULL = """'{"propertyDetailId":' || id || ',"city":{"name":"' || event_type || ' {x}"},"reservePrice":' || n || '}'"""


@query(
    "a10_find_objects",
    f"""{given(src=SMALL)} SELECT url, 'propertyDetailId' AS key, CAST(0 AS BIGINT) AS position, '{{"propertyDetailId":0}}' AS object_json,
    CAST(1 AS BIGINT) AS n_fields FROM src UNION ALL SELECT url, 'propertyDetailId', 1, {_FULL}, 3 FROM src
    UNION ALL SELECT url, 'reservePrice', 0, {_FULL}, 3 FROM src""",
)
def find_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payload.find_objects(_small_payloads(spark, sf_dir), ("propertyDetailId", "reservePrice"))


@query(
    "a11_largest_object",
    f"""{given(src=SMALL)} SELECT url, 'propertyDetailId' AS key, {_FULL} AS object_json, CAST(3 AS BIGINT) AS n_fields FROM src
    UNION ALL SELECT url, 'reservePrice', {_FULL}, 3 FROM src""",
)
def largest_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = payload.find_objects(_small_payloads(spark, sf_dir), ("propertyDetailId", "reservePrice"))
    return payload.largest_object(found)


@query(
    "a16_external_id",
    """SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END
    ELSE 'R' || event_id END AS external_id FROM events""",
)
def external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("R"), F.col("event_id").cast("string")))
    path = F.when(F.col("user_id") % 2 == 0, "property-detail").otherwise("other")
    url = F.concat(F.lit("https://x.test/"), path, F.lit("/"), F.col("user_id").cast("string"), F.lit("/0af"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), property.external_id(stated, url, property.DETAIL_ID).alias("external_id")
    )


def _personal_row() -> Column:
    return F.struct(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("city"),
        F.when(F.col("user_id") % 2 == 0, F.lit("A Person")).alias("borrowerName"),
        F.lit("somewhere").alias("ownerAddress"),
        F.struct(F.lit("kept inside").alias("guarantorName")).alias("inner"),
        F.when(F.col("user_id") % 3 == 0, F.col("user_id")).alias("custId"),
    )


@query(
    "b14_strip_personal_data",
    """SELECT event_id AS id, 'city,id,inner' AS kept, event_type AS city, 'kept inside' AS deep FROM events""",
)
def strip_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = fields.strip_personal_data(F.parse_json(F.to_json(_personal_row())))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), stripped.alias("j"))
    return rows.select(
        "id",
        F.array_join(F.array_sort(F.json_object_keys("j")), ",").alias("kept"),
        F.get_json_object("j", "$.city").alias("city"),
        F.get_json_object("j", "$.inner.guarantorName").alias("deep"),
    )


# --- record parsing -------------------------------------------------------

#: What the pages are made of; every parsed value below follows from these columns.
FACTS = """SELECT event_id AS id, user_id AS u, event_type AS kind, CAST(round(value * 100000) AS BIGINT) AS n,
  CAST(event_id AS VARCHAR(20)) AS listing, CAST(CAST(ts AS DATE) AS VARCHAR(20)) AS day, CAST(ts AS TIMESTAMP) AS seen_at FROM {events}"""


def _property_record() -> Column:
    u, kind, n = F.col("u"), F.col("kind"), F.col("n")
    auction = F.struct(
        F.when(u % 6 != 0, F.concat(F.lit("Rs. "), n.cast("string"), F.lit("/-"))).otherwise("").alias("reservePrice"),
        F.expr("n div 10").alias("emd"),
        F.lit("25,000").alias("incrementPrice"),
        F.when(u % 9 != 0, F.concat("day", F.lit("T08:30:00.000Z"))).alias("auctionFrom"),
        F.when(u % 4 == 0, F.concat("day", F.lit("T06:00:00Z"))).when(u % 4 == 1, F.lit("2024-01-25T00:00:00Z")).alias("auctionTo"),
        F.when(u % 8 == 1, F.lit("2024-01-26T00:00:00Z")).alias("auctionExtendedTo"),
        F.lit("MAIN ROAD BRANCH").alias("auctionBranch"),
        F.lit("+91 98123 45678").alias("inspectionMobileNo"),
    )
    return F.to_json(
        F.struct(
            F.when(u % 25 == 0, "").otherwise(F.col("listing")).alias("propertyDetailId"),
            F.when(u % 2 == 0, F.concat(F.lit("KEY"), u.cast("string"))).alias("propertyUniqueId"),
            F.when(u % 3 == 0, F.lit("$21")).otherwise(F.concat(F.lit(" Lot  of "), kind)).alias("summaryDesc"),
            F.lit("NEW TOWN").alias("locality"),
            F.concat(F.lit("House "), u.cast("string"), F.lit(", Kochi 682001")).alias("address"),
            F.struct(F.when(u % 7 != 0, F.upper(kind)).alias("name")).alias("city"),
            F.struct(F.lit("ERNAKULAM").alias("name"), F.struct(F.lit("KERALA").alias("name")).alias("State")).alias("district"),
            F.lit(76.25).alias("latitude"),
            F.when(u % 5 == 0, 40.0).otherwise(9.5).alias("longitude"),
            F.struct(
                F.lit("FLAT").alias("propertySubType"), F.struct(F.lit("Residential").alias("propertyType")).alias("propertyType")
            ).alias("propertySubType"),
            F.struct(
                (u * 10).alias("carpetAreaSqFeet"),
                F.struct(F.when(u % 2 == 0, "Sq. Ft.").otherwise("bigha").alias("measurementAbb")).alias("unitOfMeasure"),
            ).alias("propertyTypeDetails"),
            n.alias("propertyPrice"),
            F.lit("State Bank").alias("bankName"),
            F.when(u % 3 == 1, F.lit("28-Jul-2022")).alias("symbolicPossDate"),
            F.lit("A Person").alias("borrowerName"),
            auction.alias("auction"),
        )
    )


def _vehicle_record() -> Column:
    u, n = F.col("u"), F.col("n")
    return F.to_json(
        F.struct(
            F.col("listing").alias("vehicleId"),
            F.when(u % 3 != 0, F.lit("Under Hypothecation")).otherwise("SARFAESI").alias("typeOfAction"),
            F.when(u % 5 != 0, F.lit("Maruti")).alias("brandName"),
            F.when(u % 5 != 0, F.lit("Swift")).alias("model"),
            F.when(u % 5 != 0, F.lit("2019-05-01")).alias("registrationYear"),
            F.lit("Diesel").alias("fuelType"),
            F.lit(1248).alias("engineCapacity"),
            F.upper("kind").alias("repossessionCity"),
            F.when(u % 7 != 0, F.lit("KERALA")).alias("repossessionState"),
            F.lit("682 001").alias("repossessionPincode"),
            F.when(u % 2 == 0, n).otherwise(0).alias("reservePrice"),
            n.alias("price"),
            F.when(u % 4 == 0, n / 20).alias("emd"),
            F.lit(10).alias("emdPercentage"),
            F.when(u % 9 != 0, F.concat("day", F.lit("T08:30:00Z"))).alias("auctionStartTime"),
            F.lit("secret").alias("ownerAddress"),
        )
    )


def fetched_pages(spark: SparkSession, sf_dir: str, facts: str = FACTS) -> DataFrame:
    """Pages of two registered sources and one unknown; every 41st page carries no record.

    The narrow facts are spread over the cores before page text is built from them, whatever files they lie in.
    """
    rows = relation(spark, sf_dir, facts).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "id")
    vehicle_page = F.col("id") % 4 == 0
    source = F.when(F.col("id") % 97 == 0, "elsewhere").when(vehicle_page, "psb_vehicle").otherwise("psb_property")
    folder = F.when(vehicle_page, "vehicle").otherwise("property")
    body = F.when(F.col("id") % 41 == 0, F.lit('{"nothing":true}')).when(vehicle_page, _vehicle_record()).otherwise(_property_record())
    return rows.select(
        source.alias("source_id"),
        F.concat(F.lit("https://x.test/"), folder, F.lit("-detail/"), F.col("listing"), F.lit("/ab")).alias("url"),
        _page(F.concat(F.lit('{"propertyDetailId":1}{"vehicleId":1}'), body)).cast("binary").alias("content"),
        F.col("id").alias("page_seq"),
        "seen_at",
    )


_START = "CASE WHEN u % 9 <> 0 THEN CAST(day || ' 08:30:00' AS TIMESTAMP) END"
_STATUS = "CASE WHEN s IS NULL THEN 'unscheduled' WHEN {now} < s THEN 'upcoming' WHEN e >= {now} THEN 'live' ELSE 'closed' END".format(now=NOW)
_N = "CASE WHEN n >= 10000 THEN n END"

PROPERTY = f"""{given(src=FACTS)},
 base AS (SELECT *, {_START} AS s, CASE WHEN u % 8 = 1 THEN TIMESTAMP '2024-01-26 00:00:00' WHEN u % 4 = 0 THEN CAST(day || ' 06:00:00' AS TIMESTAMP)
     WHEN u % 4 = 1 THEN TIMESTAMP '2024-01-25 00:00:00' END AS stated_end, n // 10 AS emd FROM src WHERE id % 4 <> 0 AND id % 97 <> 0),
 ends AS (SELECT *, CASE WHEN stated_end < s THEN NULL ELSE stated_end END AS e, {_N} AS price FROM base),
 st AS (SELECT *, {_STATUS} AS status, CASE WHEN emd <> 0 THEN round(emd / price, 4) END AS ratio FROM ends),
 readable AS (SELECT id, 'psb_property' AS source_id, CASE WHEN id % 41 = 0 THEN '1' ELSE listing END AS external_id, id % 41 = 0 AS bare, st.* EXCLUDE (id) FROM st)"""
# A page without its record still shows the stray one-field record, which is then the largest.
PROPERTY_ROWS = f"""{PROPERTY}, shaped AS (SELECT id AS page_seq, source_id, external_id, bare,
 CASE WHEN bare THEN 'Property' ELSE 'Flat at New Town' || CASE WHEN u % 7 <> 0 THEN ' in ' || upper(kind[1]) || kind[2:] ELSE '' END END AS title,
 CASE WHEN NOT bare AND u % 3 <> 0 THEN 'Lot of ' || kind END AS description,
 CASE WHEN NOT bare AND u % 7 <> 0 THEN upper(kind[1]) || kind[2:] END AS city, CASE WHEN NOT bare THEN 'Kerala' END AS state,
 CASE WHEN NOT bare THEN '682001' END AS pincode,
 CAST(CASE WHEN NOT bare AND u % 5 <> 0 THEN 9.5 END AS DOUBLE) AS latitude, CAST(CASE WHEN NOT bare AND u % 5 <> 0 THEN 76.25 END AS DOUBLE) AS longitude,
 CAST(CASE WHEN NOT bare AND u % 2 = 0 AND u > 0 THEN u * 10 END AS DOUBLE) AS area_sqft,
 CAST(CASE WHEN NOT bare THEN price END AS DOUBLE) AS reserve_price, CAST(CASE WHEN NOT bare THEN emd END AS DOUBLE) AS emd_amount,
 strftime(CASE WHEN NOT bare THEN s END, '%Y-%m-%d %H:%M:%S') AS auction_start_at, strftime(CASE WHEN NOT bare THEN e END, '%Y-%m-%d %H:%M:%S') AS auction_end_at,
 CASE WHEN bare THEN 'unscheduled' ELSE status END AS status,
 CASE WHEN NOT bare AND u % 3 = 1 THEN 'symbolic' ELSE 'unknown' END AS possession_type, 'sarfaesi' AS legal_basis,
 CASE WHEN NOT bare AND u % 2 = 0 THEN 'KEY' || u ELSE 'psb_property:' || external_id END AS asset_key,
 CASE WHEN NOT bare THEN 'Main Road Branch' END AS branch_name, CASE WHEN NOT bare THEN '9812345678' END AS authorised_officer_phone,
 CAST(CASE WHEN bare THEN 0.25 ELSE round(greatest(0, 1.0 - CASE WHEN price IS NULL THEN 0.40 ELSE 0 END - CASE WHEN s IS NULL THEN 0.10 ELSE 0 END
   - CASE WHEN u % 7 = 0 THEN 0.10 ELSE 0 END - CASE WHEN NOT ratio BETWEEN 0.05 AND 0.20 THEN 0.15 ELSE 0 END), 2) END AS DOUBLE) AS confidence,
 CASE WHEN bare THEN 'missing_reserve_price, auction_not_yet_scheduled, missing_state, missing_city' ELSE concat_ws(', ',
   CASE WHEN u % 2 = 1 THEN 'area_unit_unconvertible' END, CASE WHEN u % 5 = 0 THEN 'coordinates_outside_state' ELSE 'coordinates_transposed' END,
   CASE WHEN n < 10000 THEN 'reserve_price_implausible' END,
   CASE WHEN NOT ratio BETWEEN 0.05 AND 0.20 THEN 'emd_ratio_unusual:' || CAST(CAST(ratio AS DECIMAL(18,4)) AS VARCHAR) END,
   CASE WHEN stated_end < s THEN 'auction_end_before_start' END, CASE WHEN n < 10000 THEN 'missing_reserve_price' END,
   CASE WHEN s IS NULL THEN 'auction_not_yet_scheduled' END, CASE WHEN u % 7 = 0 THEN 'missing_city' END) END AS flags FROM readable)"""
PARSED_COLUMNS = (
    "page_seq", "source_id", "external_id", "title", "description", "city", "state", "pincode", "latitude", "longitude", "area_sqft",
    "reserve_price", "emd_amount", "auction_start_at", "auction_end_at", "status", "possession_type", "legal_basis", "asset_key",
    "branch_name", "authorised_officer_phone", "confidence", "flags",
)
_NUMBERS = ("latitude", "longitude", "area_sqft", "reserve_price", "emd_amount", "confidence")


def _shown(parsed: DataFrame) -> DataFrame:
    changed: dict[str, Column] = {name: F.col(name).cast("double") for name in _NUMBERS}
    changed |= {name: stamp(name) for name in ("auction_start_at", "auction_end_at")}
    changed["flags"] = F.array_join("quality_flags", ", ")
    return parsed.withColumns(changed).select(*PARSED_COLUMNS)


@query("a12_parse_property", f"{PROPERTY_ROWS} SELECT {', '.join(PARSED_COLUMNS)} FROM shaped")
def parse_property(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = registry.default_registry()["psb_property"]
    pages = fetched_pages(spark, sf_dir).filter("source_id = 'psb_property'")
    return _shown(source.parse(pages, clock(PARSE_CLOCK)))


VEHICLE_ROWS = f"""{given(src=FACTS)},
 v AS (SELECT *, id % 41 = 0 AS bare, {_START} AS s, CAST(NULL AS TIMESTAMP) AS e, {_N} AS price FROM src WHERE id % 4 = 0 AND id % 97 <> 0),
 w AS (SELECT *, {_STATUS} AS status FROM v),
 shaped AS (SELECT id AS page_seq, 'psb_vehicle' AS source_id, CASE WHEN bare THEN '1' ELSE listing END AS external_id,
 CASE WHEN bare OR u % 5 = 0 THEN 'Vehicle' ELSE '2019 Maruti Swift' END AS title,
 CASE WHEN NOT bare THEN 'Fuel: Diesel; Engine: 1248 cc' END AS description,
 CASE WHEN NOT bare THEN upper(kind[1]) || kind[2:] END AS city, CASE WHEN NOT bare AND u % 7 <> 0 THEN 'Kerala' END AS state,
 CASE WHEN NOT bare THEN '682001' END AS pincode, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CAST(NULL AS DOUBLE) AS area_sqft,
 CAST(CASE WHEN NOT bare THEN price END AS DOUBLE) AS reserve_price,
 CASE WHEN NOT bare THEN CASE WHEN u % 4 = 0 THEN round(n / 20, 2) ELSE round(n * 10 / 100, 2) END END AS emd_amount,
 strftime(CASE WHEN NOT bare THEN s END, '%Y-%m-%d %H:%M:%S') AS auction_start_at, CAST(NULL AS VARCHAR) AS auction_end_at,
 CASE WHEN bare THEN 'unscheduled' ELSE status END AS status, 'unknown' AS possession_type,
 CASE WHEN NOT bare AND u % 3 = 0 THEN 'sarfaesi' ELSE 'contractual' END AS legal_basis,
 'psb_vehicle:' || CASE WHEN bare THEN '1' ELSE listing END AS asset_key, CAST(NULL AS VARCHAR) AS branch_name, CAST(NULL AS VARCHAR) AS authorised_officer_phone,
 CAST(CASE WHEN bare THEN 0.10 ELSE round(1.0 - CASE WHEN price IS NULL THEN 0.40 ELSE 0 END - CASE WHEN s IS NULL THEN 0.10 ELSE 0 END
   - CASE WHEN u % 7 = 0 THEN 0.15 ELSE 0 END - CASE WHEN u % 5 = 0 THEN 0.15 ELSE 0 END, 2) END AS DOUBLE) AS confidence,
 CASE WHEN bare THEN 'missing_reserve_price, auction_not_yet_scheduled, missing_state, missing_city, missing_vehicle_identity' ELSE concat_ws(', ',
   CASE WHEN u % 4 <> 0 THEN 'emd_derived_from_percentage' END, CASE WHEN n < 10000 THEN 'reserve_price_implausible' END,
   CASE WHEN n < 10000 THEN 'missing_reserve_price' END, CASE WHEN s IS NULL THEN 'auction_not_yet_scheduled' END,
   CASE WHEN u % 7 = 0 THEN 'missing_state' END, CASE WHEN u % 5 = 0 THEN 'missing_vehicle_identity' END) END AS flags FROM w)"""


@query("a13_parse_vehicle", f"{VEHICLE_ROWS} SELECT {', '.join(PARSED_COLUMNS)} FROM shaped")
def parse_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = registry.default_registry()["psb_vehicle"]
    pages = fetched_pages(spark, sf_dir).filter("source_id = 'psb_vehicle'")
    return _shown(source.parse(pages, clock(PARSE_CLOCK)))


@query(
    "a14_parse_all",
    f"""WITH p AS ({PROPERTY_ROWS} SELECT {', '.join(PARSED_COLUMNS)} FROM shaped),
    v AS ({VEHICLE_ROWS} SELECT {', '.join(PARSED_COLUMNS)} FROM shaped) SELECT * FROM p UNION ALL SELECT * FROM v""",
)
def parse_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(registry.parse_all(fetched_pages(spark, sf_dir), registry.default_registry(), clock(PARSE_CLOCK)))


def notice_rows(pages: DataFrame, now: Column) -> DataFrame:
    """A plug-in whose documents list many lots: one listing per line that is not blank."""
    lines = F.posexplode(F.split(F.col("content").cast("string"), "\n")).alias("line", "raw")
    lots = pages.select("source_id", "url", "page_seq", lines).filter(F.trim("raw") != "")
    return lots.select(
        "source_id", "url", "page_seq",
        F.concat_ws("-", F.col("page_seq").cast("string"), F.col("line").cast("string")).alias("external_id"),
        F.col("url").alias("canonical_url"), F.lit("property").alias("asset_class"), F.md5("raw").alias("title"),
        F.lit("unscheduled").alias("status"),
    )


@query(
    "j1_source_plug_in",
    """WITH lines AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
    lots AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS raw FROM lines)
    SELECT 'notices' AS source_id, doc_id || '-' || line AS external_id, md5(raw) AS title, 'unscheduled' AS status
    FROM lots WHERE trim(raw, ' ') <> ''""",
)
def source_plug_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    notices = Source("notices", "/notice/", notice_rows)
    pages = table(spark, sf_dir, "documents").select(
        F.lit("notices").alias("source_id"), F.concat(F.lit("https://x.test/notice/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").cast("binary").alias("content"), F.col("doc_id").alias("page_seq"),
    )
    listings = registry.parse_all(pages, {"notices": notices}, clock(PARSE_CLOCK))
    return listings.select("source_id", "external_id", "title", "status")


#: Two archived versions per listing; in two listings of three the second has another price.
VERSIONS = """SELECT event_id AS id, CAST(floor(event_id / 8) AS BIGINT) AS u, 'click' AS kind,
  500000 + CAST(floor(event_id / 8) AS BIGINT) * 10 + CASE WHEN event_id % 8 >= 4 AND CAST(floor(event_id / 8) AS BIGINT) % 3 <> 0 THEN 70000 ELSE 0 END AS n,
  CAST(CAST(floor(event_id / 8) AS BIGINT) * 4 + event_id % 4 + 2 AS VARCHAR(20)) AS listing, '2024-01-10' AS day, CAST(ts AS TIMESTAMP) AS seen_at FROM {events}"""


@query(
    "j2_reparse_report",
    f"""{given(src=VERSIONS)}, p AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'psb_vehicle' ELSE 'psb_property' END AS source_id,
      CASE WHEN id % 41 = 0 THEN '1' ELSE listing END AS external_id, CASE WHEN id % 41 = 0 THEN -1 ELSE n END AS n,
      CASE WHEN id % 41 = 0 THEN listing ELSE '' END AS bare_url FROM src WHERE id % 97 <> 0),
    acted AS (SELECT *, CASE WHEN lag(id) OVER w IS NULL THEN 'created' WHEN lag(n) OVER w = n AND lag(bare_url) OVER w = bare_url
      THEN 'unchanged' ELSE 'updated' END AS action FROM p WINDOW w AS (PARTITION BY source_id, external_id ORDER BY id))
    SELECT source_id, count(*) AS discovered, count(*) AS fetched, CAST(0 AS BIGINT) AS parse_failures,
    count(*) FILTER (action = 'created') AS listings_created, count(*) FILTER (action = 'updated') AS listings_updated,
    count(*) FILTER (action = 'unchanged') AS listings_unchanged FROM acted GROUP BY source_id""",
)
def reparse_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = fetched_pages(spark, sf_dir, VERSIONS)
    empty = spark.createDataFrame([], LISTING)
    attempts, actions = registry.reparse(archive, empty, registry.default_registry(), clock(PARSE_CLOCK))
    return registry.reparse_report(attempts, actions)
