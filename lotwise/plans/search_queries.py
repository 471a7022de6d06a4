"""Search, filters, facets, counts and lifecycle over the listing relation."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import kept_counts, search, search_index, status, textsearch
from lotwise.operators.search import Page, SearchQuery
from lotwise.plans.catalogue import ORACLES, query
from lotwise.plans.relations import (
    CLOCK,
    CRAWL_RUNS,
    LISTINGS,
    clock,
    given,
    listings,
    money,
    relation,
    stamp,
    stamp_sql,
    table,
)
from lotwise.schemas import RETENTION_DAYS
from lotwise.session import checkpoint_root, saved

L = given(listings=LISTINGS)
NOW = f"TIMESTAMP '{CLOCK}'"
TERMINAL = "('cancelled','withdrawn','stayed','sold','unknown')"
ROW: list[str | Column] = ["id", "state", "city", "status"]
ROW_SQL = "id, state, city, status"
START_SQL = stamp_sql("auction_start_at")

UPCOMING = f"(status NOT IN {TERMINAL} AND auction_start_at > {NOW})"
LIVE = f"""(status NOT IN {TERMINAL} AND auction_start_at <= {NOW} AND (auction_end_at >= {NOW}
  OR (auction_end_at IS NULL AND auction_start_at + INTERVAL '1' DAY > {NOW})))"""
CLOSED = f"""(status NOT IN {TERMINAL} AND auction_start_at <= {NOW} AND (auction_end_at < {NOW}
  OR (auction_end_at IS NULL AND auction_start_at + INTERVAL '1' DAY <= {NOW})))"""
EFFECTIVE = f"""CASE WHEN status IN {TERMINAL} OR auction_start_at IS NULL THEN status
  WHEN {NOW} < auction_start_at THEN 'upcoming'
  WHEN auction_end_at IS NOT NULL THEN CASE WHEN {NOW} <= auction_end_at THEN 'live' ELSE 'closed' END
  WHEN {NOW} < auction_start_at + INTERVAL '1' DAY THEN 'live' ELSE 'closed' END"""
SOONEST = f"CASE WHEN auction_start_at < {NOW} THEN 1 ELSE 0 END, auction_start_at ASC NULLS LAST, id"


def _filtered(spark: SparkSession, sf_dir: str, asked: SearchQuery) -> DataFrame:
    return search.apply_filters(listings(spark, sf_dir), asked, clock()).select(*ROW)


def _filter_query(name: str, asked: SearchQuery, where: str) -> None:
    """Register a filter: every matching listing, no page."""

    @query(name, f"{L} SELECT {ROW_SQL} FROM listings WHERE {where}")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _filtered(spark, sf_dir, asked)


TEXT_HIT = (
    "' ' || trim(regexp_replace(lower(concat_ws(' ', title, city, locality, state, bank_name, address)), "
    "'[^a-z0-9]+', ' ', 'g')) || ' '"
)

_filter_query("b1_published_only", SearchQuery(), "is_published")
_filter_query("b1_unpublished_too", SearchQuery(include_unpublished=True), "TRUE")
_filter_query(
    "b2_equality_filters",
    SearchQuery(bank="Bank 3", state="NATION_7", possession="physical"),
    "is_published AND bank_name = 'Bank 3' AND state = 'NATION_7' AND possession_type = 'physical'",
)
_filter_query(
    "b3_text_predicate",
    SearchQuery(text='"unit 12" machinery or building -phase'),
    f"""is_published AND ((contains({TEXT_HIT}, ' unit 12 ') AND contains({TEXT_HIT}, ' machinery '))
     OR (contains({TEXT_HIT}, ' building ') AND NOT contains({TEXT_HIT}, ' phase '))
     OR title ILIKE '%"unit 12" machinery or building -phase%')""",
)
_filter_query("b4_status_upcoming", SearchQuery(status="upcoming"), f"is_published AND {UPCOMING}")
_filter_query("b5_status_live", SearchQuery(status="live"), f"is_published AND {LIVE}")
_filter_query("b6_status_closed", SearchQuery(status="closed"), f"is_published AND {CLOSED}")
_filter_query("b7_status_stored", SearchQuery(status="cancelled"), "is_published AND status = 'cancelled'")
_filter_query(
    "b8_price_range",
    SearchQuery(min_price=5_000_000, max_price=20_000_000),
    "is_published AND reserve_price >= 5000000 AND reserve_price <= 20000000",
)
_filter_query(
    "b9_auction_dates",
    SearchQuery(auction_after=date(1998, 1, 10), auction_before=date(1998, 3, 20)),
    "is_published AND auction_start_at >= TIMESTAMP '1998-01-09 18:30:00' "
    "AND auction_start_at <= TIMESTAMP '1998-03-20 18:29:59.999999'",
)


@query("b10_get_listing", f"{L} SELECT {ROW_SQL} FROM listings WHERE id = 11 AND is_published")
def get_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.get_listing(listings(spark, sf_dir), 11).select(*ROW)


def half_even(paise: str, step: int) -> str:
    """Whole steps in an amount of paise, half to even, in whole numbers throughout."""
    return (
        f"({paise} // {step} + CASE WHEN ({paise} % {step}) * 2 > {step} OR (({paise} % {step}) * 2 = {step} "
        f"AND ({paise} // {step}) % 2 = 1) THEN 1 ELSE 0 END)"
    )


def inr_sql(column: str) -> str:
    """Display text of an amount, in SQL."""
    paise = f"CAST({column} * 100 AS BIGINT)"

    def scaled(rupees: int, name: str) -> str:
        n = half_even(paise, rupees)
        return f"'Rs ' || CAST({n} // 100 AS VARCHAR) || '.' || lpad(CAST({n} % 100 AS VARCHAR), 2, '0') || ' {name}'"

    return f"""CASE WHEN {column} IS NULL THEN '-' WHEN {column} >= 10000000 THEN {scaled(10_000_000, 'Cr')}
  WHEN {column} >= 100000 THEN {scaled(100_000, 'L')}
  ELSE 'Rs ' || format('{{:,}}', {half_even(paise, 100)}) END"""


def _iso_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%dT%H:%M:%S') || '+00:00'"


_SERIAL_TEXT = (
    "title asset_type asset_subtype address locality city district state pincode bank_name branch_name "
    "possession_type legal_basis"
).split()
_SERIAL_TIMES = "auction_start_at auction_end_at emd_deadline_at inspection_from inspection_to".split()
_SERIAL_NUMBERS = "latitude longitude area_sqft reserve_price emd_amount".split()


@query(
    "b11_serialise",
    f"""{L} SELECT id, {', '.join(_SERIAL_TEXT)},
    {', '.join(f'CAST(nullif({c}, 0) AS DOUBLE) AS {c}' for c in _SERIAL_NUMBERS)},
    {', '.join(f'{_iso_sql(c)} AS {c}' for c in _SERIAL_TIMES)},
    {inr_sql('reserve_price')} AS reserve_price_display, {inr_sql('emd_amount')} AS emd_display,
    {EFFECTIVE} AS status, CAST(confidence AS DOUBLE) AS confidence,
    source_id, canonical_url AS notice_url, {_iso_sql('first_seen_at')} AS first_seen_at,
    {_iso_sql('last_verified_at')} AS last_verified_at FROM listings WHERE is_published""",
)
def serialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    public = search.serialise(listings(spark, sf_dir).filter("is_published"), clock())
    return public.select("*", "source.*").drop("source")


@query(
    "b12_console_listings",
    f"""{L} SELECT id, city, {START_SQL} FROM listings WHERE is_published AND state ILIKE '%nation_1%'
    AND city ILIKE '%-1%' ORDER BY listings.auction_start_at ASC NULLS LAST, id LIMIT 20""",
)
def console(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.console_listings(listings(spark, sf_dir), "nation_1", "-1", 20)
    return rows.select("id", "city", stamp("auction_start_at"))


IMMINENT = f"status IN ('upcoming','live') AND auction_start_at <= {NOW} + INTERVAL '7' DAY"


@query("b13_imminent", f"{L} SELECT source_id, canonical_url FROM listings WHERE {IMMINENT}")
def imminent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.imminent(listings(spark, sf_dir), clock()).select("source_id", "canonical_url")


@query(
    "c12_imminent_by_source",
    f"""{L}, due AS (SELECT source_id, canonical_url FROM listings WHERE {IMMINENT} AND source_id IN
    (SELECT r_name FROM region WHERE r_regionkey < 3))
    SELECT source_id, canonical_url, n AS due FROM due JOIN
    (SELECT source_id, count(*) AS n FROM due GROUP BY source_id) USING (source_id)""",
)
def imminent_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    registered = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_name").alias("source_id"))
    return search.imminent_by_source(listings(spark, sf_dir), registered, clock())


@query(
    "c7_nearby",
    f"""{L} SELECT id, city, {START_SQL} FROM listings WHERE is_published AND id <> 11
    AND city = (SELECT city FROM listings WHERE id = 11) ORDER BY listings.auction_start_at ASC NULLS LAST, id LIMIT 4""",
)
def nearby(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearby(listings(spark, sf_dir), 11).select("id", "city", stamp("auction_start_at"))


@query(
    "c7_nearby_all",
    f"""{L}, pairs AS (SELECT a.id, b.id AS near_id, row_number() OVER (PARTITION BY a.id
    ORDER BY b.auction_start_at ASC NULLS LAST, b.id) AS position FROM listings a JOIN listings b
    ON a.city = b.city AND a.id <> b.id AND b.is_published WHERE a.city <> '')
    SELECT id, near_id, position FROM pairs WHERE position <= 4""",
)
def nearby_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.nearby_all(listings(spark, sf_dir))


# --- counts and facets ----------------------------------------------------

ASKED = SearchQuery(state="NATION_7", bank="Bank 3", status="closed", min_price=1_000_000)
ASKED_PARTS = {
    "state": "state = 'NATION_7'",
    "bank": "bank_name = 'Bank 3'",
    "status": CLOSED,
}
ASKED_COMMON = "is_published AND reserve_price >= 1000000"
FACET_SQL = {
    "state": "state",
    "city": "city",
    "asset_type": "asset_type",
    "bank": "bank_name",
    "possession": "possession_type",
    "status": "status",
}


def _facets_sql(common: str, parts: dict[str, str]) -> str:
    pieces = []
    for name, column in FACET_SQL.items():
        where = " AND ".join([common, f"{column} IS NOT NULL"] + [p for other, p in parts.items() if other != name])
        pieces.append(
            f"(SELECT '{name}' AS facet, {column} AS value, count(*) AS n FROM listings WHERE {where} "
            f"GROUP BY {column} ORDER BY n DESC, value LIMIT 15)"
        )
    return f"{L} " + " UNION ALL ".join(pieces)


@query("d1_search_total", f"{L} SELECT count(*) AS total FROM listings WHERE {ASKED_COMMON} AND {' AND '.join(ASKED_PARTS.values())}")
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_envelope(listings(spark, sf_dir), ASKED, clock()).select("total")


@query("d2_facets", _facets_sql(ASKED_COMMON, ASKED_PARTS))
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(listings(spark, sf_dir), ASKED, clock())


@query("d2_facets_unfiltered", _facets_sql("is_published", {}))
def facets_unfiltered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(listings(spark, sf_dir), SearchQuery(), clock())


@query(
    "d3_totals",
    f"""{L} SELECT count(*) AS listings, count(DISTINCT state) AS states, count(DISTINCT bank_name) AS banks
    FROM listings WHERE is_published""",
)
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.totals(listings(spark, sf_dir))


@query(
    "d4_data_version",
    f"""{given(listings=LISTINGS, crawl_runs=CRAWL_RUNS)} SELECT count(*) AS count, {_iso_sql('max(first_seen_at)')} AS newest,
    {_iso_sql('max(updated_at)')} AS changed,
    (SELECT strftime(max(ran_at), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' FROM crawl_runs) AS collected
    FROM listings WHERE is_published""",
)
def data_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.data_version(listings(spark, sf_dir), relation(spark, sf_dir, CRAWL_RUNS))


@query("d5_count_by", f"{L} SELECT bank_name AS value, count(*) AS n FROM listings WHERE bank_name IS NOT NULL GROUP BY 1")
def count_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_by(listings(spark, sf_dir), "bank_name")


@query("d6_count_published", f"{L} SELECT count(*) AS n FROM listings WHERE is_published")
def count_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.count_listings(listings(spark, sf_dir), published=True)


#: Listings once the clock has moved their status and unpublished the old ones.
UPKEPT = f"""{L.rstrip()}, advanced AS (SELECT * REPLACE (CASE WHEN (status IN ('upcoming','live') AND auction_end_at < {NOW})
    OR ((status = 'live' OR (status = 'upcoming' AND auction_start_at <= {NOW})) AND auction_end_at IS NULL
    AND auction_start_at < {NOW} - INTERVAL '1' DAY) THEN 'closed'
    WHEN status = 'upcoming' AND auction_start_at <= {NOW} THEN 'live' ELSE status END AS status) FROM listings),
  upkept AS (SELECT * REPLACE (is_published AND NOT coalesce(status = 'closed'
    AND auction_start_at < {NOW} - INTERVAL '{RETENTION_DAYS}' DAY, false) AS is_published) FROM advanced) """


def _upkept_facets_sql(parts: dict[str, str]) -> str:
    told = _facets_sql("is_published", parts).removeprefix(f"{L} ")
    return UPKEPT + told.replace("FROM listings WHERE", "FROM upkept WHERE")


def _counts_kept(spark: SparkSession, sf_dir: str) -> str:
    """Counts after listings came in two batches, had their status moved by the clock and were unpublished by age."""
    path = f"{checkpoint_root(spark)}/counts-{uuid.uuid4().hex}"
    names = ["id", "is_published", "auction_start_at", "auction_end_at", *search.FACET_COLUMNS.values()]
    rows = saved(listings(spark, sf_dir).select(*names))
    none = rows.filter("false")
    kept_counts.add_batch(none, rows.filter("id % 3 > 0"), path, 0)
    kept_counts.add_batch(none, rows.filter("id % 3 = 0"), path, 1)
    moved = status.advance_statuses(rows, clock()).drop("became_live", "became_closed")
    kept_counts.add_batch(rows, moved, path, 2)
    kept_counts.add_batch(moved, status.expire_old(moved, clock()).drop("expired"), path, 3)
    return path


@query("d2_facets_kept", _upkept_facets_sql({}))
def facets_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_counts.facets(spark, _counts_kept(spark, sf_dir), SearchQuery())


@query("d2_facets_kept_one_chosen", _upkept_facets_sql({"state": "state = 'INDIA'"}))
def facets_kept_one_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_counts.facets(spark, _counts_kept(spark, sf_dir), SearchQuery(state="INDIA"))


@query(
    "d3_totals_kept",
    f"""{UPKEPT} SELECT count(*) AS listings, count(DISTINCT state) AS states, count(DISTINCT bank_name) AS banks
    FROM upkept WHERE is_published""",
)
def totals_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_counts.totals(spark, _counts_kept(spark, sf_dir))


@query("d5_count_by_kept", f"{UPKEPT} SELECT status AS value, count(*) AS n FROM upkept WHERE status IS NOT NULL GROUP BY 1")
def count_by_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_counts.count_by(spark, _counts_kept(spark, sf_dir), "status")


@query(
    "d11_stale_statuses",
    f"""{L} SELECT count(*) AS stale FROM listings WHERE (status = 'upcoming' AND auction_start_at <= {NOW})
    OR (status = 'live' AND auction_end_at < {NOW})
    OR (status = 'live' AND auction_end_at IS NULL AND auction_start_at < {NOW} - INTERVAL '1' DAY)""",
)
def stale_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.stale_status_count(listings(spark, sf_dir), clock())


# --- order and page -------------------------------------------------------


def _page_query(name: str, asked: SearchQuery, where: str, order: str) -> None:
    @query(
        name,
        f"""{L} SELECT id, title, city, CAST(reserve_price AS DOUBLE) AS reserve_price, {START_SQL} FROM listings
        WHERE {where} ORDER BY {order} LIMIT {len(asked.page.rows)} OFFSET {asked.page.rows.start}""",
    )
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        page = search.search_page(listings(spark, sf_dir), asked, clock())
        return page.select("id", "title", "city", money("reserve_price"), stamp("auction_start_at"))


_BY_START = SOONEST.replace("auction_start_at", "listings.auction_start_at")
_page_query("f1_default_sort", SearchQuery(), "is_published", _BY_START)
_page_query(
    "f2_price_low",
    SearchQuery(sort="price_low", page=Page(1, 50)),
    "is_published",
    "listings.reserve_price ASC NULLS LAST, id",
)
_page_query(
    "f2_price_high",
    SearchQuery(sort="price_high", page=Page(1, 50)),
    "is_published",
    "listings.reserve_price DESC NULLS LAST, id",
)
_page_query("f3_newest", SearchQuery(sort="newest"), "is_published", "first_seen_at DESC, id")

RANK_SQL = " + ".join(
    f"(len(string_split(' ' || regexp_replace(lower({c}), '[^a-z0-9]+', '  ', 'g') || ' ', ' {w} ')) - 1) * {weight}"
    for c, weight in textsearch.WEIGHTED_FIELDS
    for w in ("machinery", "sector")
)
_page_query(
    "f4_relevance",
    SearchQuery(text="machinery sector", sort="relevance", page=Page(1, 40)),
    f"is_published AND ((contains({TEXT_HIT}, ' machinery ') AND contains({TEXT_HIT}, ' sector ')) "
    "OR title ILIKE '%machinery sector%')",
    f"round({RANK_SQL}, 6) DESC, listings.auction_start_at ASC NULLS LAST, id",
)
_page_query("f5_third_page", SearchQuery(state="NATION_7", page=Page(3)), "is_published AND state = 'NATION_7'", _BY_START)


@query(
    "f5_page_envelope",
    f"""{L}, t AS (SELECT count(*) AS total FROM listings WHERE is_published AND state = 'NATION_7')
    SELECT total, greatest(CAST(ceil(total / 20.0) AS BIGINT), 1) AS total_pages, CAST(3 AS BIGINT) AS page,
    TRUE AS has_previous, 3 < greatest(CAST(ceil(total / 20.0) AS BIGINT), 1) AS has_next,
    CAST(CASE WHEN total = 0 THEN 0 ELSE 41 END AS BIGINT) AS first_index, least(60, total) AS last_index FROM t""",
)
def page_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search_envelope(listings(spark, sf_dir), SearchQuery(state="NATION_7", page=Page(3)), clock())


@query(
    "f6_text_rank",
    f"""{L} SELECT id, CAST(round({RANK_SQL}, 4) AS DOUBLE) AS score FROM listings
    WHERE contains({TEXT_HIT}, ' machinery ') AND contains({TEXT_HIT}, ' sector ')""",
)
def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = listings(spark, sf_dir).filter(textsearch.matches("machinery sector", textsearch.listing_line()))
    return hits.select("id", F.round(textsearch.rank("machinery sector"), 4).alias("score"))


# --- stored index -----------------------------------------------------------


def _indexed(spark: SparkSession, sf_dir: str, buckets: int = 16) -> DataFrame:
    """An index of the listings as they were, brought up to date by three segments of changes.

    Every third listing had another title and no locality then; every seventh was not there yet; and every listing with
    a text of its own was there under a negative id and is removed.
    """
    path = f"{checkpoint_root(spark)}/index-{uuid.uuid4().hex}"
    now = saved(listings(spark, sf_dir).select("id", *[name for name, _ in textsearch.WEIGHTED_FIELDS]))
    altered = now.withColumns({"title": F.concat(F.lit("Machinery sector of "), "city"), "locality": F.lit(None).cast("string")})
    gone = now.filter("id % 11 = 0").withColumn("id", -F.col("id") - 1)
    old = now.filter("id % 3 <> 0").unionByName(altered.filter("id % 3 = 0")).filter("id % 7 <> 0").unionByName(gone)
    search_index.write_index(old, path, buckets)
    search_index.add_changes(altered.filter("id % 3 = 0 AND id % 7 <> 0"), now.filter("id % 3 = 0 AND id % 7 <> 0"), path, 1, buckets)
    search_index.add_changes(now.limit(0), now.filter("id % 7 = 0"), path, 2, buckets)
    search_index.add_changes(gone, now.limit(0), path, 3, buckets)
    return search_index.read_index(spark, path)


@query(
    "f6_indexed_rank",
    f"""{L} SELECT id, CAST(round({RANK_SQL}, 4) AS DOUBLE) AS score FROM listings
    WHERE contains({TEXT_HIT}, ' machinery ') AND contains({TEXT_HIT}, ' sector ')""",
)
def indexed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = search_index.word_hits(_indexed(spark, sf_dir), "machinery sector", 16).filter("matches")
    return hits.select("id", F.round("rank", 4).alias("score"))


@query("b3_indexed_text", ORACLES["b3_text_predicate"])
def indexed_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = SearchQuery(text='"unit 12" machinery or building -phase')
    return search_index.indexed_filters(listings(spark, sf_dir), _indexed(spark, sf_dir), asked, clock(), 16).select(*ROW)


@query("f4_indexed_relevance", ORACLES["f4_relevance"])
def indexed_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = SearchQuery(text="machinery sector", sort="relevance", page=Page(1, 40))
    page = search_index.indexed_page(listings(spark, sf_dir), _indexed(spark, sf_dir), asked, clock(), 16)
    return page.select("id", "title", "city", money("reserve_price"), stamp("auction_start_at"))


@query(
    "f6_index_terms",
    f"""{L}, w AS (SELECT id, unnest(string_split(trim({TEXT_HIT}), ' ')) AS term FROM listings)
    SELECT term, count(DISTINCT id) AS n_listings, count(*) AS n_places FROM w WHERE term <> '' GROUP BY term""",
)
def index_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary of the compacted index: listings and places of every term."""
    now = search_index.merged(_indexed(spark, sf_dir).filter(F.col("kind") == search_index.WORD))
    return now.groupBy("term").agg(
        F.sum(F.size("ids").cast("long")).alias("n_listings"), F.sum(F.size("places").cast("long")).alias("n_places")
    )


# --- lifecycle ------------------------------------------------------------


@query("e8_effective_status", f"{L} SELECT id, {EFFECTIVE} AS effective FROM listings")
def effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = status.effective_status(F.col("status"), F.col("auction_start_at"), F.col("auction_end_at"), clock())
    return listings(spark, sf_dir).select("id", shown.alias("effective"))


@query("e9_status_is_stale", f"{L} SELECT id, status <> {EFFECTIVE} AS stale FROM listings")
def status_is_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = status.status_is_stale(F.col("status"), F.col("auction_start_at"), F.col("auction_end_at"), clock())
    return listings(spark, sf_dir).select("id", stale.alias("stale"))


_STEPPED = f"""{L},
 one AS (SELECT *, CASE WHEN status = 'upcoming' AND auction_start_at <= {NOW} THEN 'live' ELSE status END AS s1 FROM listings),
 two AS (SELECT *, CASE WHEN s1 IN ('upcoming','live') AND auction_end_at < {NOW} THEN 'closed' ELSE s1 END AS s2 FROM one),
 three AS (SELECT *, CASE WHEN s2 = 'live' AND auction_end_at IS NULL AND auction_start_at < {NOW} - INTERVAL '1' DAY
   THEN 'closed' ELSE s2 END AS s3 FROM two)"""


@query("e7_advance_statuses", f"{_STEPPED} SELECT id, s3 AS status FROM three")
def advance_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.advance_statuses(listings(spark, sf_dir), clock()).select("id", "status")


@query(
    "e7_advance_counts",
    f"""{_STEPPED} SELECT count(*) FILTER (s1 <> status) AS upcoming_to_live,
    count(*) FILTER (s2 <> s1) + count(*) FILTER (s3 <> s2) AS to_closed FROM three""",
)
def advance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.advance_counts(listings(spark, sf_dir), clock())


@query(
    "e11_expire_old",
    f"""{L} SELECT id, is_published AND NOT coalesce(is_published AND status = 'closed'
    AND auction_start_at < {NOW} - INTERVAL '90' DAY, FALSE) AS is_published FROM listings""",
)
def expire_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.expire_old(listings(spark, sf_dir), clock()).select("id", "is_published")
