"""Cleaning, scoring and display columns over whole tables, on text spelt from table columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import area, dates, display, geo, money, quality, text
from lotwise.plans.catalogue import query
from lotwise.plans.relations import CLOCK, LISTINGS, clock, given, listings, relation, stamp, stamp_sql, table
from lotwise.plans.search_queries import half_even, inr_sql
from lotwise.sources import fields, property, vehicle

L = given(listings=LISTINGS)
NOW = f"TIMESTAMP '{CLOCK}'"


def _column_query(name: str, source: str, output: str, expression: Callable[[], Column], sql: str) -> None:
    """Register ``expression`` over the rows of a portable SELECT that yields ``id``; ``sql`` is the same in SQL."""

    @query(name, f"{given(src=source)} SELECT id, {sql} AS {output} FROM src")
    def _(spark: SparkSession, sf_dir: str) -> DataFrame:
        return relation(spark, sf_dir, source).select("id", expression().alias(output))


# --- money ----------------------------------------------------------------

_WHOLE = "CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR(20))"
_FRACTION = "CAST(10 + o_orderkey % 90 AS VARCHAR(20))"
RUPEE_TEXT = f"""SELECT o_orderkey AS id, CASE o_orderkey % 9
  WHEN 0 THEN 'Rs.' || CAST(o_custkey % 90 + 1 AS VARCHAR(20)) || ',37,55,000/-'
  WHEN 1 THEN 'Rs. ' || CAST(o_custkey % 900 AS VARCHAR(20)) || '.' || {_FRACTION} || ' Lakhs only'
  WHEN 2 THEN 'INR ' || CAST(o_custkey % 90 AS VARCHAR(20)) || '.' || {_FRACTION} || ' Cr'
  WHEN 3 THEN {_WHOLE} || '.00000'
  WHEN 4 THEN '₹ ' || {_WHOLE} || ' rupees'
  WHEN 5 THEN CAST(o_custkey % 90 AS VARCHAR(20)) || '.5cr'
  WHEN 6 THEN 'to be announced'
  WHEN 7 THEN '२,५' || CAST(o_custkey % 10 AS VARCHAR(20)) || ' thousand'
  ELSE '' END AS x FROM {{orders}}"""
_CLEAN = (
    "regexp_replace(lower(trim(translate(x, '०१२३४५६७८९', '0123456789'))), 'rs\\.?|inr|₹|/-|only|rupees', ' ', 'g')"
)
_FACTOR = (
    "CASE "
    + " ".join(f"WHEN regexp_matches({_CLEAN}, '\\b{word}\\b') THEN {value}" for word, value in money.MULTIPLIERS)
    + " ELSE 1 END"
)
_column_query(
    "g1_parse_inr",
    RUPEE_TEXT,
    "amount",
    lambda: money.parse_inr(F.col("x")).cast("double"),
    f"""round(CAST(nullif(replace(regexp_extract({_CLEAN}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), ',', ''), '') AS DOUBLE) * ({_FACTOR}), 2)""",
)
PRICES = f"""SELECT id, CASE id % 4 WHEN 0 THEN CAST(id % 20000 AS DECIMAL(18,2)) WHEN 1 THEN CAST(1000000 AS DECIMAL(18,2)) * 1000001
  ELSE reserve_price END AS p, reserve_price, emd_amount FROM ({LISTINGS}) AS l"""
_column_query(
    "g2_is_plausible_price",
    PRICES,
    "plausible",
    lambda: money.is_plausible_price(F.col("p")),
    "coalesce(p >= 10000 AND p <= 1000000000000, FALSE)",
)
RATIO = "CASE WHEN reserve_price <> 0 AND emd_amount <> 0 THEN round(CAST(emd_amount AS DOUBLE) / CAST(reserve_price AS DOUBLE), 4) END"
_column_query(
    "g3_emd_ratio",
    PRICES,
    "ratio",
    lambda: money.emd_ratio(F.col("reserve_price"), F.col("emd_amount")).cast("double"),
    RATIO,
)
_column_query("g4_format_inr", PRICES, "shown", lambda: money.format_inr(F.col("p")), inr_sql("p"))

# --- dates ----------------------------------------------------------------

_MON = "CASE o_custkey % 3 WHEN 0 THEN 'Jul' WHEN 1 THEN 'dec' ELSE 'FEB' END"
_DAY = "CAST(1 + o_custkey % 31 AS VARCHAR(20))"
_MONTH = "CAST(1 + o_orderkey % 13 AS VARCHAR(20))"
_YEAR = "CAST(1998 + o_custkey % 30 AS VARCHAR(20))"
DATE_TEXT = f"""SELECT o_orderkey AS id, CASE o_orderkey % 10
  WHEN 0 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR}
  WHEN 1 THEN ' ' || {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} || ' '
  WHEN 2 THEN {_DAY} || '.' || {_MONTH} || '.' || {_YEAR}
  WHEN 3 THEN {_DAY} || '-' || {_MON} || '-' || {_YEAR}
  WHEN 4 THEN {_DAY} || ' ' || {_MON} || ' ' || {_YEAR}
  WHEN 5 THEN {_DAY} || ' December ' || {_YEAR}
  WHEN 6 THEN {_DAY} || '/' || {_MONTH} || '/' || CAST(10 + o_custkey % 90 AS VARCHAR(20))
  WHEN 7 THEN {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} || 'T08:30:00'
  WHEN 8 THEN {_DAY} || '.' || {_MONTH} || '.' || CAST(10 + o_custkey % 90 AS VARCHAR(20))
  ELSE 'soon' END AS x FROM {{orders}}"""


def _strptime_day(source: str) -> str:
    """Formats tried one by one; the driver's SQL engine accepts one-digit days and months too."""
    t = f"split_part(trim({source}), 'T', 1)"
    two = rf"regexp_matches({t}, '^\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2}}$')"
    four = rf"regexp_matches({t}, '^(\d{{1,2}}/\d{{1,2}}/\d{{4}}|\d{{1,2}}-\d{{1,2}}-\d{{4}}|\d{{1,2}}[.]\d{{1,2}}[.]\d{{4}})$')"
    named = rf"regexp_matches({t}, '^\d{{1,2}}[ -][A-Za-z]+[ -]\d{{4}}$')"
    parts = f"string_split_regex({t}, '[-/. ]')"
    year2 = f"CAST({parts}[3] AS INTEGER) + CASE WHEN CAST({parts}[3] AS INTEGER) >= 69 THEN 1900 ELSE 2000 END"
    month = f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower({parts}[2])[1:3])"

    def day(y: str, m: str, d: str) -> str:
        return f"TRY_CAST({y} || '-' || lpad(CAST({m} AS VARCHAR), 2, '0') || '-' || lpad({d}, 2, '0') AS DATE)"

    return f"""CASE WHEN {four} THEN {day(f'{parts}[3]', f'{parts}[2]', f'{parts}[1]')}
      WHEN {two} THEN {day(f'CAST({year2} AS VARCHAR)', f'{parts}[2]', f'{parts}[1]')}
      WHEN {named} THEN {day(f'{parts}[3]', month, f'{parts}[1]')}
      WHEN regexp_matches({t}, '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}$') THEN {day(f'{parts}[1]', f'{parts}[2]', f'{parts}[3]')} END"""


_column_query(
    "g5_parse_date",
    DATE_TEXT,
    "day",
    lambda: dates.parse_date(F.col("x")).cast("string"),
    f"CAST({_strptime_day('x')} AS VARCHAR)",
)
_H24 = "CAST(o_custkey % 25 AS VARCHAR(20)) || ':' || CAST(10 + o_orderkey % 50 AS VARCHAR(20))"
_H12 = "CAST(1 + o_custkey % 13 AS VARCHAR(20))"
LOCAL_TEXT = f"""SELECT o_orderkey AS id, CASE o_orderkey % 6
  WHEN 0 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} || '   ' || {_H24}
  WHEN 1 THEN {_DAY} || '-' || {_MONTH} || '-' || {_YEAR} || ' ' || {_H24} || ':07'
  WHEN 2 THEN {_DAY} || '-' || {_MON} || '-' || {_YEAR} || ' ' || {_H12} || ':05 PM'
  WHEN 3 THEN {_YEAR} || '-' || {_MONTH} || '-' || {_DAY} || ' ' || {_H12} || '.05 am'
  WHEN 4 THEN {_DAY} || ' ' || {_MON} || ' ' || {_YEAR}
  ELSE {_DAY} || '.' || {_MONTH} || '.' || {_YEAR} || ' ' || {_H12} || ':30pm' END AS x FROM {{orders}}"""
_T = r"trim(regexp_replace(x, '\s+', ' ', 'g'))"
_CLK = f"regexp_extract({_T}, '^\\S+ (.+)$', 1)"
_HALF = f"CAST(nullif(regexp_extract({_CLK}, '^(\\d+)', 1), '') AS INTEGER)"
_MIN = f"CAST(nullif(regexp_extract({_CLK}, '^\\d+[:.](\\d+)', 1), '') AS INTEGER)"
_SEC = f"coalesce(CAST(nullif(regexp_extract({_CLK}, '^\\d+:\\d+:(\\d+)$', 1), '') AS INTEGER), 0)"
_HOUR = f"""CASE WHEN regexp_matches({_CLK}, '^\\d+:\\d+(:\\d+)?$') THEN CASE WHEN {_HALF} < 24 THEN {_HALF} END
  WHEN regexp_matches(lower({_CLK}), '^(\\d+:\\d+ ?|\\d+[.]\\d+ )[ap]m$') AND {_HALF} <= 12
  THEN {_HALF} % 12 + CASE WHEN lower({_CLK}) LIKE '%pm' THEN 12 ELSE 0 END END"""
_column_query(
    "g6_parse_indian_date",
    LOCAL_TEXT,
    "moment",
    lambda: stamp(dates.parse_indian_date(F.col("x")), "moment"),
    f"""strftime(coalesce(CAST({_strptime_day(f"split_part({_T}, ' ', 1)")} AS TIMESTAMP) + to_hours({_HOUR}) + to_minutes({_MIN})
     + to_seconds({_SEC}), CAST({_strptime_day(_T)} AS TIMESTAMP)) - INTERVAL '330' MINUTE, '%Y-%m-%d %H:%M:%S')""",
)
ISO_TEXT = """SELECT event_id AS id, CASE event_id % 6
  WHEN 0 THEN CAST(CAST(ts AS DATE) AS VARCHAR(20)) || 'T08:30:00.000Z'
  WHEN 1 THEN CAST(CAST(ts AS DATE) AS VARCHAR(20)) || 'T' || CAST(10 + user_id % 14 AS VARCHAR(20)) || ':15:00+05:30'
  WHEN 2 THEN ' ' || CAST(CAST(ts AS DATE) AS VARCHAR(20)) || ' ' || CAST(10 + user_id % 14 AS VARCHAR(20)) || ':15 '
  WHEN 3 THEN CAST(CAST(ts AS DATE) AS VARCHAR(20))
  WHEN 4 THEN '2024-02-' || CAST(28 + user_id % 4 AS VARCHAR(20)) || 'T00:00:00Z'
  ELSE event_type END AS x FROM {events}"""
ISO_FORMS = """SELECT event_id AS id, replace(CAST(CAST(ts AS DATE) AS VARCHAR(20)), '-', CASE WHEN event_id % 3 = 0 THEN '-' ELSE '' END)
  || CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN 'T' || CAST(10 + user_id % 14 AS VARCHAR(20)) WHEN 2 THEN 'T' || CAST(10 + user_id % 14 AS VARCHAR(20)) || '45'
  WHEN 3 THEN 'T' || CAST(10 + user_id % 14 AS VARCHAR(20)) || '4510' ELSE ' ' || CAST(10 + user_id % 14 AS VARCHAR(20)) || ':45:10' END AS x FROM {events}"""
_column_query(
    "g7_parse_iso_basic_forms",
    ISO_FORMS,
    "moment",
    lambda: stamp(dates.parse_iso_utc(F.col("x")), "moment"),
    """strftime(try_strptime(replace(replace(replace(x, ' ', 'T'), '-', ''), ':', ''), ['%Y%m%dT%H%M%S', '%Y%m%dT%H%M', '%Y%m%dT%H', '%Y%m%d']),
     '%Y-%m-%d %H:%M:%S')""",
)
_column_query(
    "g7_parse_iso_utc",
    ISO_TEXT,
    "moment",
    lambda: stamp(dates.parse_iso_utc(F.col("x")), "moment"),
    """strftime(CASE WHEN regexp_matches(trim(x), '^\\d{4}-\\d{2}-\\d{2}') THEN
      TRY_CAST(regexp_replace(replace(trim(x), 'T', ' '), '(Z|[+]05:30)$', '') AS TIMESTAMP)
      - CASE WHEN x LIKE '%+05:30' THEN INTERVAL '330' MINUTE ELSE INTERVAL '0' MINUTE END END, '%Y-%m-%d %H:%M:%S')""",
)
_column_query(
    "g8_to_ist",
    "SELECT event_id AS id, CAST(ts AS TIMESTAMP) AS x FROM {events}",
    "local",
    lambda: stamp(dates.to_ist(F.col("x")), "local"),
    "strftime(x + INTERVAL '330' MINUTE, '%Y-%m-%d %H:%M:%S')",
)
_column_query(
    "g9_days_between",
    LISTINGS,
    "days",
    lambda: dates.days_between(F.col("emd_deadline_at"), F.col("auction_end_at")).cast("long"),
    "CAST(auction_end_at AS DATE) - CAST(emd_deadline_at AS DATE)",
)

# --- area and coordinates -------------------------------------------------

UNITS = ("Sq. Ft.", "square feet", "SQ-MT", "Square Yards", "acres", "Cent", "guntha", "Bigha", "sq metres", "gaj", "kanals", "")
AREAS = (
    "SELECT p_partkey AS id, CAST(p_size * 10 + p_partkey % 7 AS DECIMAL(14,2)) AS v, CASE p_partkey % 13 "
    + " ".join(f"WHEN {i} THEN '{unit}'" for i, unit in enumerate(UNITS))
    + " END AS u FROM {part}"
)
_RAW = "replace(replace(regexp_replace(lower(trim(u)), '[\\s._-]+', '', 'g'), 'square', 'sq'), 'feets', 'feet')"
_KNOWN = ", ".join(f"'{unit}'" for unit in area.KNOWN_UNITS)
UNIT_SQL = f"""CASE WHEN {_RAW} = '' THEN NULL WHEN {_RAW} IN ({_KNOWN}) THEN {_RAW} WHEN rtrim({_RAW}, 's') IN ({_KNOWN})
  THEN rtrim({_RAW}, 's') WHEN {_RAW} || 's' IN ({_KNOWN}) THEN {_RAW} || 's' ELSE {_RAW} END"""
FACTOR_SQL = f"CASE {UNIT_SQL} " + " ".join(f"WHEN '{u}' THEN {f}" for u, f in area.SQUARE_FEET.items()) + " END"
_column_query("g10_canonical_unit", AREAS, "unit", lambda: area.canonical_unit(F.col("u")), UNIT_SQL)
_column_query(
    "g11_to_square_feet",
    AREAS,
    "sqft",
    lambda: area.to_square_feet(F.col("v"), F.col("u")).cast("double"),
    f"CAST(round(CASE WHEN v > 0 THEN v * CAST({FACTOR_SQL} AS DECIMAL(10,4)) END, 2) AS DOUBLE)",
)
_column_query(
    "g12_format_area",
    AREAS,
    "shown",
    lambda: area.format_area(F.col("v"), F.col("u")),
    "format('{:,}', CAST(v AS BIGINT)) || ' ' || coalesce(nullif(u, ''), 'sqft')",
)
STATES = tuple(geo.STATE_BOXES)[::3]
PLACES = (
    "SELECT o_orderkey AS id, CAST(8 + (o_custkey % 2900) * 0.01 AS DECIMAL(9,6)) AS a, "
    "CAST(68 + (o_orderkey % 2900) * 0.01 AS DECIMAL(9,6)) AS b, o_orderkey % 3 AS swapped, CASE o_custkey % 14 "
    + " ".join(f"WHEN {i} THEN ' {name.title()} '" for i, name in enumerate(STATES))
    + " ELSE 'Elsewhere' END AS state FROM {orders}"
)


def _edge(i: int) -> str:
    boxes = " ".join(f"WHEN '{name}' THEN {box[i]}" for name, box in geo.STATE_BOXES.items())
    return f"CAST(CASE lower(trim(state)) {boxes} ELSE {geo.COUNTRY_BOX[i]} END AS DOUBLE)"


@query(
    "g13_bounds_for",
    f"{given(src=PLACES)} SELECT id, {_edge(0)} AS south, {_edge(1)} AS north, {_edge(2)} AS west, {_edge(3)} AS east FROM src",
)
def bounds_for(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = geo.bounds_for(F.col("state"))
    edges = [box[i].cast("double").alias(n) for i, n in enumerate(("south", "north", "west", "east"))]
    return relation(spark, sf_dir, PLACES).select("id", *edges)


_LAT, _LON = "CASE WHEN swapped = 1 THEN b ELSE a END", "CASE WHEN swapped = 1 THEN a WHEN id % 17 = 0 THEN NULL ELSE b END"


@query(
    "g14_resolve_coordinates",
    f"""{given(src=PLACES)}, p AS (SELECT id, {_LAT} AS x, {_LON} AS y, {_edge(0)} AS s, {_edge(1)} AS n, {_edge(2)} AS w, {_edge(3)} AS e FROM src),
    q AS (SELECT *, x BETWEEN s AND n AND y BETWEEN w AND e AS good, y BETWEEN s AND n AND x BETWEEN w AND e AS turned FROM p)
    SELECT id, CAST(CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN good THEN x WHEN turned THEN y END AS DOUBLE) AS latitude,
    CAST(CASE WHEN x IS NULL OR y IS NULL THEN NULL WHEN good THEN y WHEN turned THEN x END AS DOUBLE) AS longitude,
    CASE WHEN x IS NULL OR y IS NULL OR good THEN NULL WHEN turned THEN 'coordinates_transposed' ELSE 'coordinates_outside_state' END AS flag FROM q""",
)
def resolve_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = geo.resolve_coordinates(F.expr(_LAT), F.expr(_LON), F.col("state"))
    rows = relation(spark, sf_dir, PLACES).select("id", point.alias("p"))
    return rows.select(
        "id", F.col("p.latitude").cast("double").alias("latitude"), F.col("p.longitude").cast("double").alias("longitude"), "p.flag"
    )


# --- text -----------------------------------------------------------------

NAMES = """SELECT c_custkey AS id, CASE c_custkey % 8
  WHEN 0 THEN '  ' || upper(c_name) || '  RCC BLDG. (PVT), HIG  ;' WHEN 1 THEN c_name || ' â€“ ' || c_mktsegment || ',,'
  WHEN 2 THEN 'N/A' WHEN 3 THEN ' - ' WHEN 4 THEN upper(c_mktsegment) || ' COLONY NO. ' || CAST(c_custkey % 99 AS VARCHAR(20))
  WHEN 5 THEN 'Plot ' || c_name || ', PIN 4000' || CAST(10 + c_custkey % 90 AS VARCHAR(20)) || ' Mumbai'
  WHEN 6 THEN 'Pin 4 0 0 0 5 ' || CAST(c_custkey % 10 AS VARCHAR(20)) ELSE c_mktsegment END AS x FROM {customer}"""
CLEANED = "trim(regexp_replace(replace(x, 'â€“', '-'), '\\s+', ' ', 'g'), ' ,;:-')"
CLEAN_SQL = f"CASE WHEN {CLEANED} = '' OR lower({CLEANED}) IN ('null','none','n/a','na','-','nil') THEN NULL ELSE {CLEANED} END"
_ACRONYMS = ", ".join(f"'{word}'" for word in text.ACRONYMS)


def _cut_sql(cleaned: str, length: int) -> str:
    return f"CASE WHEN length({cleaned}) > {length} THEN regexp_replace({cleaned}[1:{length}], ' [^ ]*$', '') || '...' ELSE {cleaned} END"


_column_query("g15_clean_text", NAMES, "cleaned", lambda: text.clean_text(F.col("x"), 20), _cut_sql(f"({CLEAN_SQL})", 20))


#: White space of any script, as a class of the checking engine.
_SPACE = r"[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_REPAIRED = reduce(lambda x, pair: f"replace({x}, '{pair[0]}', '{pair[1].replace(chr(39), chr(39) * 2)}')", text.MOJIBAKE, "text")


@query(
    "g15_clean_documents",
    f"""WITH c AS (SELECT doc_id AS id, trim(regexp_replace({_REPAIRED}, '{_SPACE}+', ' ', 'g'), ' ,;:-') AS c FROM documents)
    SELECT id, length(CASE WHEN c = '' OR lower(c) IN ('null','none','n/a','na','-','nil') THEN NULL ELSE c END) AS chars,
    md5(c) AS digest FROM c""",
)
def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts in every script."""
    cleaned = text.clean_text(F.col("text"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), cleaned.alias("c"))
    return docs.select("id", F.length("c").cast("long").alias("chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


_column_query(
    "g16_title_case",
    NAMES,
    "titled",
    lambda: text.title_case(F.col("x")),
    f"""CASE WHEN ({CLEAN_SQL}) = upper({CLEAN_SQL}) THEN array_to_string(list_transform(string_split({CLEAN_SQL}, ' '),
     lambda w: CASE WHEN lower(trim(w, '.,()')) IN ({_ACRONYMS}) THEN w ELSE upper(w[1]) || lower(w[2:]) END), ' ') ELSE {CLEAN_SQL} END""",
)
PIN_SQL = f"""coalesce(nullif(regexp_extract(replace({CLEAN_SQL}, ' ', ''), '\\b([0-9]{{6}})\\b', 1), ''),
  nullif(regexp_extract({CLEAN_SQL}, '\\b([0-9]{{6}})\\b', 1), ''))"""
_column_query("g17_normalise_pincode", NAMES, "pincode", lambda: text.normalise_pincode(F.col("x")), PIN_SQL)
PHONES = """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '+91 98' || CAST(10000000 + o_custkey AS VARCHAR(20))
  WHEN 1 THEN '098-' || CAST(10000000 + o_custkey AS VARCHAR(20)) WHEN 2 THEN CAST(o_custkey AS VARCHAR(20))
  WHEN 3 THEN '022 2' || CAST(1000000 + o_custkey AS VARCHAR(20)) WHEN 4 THEN 'na'
  ELSE CAST(o_custkey AS VARCHAR(20)) || ' / 9812345678 / 9812345679' END AS x FROM {orders}"""
_DIGITS = "regexp_replace(x, '\\D', '', 'g')"
_PHONE91 = f"CASE WHEN {_DIGITS} LIKE '91%' AND length({_DIGITS}) = 12 THEN {_DIGITS}[3:] ELSE {_DIGITS} END"
_PHONE0 = f"CASE WHEN ({_PHONE91}) LIKE '0%' AND length({_PHONE91}) = 11 THEN ({_PHONE91})[2:] ELSE {_PHONE91} END"
_column_query(
    "g18_normalise_phone",
    PHONES,
    "phone",
    lambda: text.normalise_phone(F.col("x")),
    f"CASE WHEN length({_PHONE0}) BETWEEN 6 AND 15 THEN {_PHONE0} END",
)

# --- classification -------------------------------------------------------

KINDS = """SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Residential ' || o_orderstatus WHEN 1 THEN 'COMMERCIAL'
  WHEN 2 THEN 'Industrial Shed' WHEN 3 THEN 'Agriculture' WHEN 4 THEN o_orderpriority WHEN 5 THEN 'none' END AS kind,
  CASE o_custkey % 6 WHEN 0 THEN 'DRT Recovery' WHEN 1 THEN 'Liquidation sale' WHEN 2 THEN 'IBC' WHEN 3 THEN 'SARFAESI'
  WHEN 4 THEN 'Under Hypothecation' END AS action,
  CASE o_orderkey % 5 WHEN 0 THEN 'Physical Possession' WHEN 1 THEN 'SYMBOLIC' WHEN 2 THEN 'Other' END AS declared,
  CASE WHEN o_custkey % 9 = 0 THEN CAST(o_orderdate AS DATE) END AS physical_day,
  CASE WHEN o_custkey % 4 = 0 THEN CAST(o_orderdate AS DATE) END AS symbolic_day FROM {orders}"""
_column_query(
    "g19_asset_type",
    KINDS,
    "asset_type",
    lambda: quality.asset_type_of(F.col("kind")),
    """CASE WHEN kind IS NULL OR kind = 'none' THEN NULL WHEN lower(kind) LIKE '%residential%' THEN 'residential'
     WHEN lower(kind) LIKE '%commercial%' THEN 'commercial' WHEN lower(kind) LIKE '%industrial%' THEN 'industrial'
     WHEN lower(kind) LIKE '%agricultur%' THEN 'agricultural' ELSE 'other' END""",
)


@query(
    "g20_legal_basis",
    f"""{given(src=KINDS)} SELECT id, CASE WHEN lower(coalesce(action, '')) LIKE '%drt%' THEN 'drt' WHEN regexp_matches(lower(coalesce(action, '')),
    'ibc|liquidat|insolven') THEN 'ibc_liquidation' ELSE 'sarfaesi' END AS property_basis,
    CASE WHEN lower(coalesce(action, '')) LIKE '%hypothecation%' THEN 'contractual' WHEN lower(coalesce(action, '')) LIKE '%drt%' THEN 'drt'
    WHEN lower(coalesce(action, '')) LIKE '%sarfaesi%' THEN 'sarfaesi' ELSE 'contractual' END AS vehicle_basis FROM src""",
)
def legal_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, KINDS).select(
        "id",
        quality.property_legal_basis(F.col("action")).alias("property_basis"),
        quality.vehicle_legal_basis(F.col("action")).alias("vehicle_basis"),
    )


_DECLARED = """CASE WHEN lower(coalesce(declared, '')) LIKE '%physical%' THEN 'physical'
  WHEN lower(coalesce(declared, '')) LIKE '%symbolic%' THEN 'symbolic' ELSE 'unknown' END"""


@query(
    "g21_possession_type",
    f"""{given(src=KINDS)} SELECT id, CASE WHEN physical_day IS NOT NULL THEN 'physical' WHEN symbolic_day IS NOT NULL THEN 'symbolic'
    ELSE {_DECLARED} END AS property_possession, {_DECLARED} AS vehicle_possession FROM src""",
)
def possession_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, KINDS).select(
        "id",
        quality.property_possession(F.col("physical_day"), F.col("symbolic_day"), F.col("declared")).alias("property_possession"),
        quality.declared_possession(F.col("declared")).alias("vehicle_possession"),
    )


@query("g22_nested_access", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def nested_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = relation(spark, sf_dir, "SELECT event_id AS id, props FROM {events}").withColumn(
        "v", F.try_parse_json(F.concat(F.lit('{"a":{"b":'), F.col("props"), F.lit("}}")))
    )
    return events.select(
        "id", fields.text_at(F.col("v"), "a.b.k").try_cast("long").alias("k"), fields.text_at(F.col("v"), "a.x.k").alias("missing")
    )


SIZES = """SELECT p_partkey AS id, p_size, CASE WHEN p_partkey % 3 = 0 THEN '0' WHEN p_partkey % 3 = 1 THEN '""'
  ELSE CAST(p_size AS VARCHAR(20)) END AS floor_text,
  CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size * 2 AS VARCHAR(20)) ELSE 'n.a.' END AS built,
  CASE p_partkey % 4 WHEN 0 THEN 'Sq. Mt' WHEN 1 THEN 'bigha' ELSE 'Cents' END AS unit FROM {part}"""
_PICK = "CASE WHEN id % 3 = 2 THEN 1 WHEN id % 2 = 0 THEN 2 ELSE 3 END"
_UNIT = f"CASE WHEN {_PICK} = 3 THEN 'sqyard' ELSE CASE id % 4 WHEN 0 THEN 'sqmt' WHEN 1 THEN 'bigha' ELSE 'cents' END END"


_PARTS = "(CAST(area_value AS BIGINT) * CASE area_unit WHEN 'sqmt' THEN 107639 WHEN 'cents' THEN 4356000 WHEN 'sqyard' THEN 90000 END)"


@query(
    "g23_chosen_area",
    f"""{given(src=SIZES)}, c AS (SELECT id, CAST(p_size * {_PICK} AS DOUBLE) AS area_value, {_UNIT} AS area_unit FROM src)
    SELECT id, area_value, area_unit, CAST({half_even(_PARTS, 100)} AS DOUBLE) / 100 AS area_sqft FROM c""",
)
def chosen_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.concat(
        F.lit('{"propertyTypeDetails":{"carpetAreaSqFeet":'), F.col("floor_text"), F.lit(',"builtUpAreaSqFeet":"'), F.col("built"),
        F.lit('","areaInSqYard":'), (F.col("p_size") * 3).cast("string"),
        F.lit(',"unitOfMeasure":{"measurementAbb":"'), F.col("unit"), F.lit('"}}}'),
    )
    rows = fields.read_fields(
        relation(spark, sf_dir, SIZES).withColumn("p", F.try_parse_json(record)), "p", property.PROPERTY_TEXTS, {}
    )
    rows = rows.withColumn("a", property.chosen_area(F.col("carpet"), F.col("built_up"), F.col("yards"), F.col("area_label")))
    return rows.select(
        "id",
        F.col("a.value").cast("double").alias("area_value"),
        area.canonical_unit(F.col("a.unit")).alias("area_unit"),
        area.to_square_feet(F.col("a.value"), F.col("a.unit")).cast("double").alias("area_sqft"),
    )


TITLED = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'Flat' END AS subtype, CASE WHEN o_orderkey % 2 = 0 THEN 'residential' END AS kind,
  CASE WHEN o_custkey % 5 <> 0 THEN c_mktsegment END AS locality, CASE WHEN o_custkey % 7 = 0 THEN '' WHEN o_custkey % 7 = 1 THEN NULL
  ELSE c_name END AS city, CASE o_orderkey % 4 WHEN 0 THEN '$21' WHEN 1 THEN ' ' || c_name || ' ' WHEN 2 THEN 'nil' END AS summary,
  1990 + o_custkey % 30 AS year FROM {orders} JOIN {customer} ON o_custkey = c_custkey"""


@query(
    "g24_titles",
    f"""{given(src=TITLED)} SELECT id, concat_ws(' ', coalesce(subtype, kind, 'Property'), 'at ' || locality, 'in ' || nullif(city, '')) AS title,
    CASE WHEN id % 4 = 1 THEN trim(summary) END AS description,
    coalesce(nullif(concat_ws(' ', CASE WHEN id % 3 = 1 THEN CAST(year AS VARCHAR) END, kind, locality), ''), 'Vehicle') AS vehicle_title,
    nullif(concat_ws('; ', 'Fuel: ' || kind, 'Body: ' || subtype, 'Engine: ' || locality || ' cc', 'Odometer: ' || CASE WHEN id % 3 = 2
    THEN CAST(year AS VARCHAR) END || ' km'), '') AS vehicle_description FROM src""",
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    subtype, kind, locality, year = (F.col(c) for c in ("subtype", "kind", "locality", "year"))
    return relation(spark, sf_dir, TITLED).select(
        "id",
        property.property_title(subtype, kind, locality, F.col("city")).alias("title"),
        property.real_description(F.col("summary")).alias("description"),
        vehicle.vehicle_title(F.when(F.col("id") % 3 == 1, year), kind, locality, F.lit(None).cast("string")).alias("vehicle_title"),
        vehicle.vehicle_description(kind, subtype, locality, F.when(F.col("id") % 3 == 2, year.cast("string"))).alias(
            "vehicle_description"
        ),
    )


SPANS = f"""SELECT id, auction_start_at AS s, CASE WHEN id % 5 = 0 THEN CAST(auction_start_at - INTERVAL '1' DAY AS TIMESTAMP)
  ELSE auction_end_at END AS e FROM ({LISTINGS}) AS l"""


@query(
    "g25_schedule",
    f"""{given(src=SPANS)} SELECT id, {stamp_sql("CASE WHEN e < s THEN NULL ELSE e END", "end_at")},
    CASE WHEN e < s THEN 'auction_end_before_start' END AS flag FROM src""",
)
def schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("s"), F.col("e")
    return relation(spark, sf_dir, SPANS).select(
        "id", stamp(quality.repaired_end(s, e), "end_at"), quality.end_flag(s, e).alias("flag")
    )


SHARES = f"SELECT id, reserve_price, CAST(id % 130 - 10 AS DECIMAL(10,2)) AS pct FROM ({LISTINGS}) AS l"
_column_query(
    "g26_emd_from_percentage",
    SHARES,
    "emd",
    lambda: money.emd_from_percentage(F.col("reserve_price"), F.col("pct")).cast("double"),
    "CASE WHEN pct > 0 AND pct <= 100 THEN round(CAST(reserve_price AS DOUBLE) * CAST(pct AS DOUBLE) / 100, 2) END",
)
_RATIO_FLAG = f"""CASE WHEN NOT ({RATIO}) BETWEEN 0.05 AND 0.20 THEN 'emd_ratio_unusual:' || CAST(CAST({RATIO} AS DECIMAL(18,4)) AS VARCHAR) END"""


@query(
    "g27_money_sanity",
    f"""{given(src=PRICES)} SELECT id, CAST(CASE WHEN p >= 10000 AND p <= 1000000000000 THEN p END AS DOUBLE) AS kept,
    CASE WHEN p IS NOT NULL AND NOT (p >= 10000 AND p <= 1000000000000) THEN 'reserve_price_implausible' END AS flag,
    {_RATIO_FLAG} AS ratio_flag FROM src""",
)
def money_sanity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, PRICES).select(
        "id",
        quality.plausible_reserve(F.col("p")).cast("double").alias("kept"),
        quality.implausible_flag(F.col("p")).alias("flag"),
        quality.ratio_flag(F.col("reserve_price"), F.col("emd_amount")).alias("ratio_flag"),
    )


SCORED = f"""SELECT id, reserve_price, emd_amount AS emd, auction_start_at AS s, CASE WHEN auction_start_at IS NULL AND id % 2 = 0 THEN 'unscheduled'
  ELSE status END AS status, CASE WHEN id % 5 = 0 THEN '' ELSE state END AS state, CASE WHEN id % 7 = 0 THEN NULL ELSE city END AS city,
  CASE WHEN id % 4 = 0 THEN 'Vehicle' ELSE title END AS title FROM
  (SELECT id, reserve_price, CASE WHEN id % 8 = 0 THEN NULL ELSE emd_amount END AS emd_amount, auction_start_at, status, state, city, title
   FROM ({LISTINGS}) AS l) AS m"""
_SRATIO = RATIO.replace("emd_amount", "emd")
_SFLAG = _RATIO_FLAG.replace("emd_amount", "emd")
_COMMON = [
    ("reserve_price IS NULL", 0.40, "missing_reserve_price"),
    ("s IS NULL AND status = 'unscheduled'", 0.10, "auction_not_yet_scheduled"),
    ("s IS NULL AND status <> 'unscheduled'", 0.30, "missing_auction_date"),
    ("coalesce(state, '') = ''", 0.15, "missing_state"),
    ("coalesce(city, '') = ''", 0.10, "missing_city"),
    ("emd IS NULL AND status <> 'unscheduled'", 0.05, "missing_emd"),
]
_VEHICLE = [_COMMON[0], ("s IS NULL", 0.10, "auction_not_yet_scheduled"), *_COMMON[3:5], ("title = 'Vehicle'", 0.15, "missing_vehicle_identity")]


def _score_sql(rules: list[tuple[str, float, str]], more: str = "") -> str:
    lost = " - ".join(f"CASE WHEN {rule} THEN {amount} ELSE 0 END" for rule, amount, _ in rules)
    return f"CAST(round(greatest(0, 1.0 - {lost}{more}), 2) AS DOUBLE) AS confidence"


def _flags_sql(rules: list[tuple[str, float, str]], first: str = "NULL") -> str:
    return f"concat_ws(', ', {first}, {', '.join(f'CASE WHEN {rule} THEN {chr(39)}{name}{chr(39)} END' for rule, _, name in rules)})"


@query(
    "g28_property_confidence",
    f"{given(src=SCORED)} SELECT id, {_score_sql(_COMMON, f' - CASE WHEN ({_SFLAG}) IS NOT NULL THEN 0.15 ELSE 0 END')} FROM src",
)
def property_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, _ = quality.property_score(*[F.col(c) for c in ("reserve_price", "s", "status", "state", "city", "emd")])
    return relation(spark, sf_dir, SCORED).select("id", score.cast("double").alias("confidence"))


@query("g29_vehicle_confidence", f"{given(src=SCORED)} SELECT id, {_score_sql(_VEHICLE)}, {_flags_sql(_VEHICLE)} AS flags FROM src")
def vehicle_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, reasons = quality.vehicle_score(*[F.col(c) for c in ("reserve_price", "s", "state", "city", "title")])
    flags = F.array_join(quality.flags(*reasons), ", ")
    return relation(spark, sf_dir, SCORED).select("id", score.cast("double").alias("confidence"), flags.alias("flags"))


@query("g30_flag_set", f"{given(src=SCORED)} SELECT id, {_flags_sql(_COMMON, _SFLAG)} AS flags FROM src")
def flag_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, reasons = quality.property_score(*[F.col(c) for c in ("reserve_price", "s", "status", "state", "city", "emd")])
    first = quality.ratio_flag(F.col("reserve_price"), F.col("emd"))
    flags = F.array_join(quality.flags(first, first, *reasons, *reasons), ", ")
    return relation(spark, sf_dir, SCORED).select("id", flags.alias("flags"))


# --- display --------------------------------------------------------------

_SECS = f"(epoch_us(auction_start_at) - epoch_us({NOW})) / 1000000"
_AMOUNT = f"""greatest(1, CAST(floor(abs({_SECS}) / CASE WHEN abs({_SECS}) < 3600 THEN 60 WHEN abs({_SECS}) < 86400 THEN 3600 ELSE 86400 END) AS BIGINT))"""
_PHRASE = f"""CAST({_AMOUNT} AS VARCHAR) || CASE WHEN abs({_SECS}) < 3600 THEN ' minute' WHEN abs({_SECS}) < 86400 THEN ' hour' ELSE ' day' END
  || CASE WHEN {_AMOUNT} = 1 THEN '' ELSE 's' END"""
_column_query(
    "g31_humanise",
    LISTINGS,
    "told",
    lambda: display.humanise(F.col("auction_start_at"), clock()),
    f"""CASE WHEN auction_start_at IS NULL THEN 'unknown' WHEN {_SECS} > 0 THEN 'in ' || {_PHRASE} ELSE {_PHRASE} || ' ago' END""",
)


@query(
    "g32_display_times",
    f"""{L} SELECT id, coalesce(strftime(auction_start_at + INTERVAL '330' MINUTE, '%d %b %Y, %H:%M'), 'Not scheduled') AS shown_time,
    coalesce(strftime(auction_end_at + INTERVAL '330' MINUTE, '%d %b %Y'), '-') AS shown_day,
    coalesce(strftime(physical_possession_date, '%d %b %Y'), '-') AS possession_day FROM listings""",
)
def display_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(spark, sf_dir).select(
        "id",
        display.format_ist(F.col("auction_start_at")).alias("shown_time"),
        display.format_day_of(F.col("auction_end_at")).alias("shown_day"),
        display.format_day(F.col("physical_possession_date")).alias("possession_day"),
    )


CHOICES = """SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN event_type END AS a, props AS b,
  CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE user_id END AS n, event_id AS m FROM {events}"""


@query(
    "g33_first_filled",
    f"{given(src=CHOICES)} SELECT id, CASE WHEN a <> '' THEN a ELSE b END AS words, CASE WHEN n <> 0 THEN n WHEN m <> 0 THEN m END AS number FROM src",
)
def first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relation(spark, sf_dir, CHOICES).select(
        "id", text.first_filled(F.col("a"), F.col("b")).alias("words"), text.first_nonzero(F.col("n"), F.col("m")).alias("number")
    )
