"""Property pages -> listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import quality
from lotwise.functions.area import canonical_unit, to_square_feet
from lotwise.functions.dates import parse_date, parse_iso_utc
from lotwise.functions.geo import resolve_coordinates
from lotwise.functions.text import clean_text, first_filled, normalise_phone, normalise_pincode, title_case
from lotwise.sources.fields import PERSONAL_FIELDS, either, read_fields, rupees
from lotwise.sources.payload import extract_payload, page_text, with_records

DETAIL_PATH = "/property-detail/"
DETAIL_ID = r"/property-detail/(\d+)/[0-9a-f]+"
RECORD_KEYS = ("propertyDetailId", "reservePrice")

# Where a property page's records keep each field.
PROPERTY_TEXTS = {
    "stated_id": "propertyDetailId",
    "raw_unique_id": "propertyUniqueId",
    "type_name": "propertySubType.propertyType.propertyType",
    "subtype_name": "propertySubType.propertySubType",
    "specific_subtype": "specificPropSubtype",
    "summary": "summaryDesc",
    "carpet": "propertyTypeDetails.carpetAreaSqFeet",
    "built_up": "propertyTypeDetails.builtUpAreaSqFeet",
    "yards": "propertyTypeDetails.areaInSqYard",
    "area_label": "propertyTypeDetails.unitOfMeasure.measurementAbb",
    "raw_address": "address",
    "raw_locality": "locality",
    "raw_city": "city.name",
    "raw_district": "district.name",
    "raw_state": "district.State.name",
    "raw_pincode": "pincode",
    "raw_latitude": "latitude",
    "raw_longitude": "longitude",
    "property_bank": "bankName",
    "property_branch": "branchName",
    "raw_symbolic_day": "symbolicPossDate",
    "raw_physical_day": "physicalpossdate",
    "raw_npa_day": "npaDate",
    "declared": "propertyPossessionType.propertyPossessionType",
    "action": "propertyTypeOfAction.typeOfAction",
}
PROPERTY_AMOUNTS = {"property_price": "propertyPrice", "npa_amount": "npaAmount"}
AUCTION_TEXTS = {
    "raw_start": "auctionFrom",
    "raw_end": "auctionTo",
    "raw_extended_end": "auctionExtendedTo",
    "raw_emd_end": "emdEnd",
    "raw_inspection_start": "inspectionStart",
    "raw_inspection_end": "inspectionEnd",
    "auction_bank": "bankName",
    "auction_branch": "auctionBranch",
    "checker": "checkerName",
    "inspector": "inspectionName",
    "inspector_phone": "inspectionMobileNo",
}
AUCTION_AMOUNTS = {"auction_price": "reservePrice", "auction_emd": "emd", "auction_step": "incrementPrice"}


def external_id(stated: Column, url: Column, pattern: str) -> Column:
    """Record id, else the digits of the URL; null when neither is there."""
    return F.coalesce(stated, F.nullif(F.regexp_extract(url, pattern, 1), F.lit("")))


def filled(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def chosen_area(carpet: Column, built_up: Column, yards: Column, unit: Column) -> Column:
    """struct(value, unit): first positive of carpet, built-up (record's unit) and square yards, as text or numbers."""

    def candidate(stated: Column, its_unit: Column) -> Column:
        value = stated.try_cast("decimal(24,8)")
        return F.when(value > 0, F.struct(value.alias("value"), its_unit.alias("unit")))

    return F.coalesce(candidate(carpet, unit), candidate(built_up, unit), candidate(yards, F.lit("sqyard")))


def property_title(subtype: Column, kind: Column, locality: Column, city: Column) -> Column:
    """``Flat at Andheri in Mumbai``; ``city`` is the raw name."""
    place = F.when(filled(city).isNotNull(), F.concat(F.lit("in "), F.coalesce(title_case(city), F.lit("None"))))
    words = F.concat_ws(
        " ",
        F.coalesce(filled(subtype), filled(kind), F.lit("Property")),
        F.concat(F.lit("at "), locality),
        place,
    )
    return clean_text(words, 250)


def real_description(text: Column) -> Column:
    """Cleaned text; a placeholder like ``$21`` is no description."""
    cleaned = clean_text(text, 2000)
    return F.when(~cleaned.rlike(r"^\$\d+$"), cleaned)


def property_rows(pages: DataFrame, now: Column) -> DataFrame:
    """One row per page, ``external_id`` null where the page holds no readable record.

    ``pages`` has ``source_id, url, content`` and whatever should be carried along.
    """
    with_payload = pages.withColumn("payload", extract_payload(page_text(F.col("content"))))
    records = with_records(with_payload, RECORD_KEYS, PERSONAL_FIELDS)
    read = records.withColumns(
        {
            "p": F.try_parse_json("record_propertyDetailId"),
            "a": F.coalesce(F.try_parse_json("record_reservePrice"), F.parse_json(F.lit("{}"))),
        }
    )
    raw = read_fields(read_fields(read, "p", PROPERTY_TEXTS, PROPERTY_AMOUNTS), "a", AUCTION_TEXTS, AUCTION_AMOUNTS)
    c = F.col
    clean = raw.withColumns(
        {
            "external_id": F.when(c("p").isNotNull(), external_id(filled(c("stated_id")), c("url"), DETAIL_ID)),
            "canonical_url": c("url"),
            "asset_class": F.lit("property"),
            "asset_type": quality.asset_type_of(c("type_name")),
            "asset_subtype": title_case(first_filled(c("subtype_name"), c("specific_subtype"))),
            "description": real_description(c("summary")),
            "area": chosen_area(c("carpet"), c("built_up"), c("yards"), c("area_label")),
            "address": clean_text(c("raw_address"), 1000),
            "locality": title_case(c("raw_locality")),
            "city": title_case(c("raw_city")),
            "district": title_case(c("raw_district")),
            "state": title_case(c("raw_state")),
            "pincode": F.coalesce(normalise_pincode(c("raw_pincode")), normalise_pincode(c("raw_address"))),
            "stated_price": rupees(either(c("auction_price"), c("property_price"))),
            "emd_amount": rupees(c("auction_emd")),
            "bid_increment": rupees(c("auction_step")),
            "outstanding_dues": rupees(c("npa_amount")),
            "auction_start_at": parse_iso_utc(c("raw_start")),
            "stated_end": parse_iso_utc(first_filled(c("raw_extended_end"), c("raw_end"))),
            "emd_deadline_at": parse_iso_utc(c("raw_emd_end")),
            "inspection_from": parse_iso_utc(c("raw_inspection_start")),
            "inspection_to": parse_iso_utc(c("raw_inspection_end")),
            "bank_name": clean_text(first_filled(c("property_bank"), c("auction_bank"))),
            "branch_name": title_case(first_filled(c("auction_branch"), c("property_branch"))),
            "symbolic_possession_date": parse_date(c("raw_symbolic_day")),
            "physical_possession_date": parse_date(c("raw_physical_day")),
            "npa_date": parse_date(c("raw_npa_day")),
            "legal_basis": quality.property_legal_basis(c("action")),
            "authorised_officer_name": title_case(first_filled(c("checker"), c("inspector"))),
            "authorised_officer_phone": normalise_phone(c("inspector_phone")),
            "unique_id": clean_text(c("raw_unique_id")),
        }
    )
    derived = clean.withColumns(
        {
            "asset_key": F.coalesce("unique_id", F.concat_ws(":", "source_id", "external_id")),
            "title": property_title(c("asset_subtype"), c("asset_type"), c("locality"), c("raw_city")),
            "point": resolve_coordinates(
                c("raw_latitude").try_cast("decimal(24,8)"), c("raw_longitude").try_cast("decimal(24,8)"), c("state")
            ),
            "area_value": c("area.value").try_cast("decimal(14,2)"),
            "area_unit": F.coalesce(canonical_unit(c("area.unit")), c("area.unit")),
            "area_sqft": to_square_feet(c("area.value"), c("area.unit")),
            "reserve_price": quality.plausible_reserve(c("stated_price")),
            "auction_end_at": quality.repaired_end(c("auction_start_at"), c("stated_end")),
            "possession_type": quality.property_possession(
                c("physical_possession_date"), c("symbolic_possession_date"), c("declared")
            ),
        }
    )
    start = c("auction_start_at")
    timed = derived.withColumns(
        {
            "latitude": c("point.latitude"),
            "longitude": c("point.longitude"),
            "status": quality.listing_status(start, c("auction_end_at"), now),
        }
    )
    confidence, reasons = quality.property_score(
        c("reserve_price"), start, c("status"), c("state"), c("city"), c("emd_amount")
    )
    return timed.withColumns(
        {
            "confidence": confidence,
            "quality_flags": quality.flags(
                F.when(c("area").isNotNull() & c("area_sqft").isNull(), "area_unit_unconvertible"),
                c("point.flag"),
                quality.implausible_flag(c("stated_price")),
                quality.ratio_flag(c("reserve_price"), c("emd_amount")),
                quality.end_flag(start, c("stated_end")),
                *reasons,
            ),
            "raw_payload": F.concat(
                F.lit('{"property":'), c("record_propertyDetailId"), F.lit(',"auction":'),
                F.coalesce("record_reservePrice", F.lit("{}")), F.lit("}"),
            ),
        }
    )
