"""Vehicle pages -> listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import quality
from lotwise.functions.dates import parse_date, parse_iso_utc
from lotwise.functions.money import emd_from_percentage
from lotwise.functions.text import clean_text, first_filled, normalise_pincode, title_case
from lotwise.sources.fields import PERSONAL_FIELDS, either, is_number, read_fields, rupees
from lotwise.sources.payload import extract_payload, page_text, with_records
from lotwise.sources.property import external_id, filled

DETAIL_PATH = "/vehicle-detail/"
DETAIL_ID = r"/vehicle-detail/(\d+)/[0-9a-f]+"

# Where a vehicle page's record keeps each field.
VEHICLE_TEXTS = {
    "stated_id": "vehicleId",
    "raw_collateral": "collateralId",
    "action": "typeOfAction",
    "raw_brand": "brand",
    "brand_name": "brandName",
    "raw_model": "model",
    "model_name": "modelName",
    "raw_variant": "variant",
    "registered": "registrationYear",
    "vehicle_type": "vehicleType",
    "body_type": "vehicleBodyType",
    "raw_fuel": "fuelType",
    "raw_engine": "engineCapacity",
    "raw_odometer": "odometerReading",
    "yard": "parkingYardAddress",
    "raw_locality": "repossessionLocality",
    "raw_city": "repossessionCity",
    "raw_district": "repossessionDistrict",
    "raw_state": "repossessionState",
    "raw_pincode": "repossessionPincode",
    "raw_start": "auctionFrom",
    "raw_start_time": "auctionStartTime",
    "raw_end": "auctionTo",
    "raw_end_time": "auctionEndTime",
    "raw_emd_end": "emdEnd",
    "raw_emd_end_time": "emdEndTime",
    "raw_inspection_start": "inspectionStart",
    "raw_inspection_end": "inspectionEnd",
    "raw_bank": "bankName",
    "raw_branch": "auctionBranch",
    "raw_npa_day": "npaDate",
    "declared": "possessionType",
    "checker": "checkerName",
}
VEHICLE_AMOUNTS = {
    "reserve": "reservePrice",
    "price": "price",
    "sort_price": "sortPrice",
    "emd": "emd",
    "emd_percentage": "emdPercentage",
    "step": "incrementPrice",
    "npa_amount": "npaAmount",
}


def vehicle_title(year: Column, brand: Column, model: Column, variant: Column) -> Column:
    """``2019 Maruti Swift VXi``, or ``Vehicle`` when nothing is known."""
    return F.coalesce(clean_text(F.concat_ws(" ", year.cast("string"), brand, model, variant)), F.lit("Vehicle"))


def vehicle_description(fuel: Column, body: Column, engine: Column, odometer: Column) -> Column:
    """``Fuel: Diesel; Body: Hatchback; Engine: 1248 cc; Odometer: 61000 km``, absent parts left out."""
    parts = F.concat_ws(
        "; ",
        F.concat(F.lit("Fuel: "), fuel),
        F.concat(F.lit("Body: "), body),
        F.concat(F.lit("Engine: "), engine, F.lit(" cc")),
        F.concat(F.lit("Odometer: "), odometer, F.lit(" km")),
    )
    return filled(parts)


def vehicle_rows(pages: DataFrame, now: Column) -> DataFrame:
    """One row per page, ``external_id`` null where the page holds no readable record."""
    with_payload = pages.withColumn("payload", extract_payload(page_text(F.col("content"))))
    records = with_records(with_payload, ("vehicleId",), PERSONAL_FIELDS)
    read = records.withColumn("v", F.try_parse_json("record_vehicleId"))
    raw = read_fields(read, "v", VEHICLE_TEXTS, VEHICLE_AMOUNTS)
    c = F.col
    share = F.when(is_number(c("emd_percentage.kind")), c("emd_percentage.text").try_cast("decimal(10,6)"))
    clean = raw.withColumns(
        {
            "external_id": F.when(c("v").isNotNull(), external_id(filled(c("stated_id")), c("url"), DETAIL_ID)),
            "canonical_url": c("url"),
            "asset_class": F.lit("vehicle"),
            "asset_type": F.lit("vehicle"),
            "legal_basis": quality.vehicle_legal_basis(c("action")),
            "asset_subtype": clean_text(first_filled(c("vehicle_type"), c("body_type"))),
            "year": F.year(parse_date(c("registered"))),
            "brand": clean_text(first_filled(c("raw_brand"), c("brand_name"))),
            "model": clean_text(first_filled(c("raw_model"), c("model_name"))),
            "trim": clean_text(c("raw_variant")),
            "fuel": clean_text(c("raw_fuel")),
            "body": clean_text(c("body_type")),
            "engine": clean_text(c("raw_engine")),
            "odometer": clean_text(c("raw_odometer")),
            "address": clean_text(c("yard"), 500),
            "locality": title_case(c("raw_locality")),
            "city": title_case(c("raw_city")),
            "district": title_case(c("raw_district")),
            "state": title_case(c("raw_state")),
            "pincode": normalise_pincode(c("raw_pincode")),
            "stated_price": rupees(either(c("reserve"), c("price"), c("sort_price"))),
            "stated_emd": rupees(c("emd")),
            "emd_share": share,
            "bid_increment": rupees(c("step")),
            "outstanding_dues": rupees(c("npa_amount")),
            "auction_start_at": parse_iso_utc(first_filled(c("raw_start"), c("raw_start_time"))),
            "auction_end_at": parse_iso_utc(first_filled(c("raw_end"), c("raw_end_time"))),
            "emd_deadline_at": parse_iso_utc(first_filled(c("raw_emd_end"), c("raw_emd_end_time"))),
            "inspection_from": parse_iso_utc(c("raw_inspection_start")),
            "inspection_to": parse_iso_utc(c("raw_inspection_end")),
            "bank_name": clean_text(c("raw_bank")),
            "branch_name": title_case(c("raw_branch")),
            "npa_date": parse_date(c("raw_npa_day")),
            "possession_type": quality.declared_possession(clean_text(c("declared"))),
            "authorised_officer_name": title_case(c("checker")),
            "collateral": clean_text(c("raw_collateral")),
        }
    ).withColumn("derived_emd", emd_from_percentage(c("stated_price"), c("emd_share")))
    start = F.col("auction_start_at")
    derived = clean.withColumns(
        {
            "asset_key": F.coalesce("collateral", F.concat_ws(":", "source_id", "external_id")),
            "title": vehicle_title(c("year"), c("brand"), c("model"), c("trim")),
            "description": vehicle_description(c("fuel"), c("body"), c("engine"), c("odometer")),
            "emd_amount": F.coalesce("stated_emd", "derived_emd"),
            "reserve_price": quality.plausible_reserve(c("stated_price")),
            "status": quality.listing_status(start, c("auction_end_at"), now),
        }
    )
    confidence, reasons = quality.vehicle_score(
        F.col("reserve_price"), start, F.col("state"), F.col("city"), F.col("title")
    )
    from_share = F.col("stated_emd").isNull() & F.col("derived_emd").isNotNull()
    return derived.withColumns(
        {
            "confidence": confidence,
            "quality_flags": quality.flags(
                F.when(from_share, "emd_derived_from_percentage"),
                quality.implausible_flag(F.col("stated_price")),
                *reasons,
            ),
            "raw_payload": F.concat(F.lit('{"vehicle":'), c("record_vehicleId"), F.lit("}")),
        }
    )
