"""Classification, flags and confidence of one listing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.money import emd_ratio, is_plausible_price
from lotwise.functions.text import clean_text, let
from lotwise.schemas import PUBLISH_THRESHOLD


def asset_type_of(label: Column) -> Column:
    """Source type name -> residential / commercial / industrial / agricultural / other."""

    def kind(text: Column) -> Column:
        return (
            F.when(text.contains("residential"), "residential")
            .when(text.contains("commercial"), "commercial")
            .when(text.contains("industrial"), "industrial")
            .when(text.contains("agricultur"), "agricultural")
            .when(text.isNotNull(), "other")
        )

    return let(F.lower(clean_text(label)), kind)


def _lowered(value: Column) -> Column:
    return F.coalesce(F.lower(value), F.lit(""))


def property_legal_basis(action: Column) -> Column:
    def basis(text: Column) -> Column:
        insolvency = text.contains("ibc") | text.contains("liquidat") | text.contains("insolven")
        return F.when(text.contains("drt"), "drt").when(insolvency, "ibc_liquidation").otherwise("sarfaesi")

    return let(_lowered(clean_text(action)), basis)


def vehicle_legal_basis(action: Column) -> Column:
    def basis(text: Column) -> Column:
        return (
            F.when(text.contains("hypothecation"), "contractual")
            .when(text.contains("drt"), "drt")
            .when(text.contains("sarfaesi"), "sarfaesi")
            .otherwise("contractual")
        )

    return let(_lowered(clean_text(action)), basis)


def declared_possession(declared: Column) -> Column:
    text = _lowered(declared)
    return F.when(text.contains("physical"), "physical").when(text.contains("symbolic"), "symbolic").otherwise("unknown")


def property_possession(physical_day: Column, symbolic_day: Column, declared: Column) -> Column:
    """A possession date outranks the declared type; physical outranks symbolic."""
    return (
        F.when(physical_day.isNotNull(), "physical")
        .when(symbolic_day.isNotNull(), "symbolic")
        .otherwise(declared_possession(declared))
    )


def flags(*candidates: Column) -> Column:
    """Flag list in the order given, nulls and repeats dropped."""
    return F.array_distinct(F.array_compact(F.array(*candidates)))


def plausible_reserve(reserve: Column) -> Column:
    return F.when(is_plausible_price(reserve), reserve)


def implausible_flag(reserve: Column) -> Column:
    return F.when(reserve.isNotNull() & ~is_plausible_price(reserve), "reserve_price_implausible")


def ratio_flag(reserve: Column, emd: Column) -> Column:
    """``emd_ratio_unusual:<ratio>`` outside 5 to 20 per cent."""
    share = emd_ratio(reserve, emd)
    return F.when(
        ~share.between(F.lit("0.05").cast("decimal(4,2)"), F.lit("0.20").cast("decimal(4,2)")),
        F.concat(F.lit("emd_ratio_unusual:"), share.cast("string")),
    )


def _blank(value: Column) -> Column:
    return value.isNull() | (value == "")


def _penalties(*rules: tuple[Column, str]) -> Column:
    """1.00 minus every penalty that applies, never below zero."""
    score = F.lit("1.00").cast("decimal(4,2)")
    for applies, amount in rules:
        score = score - F.when(applies, F.lit(amount).cast("decimal(3,2)")).otherwise(F.lit("0").cast("decimal(3,2)"))
    return F.greatest(score, F.lit("0").cast("decimal(4,2)")).cast("decimal(3,2)")


def property_score(
    reserve: Column, start: Column, status: Column, state: Column, city: Column, emd: Column
) -> tuple[Column, list[Column]]:
    """Confidence of a property and the flags that explain it."""
    unscheduled = status == "unscheduled"
    no_start = start.isNull()
    no_emd = emd.isNull() & ~unscheduled
    confidence = _penalties(
        (reserve.isNull(), "0.40"),
        (no_start & unscheduled, "0.10"),
        (no_start & ~unscheduled, "0.30"),
        (_blank(state), "0.15"),
        (_blank(city), "0.10"),
        (no_emd, "0.05"),
        (ratio_flag(reserve, emd).isNotNull(), "0.15"),
    )
    reasons = [
        F.when(reserve.isNull(), "missing_reserve_price"),
        F.when(no_start & unscheduled, "auction_not_yet_scheduled"),
        F.when(no_start & ~unscheduled, "missing_auction_date"),
        F.when(_blank(state), "missing_state"),
        F.when(_blank(city), "missing_city"),
        F.when(no_emd, "missing_emd"),
    ]
    return confidence, reasons


def vehicle_score(
    reserve: Column, start: Column, state: Column, city: Column, title: Column
) -> tuple[Column, list[Column]]:
    """Confidence of a vehicle and the flags that explain it."""
    anonymous = _blank(title) | (title == "Vehicle")
    confidence = _penalties(
        (reserve.isNull(), "0.40"),
        (start.isNull(), "0.10"),
        (_blank(state), "0.15"),
        (_blank(city), "0.10"),
        (anonymous, "0.15"),
    )
    reasons = [
        F.when(reserve.isNull(), "missing_reserve_price"),
        F.when(start.isNull(), "auction_not_yet_scheduled"),
        F.when(_blank(state), "missing_state"),
        F.when(_blank(city), "missing_city"),
        F.when(anonymous, "missing_vehicle_identity"),
    ]
    return confidence, reasons


def is_publishable(confidence: Column) -> Column:
    return confidence >= F.lit(str(PUBLISH_THRESHOLD)).cast("decimal(3,2)")


def listing_status(start: Column, end: Column, now: Column) -> Column:
    """Status stated at parse time: a started auction with no end is already closed."""
    return (
        F.when(start.isNull(), "unscheduled")
        .when(start > now, "upcoming")
        .when(end >= now, "live")
        .otherwise("closed")
    )


def repaired_end(start: Column, end: Column) -> Column:
    """An end before its start is dropped."""
    return F.when(~F.coalesce(end < start, F.lit(False)), end)


def end_flag(start: Column, end: Column) -> Column:
    return F.when(end < start, "auction_end_before_start")
