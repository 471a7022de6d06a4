"""Rupee amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.text import let

# Multiplier words, first match wins, and the plausible price band.
MULTIPLIERS = (
    ("crores", 10_000_000),
    ("crore", 10_000_000),
    ("karod", 10_000_000),
    ("cr", 10_000_000),
    ("lakhs", 100_000),
    ("lacs", 100_000),
    ("lakh", 100_000),
    ("lac", 100_000),
    ("thousand", 1_000),
)
DEVANAGARI_DIGITS = "०१२३४५६७८९"
CURRENCY_WORDS = r"rs\.?|inr|₹|/-|only|rupees"
MIN_PLAUSIBLE = 10_000
MAX_PLAUSIBLE = 1_000_000_000_000


def _money(amount: Column) -> Column:
    """Half-even to paise; amounts beyond the storage width become null."""
    return F.bround(amount, 2).try_cast("decimal(18,2)")


def parse_inr(text: Column) -> Column:
    """Rupees written as text: grouping commas, currency and multiplier words, any script.

    A multiplier word glued to its number (``3.5cr``) is not seen, as in the source data rules.
    """
    plain = F.lower(F.trim(F.translate(text, DEVANAGARI_DIGITS, "0123456789")))

    def amount(words: Column) -> Column:
        factor = F.lit(1).cast("decimal(8,0)")
        for value in sorted({value for _, value in MULTIPLIERS}):
            spellings = "|".join(word for word, worth in MULTIPLIERS if worth == value)
            factor = F.when(words.rlike(rf"(?U)\b(?:{spellings})\b"), F.lit(value).cast("decimal(8,0)")).otherwise(factor)
        digits = F.replace(F.regexp_extract(words, r"[0-9][0-9,]*(?:\.[0-9]+)?", 0), F.lit(","), F.lit(""))
        return _money(digits.try_cast("decimal(28,8)") * factor)

    return let(F.regexp_replace(plain, CURRENCY_WORDS, " "), amount)


def parse_inr_number(number: Column) -> Column:
    """Rupees given as a number: the sign is kept."""
    return _money(number.try_cast("decimal(28,8)"))


def is_plausible_price(amount: Column) -> Column:
    return F.coalesce(amount.between(MIN_PLAUSIBLE, MAX_PLAUSIBLE), F.lit(False))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole to four places, null when either is missing or zero."""
    return F.when(
        (part != 0) & (whole != 0), F.bround(part / F.nullif(whole, F.lit(0).cast("decimal(18,2)")), 4)
    ).cast("decimal(18,4)")


def emd_ratio(reserve: Column, emd: Column) -> Column:
    return ratio(emd, reserve)


def price_change(earlier: Column, later: Column) -> Column:
    """Fractional change between two rounds; negative is a cut."""
    return F.when(
        (earlier != 0) & (later != 0),
        F.bround((later - earlier) / F.nullif(earlier, F.lit(0).cast("decimal(18,2)")), 4),
    ).cast("decimal(18,4)")


def format_inr(amount: Column) -> Column:
    """``Rs 3.38 Cr``, ``Rs 45.20 L``, ``Rs 9,500``, ``-``."""

    def scaled(unit: int) -> Column:
        return F.bround(amount / F.lit(unit).cast("decimal(8,0)"), 2).cast("decimal(20,2)").cast("string")

    return (
        F.when(amount.isNull(), "-")
        .when(amount >= 10_000_000, F.concat(F.lit("Rs "), scaled(10_000_000), F.lit(" Cr")))
        .when(amount >= 100_000, F.concat(F.lit("Rs "), scaled(100_000), F.lit(" L")))
        .otherwise(F.concat(F.lit("Rs "), F.format_number(F.bround(amount, 0), 0)))
    )


def emd_from_percentage(reserve: Column, percentage: Column) -> Column:
    """Deposit as a share of the reserve, for 0 < percentage <= 100."""
    return F.when((percentage > 0) & (percentage <= 100), _money(reserve * percentage / 100))
