"""Area units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.text import let

# Square feet in one unit.
SQUARE_FEET = {
    "sqft": "1",
    "sqfeet": "1",
    "squarefeet": "1",
    "sft": "1",
    "sqm": "10.7639",
    "sqmt": "10.7639",
    "sqmeter": "10.7639",
    "sqmeters": "10.7639",
    "squaremeters": "10.7639",
    "sqyard": "9",
    "sqyards": "9",
    "squareyards": "9",
    "gaj": "9",
    "acre": "43560",
    "acres": "43560",
    "hectare": "107639",
    "hectares": "107639",
    "cent": "435.6",
    "cents": "435.6",
    "guntha": "1089",
    "gunthas": "1089",
    "ground": "2400",
    "grounds": "2400",
    "are": "1076.39",
    "ares": "1076.39",
    "kanal": "5445",
    "marla": "272.25",
}
# Units whose size depends on the state, never converted.
AMBIGUOUS_UNITS = ("bigha", "bighas", "katha", "kattha", "biswa")
KNOWN_UNITS = (*SQUARE_FEET, *AMBIGUOUS_UNITS)


def canonical_unit(unit: Column) -> Column:
    """``Sq. Ft.`` -> ``sqft``; an unknown label is echoed in its cleaned form."""
    key = F.regexp_replace(F.lower(F.trim(unit)), r"(?U)[\s._-]+", "")
    key = F.replace(F.replace(key, F.lit("square"), F.lit("sq")), F.lit("feets"), F.lit("feet"))

    def known(label: Column) -> Column:
        singular, plural = F.rtrim(label, F.lit("s")), F.concat(label, F.lit("s"))
        return (
            F.when(label.isin(*KNOWN_UNITS), label)
            .when(singular.isin(*KNOWN_UNITS), singular)
            .when(plural.isin(*KNOWN_UNITS), plural)
            .otherwise(label)
        )

    return let(F.nullif(key, F.lit("")), known)


def to_square_feet(value: Column, unit: Column) -> Column:
    """Positive area in square feet, half-even to two places; null when it cannot be stated safely."""
    table = F.expr("map(" + ",".join(f"'{name}','{factor}'" for name, factor in SQUARE_FEET.items()) + ")")
    factor = F.try_element_at(table, canonical_unit(unit)).cast("decimal(10,4)")
    amount = value.try_cast("decimal(24,6)")
    return F.when(amount > 0, F.bround(amount * factor, 2).try_cast("decimal(14,2)"))


def format_area(value: Column, unit: Column) -> Column:
    shown = F.format_number(F.bround(value, 0), 0)
    return F.when(value.isNull(), "-").otherwise(
        F.concat(shown, F.lit(" "), F.coalesce(F.nullif(unit, F.lit("")), F.lit("sqft")))
    )
