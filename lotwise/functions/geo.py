"""Coordinates checked against the box of the state they claim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.text import let

# State -> lowest latitude, highest latitude, lowest longitude, highest longitude.
STATE_BOXES = {
    "andaman & nicobar islands": (6.0, 14.0, 92.0, 94.5),
    "andhra pradesh": (12.5, 20.0, 76.5, 85.0),
    "arunachal pradesh": (26.5, 29.6, 91.4, 97.5),
    "assam": (24.0, 28.1, 89.6, 96.2),
    "bihar": (24.1, 27.6, 83.2, 88.4),
    "chandigarh": (30.6, 30.9, 76.6, 77.0),
    "chhattisgarh": (17.6, 24.2, 80.1, 84.5),
    "dadra & nagar haveli & daman & diu": (20.0, 20.9, 72.7, 73.3),
    "dadra & nagar haveli and daman & diu": (20.0, 20.9, 72.7, 73.3),
    "delhi": (28.3, 29.0, 76.7, 77.5),
    "goa": (14.7, 15.9, 73.5, 74.5),
    "gujarat": (20.0, 24.8, 68.0, 74.6),
    "haryana": (27.5, 31.0, 74.3, 77.7),
    "himachal pradesh": (30.2, 33.4, 75.4, 79.1),
    "jammu & kashmir": (32.1, 37.2, 73.7, 80.4),
    "jharkhand": (21.8, 25.5, 83.2, 88.0),
    "karnataka": (11.4, 18.6, 73.9, 78.7),
    "kerala": (8.1, 12.9, 74.7, 77.5),
    "ladakh": (32.1, 37.2, 75.7, 80.4),
    "lakshadweep": (8.0, 12.4, 71.6, 74.1),
    "madhya pradesh": (20.9, 27.0, 73.9, 82.9),
    "maharashtra": (15.5, 22.2, 72.5, 81.0),
    "manipur": (23.7, 25.8, 92.8, 94.9),
    "meghalaya": (24.9, 26.2, 89.7, 92.9),
    "mizoram": (21.8, 24.6, 92.1, 93.5),
    "nagaland": (25.1, 27.1, 93.2, 95.4),
    "odisha": (17.7, 22.7, 81.3, 87.6),
    "puducherry": (9.8, 12.1, 74.7, 80.0),
    "punjab": (29.4, 32.7, 73.7, 77.0),
    "rajasthan": (22.9, 30.3, 69.4, 78.4),
    "sikkim": (26.9, 28.3, 87.9, 89.0),
    "tamil nadu": (7.9, 13.7, 76.1, 80.5),
    "telangana": (15.7, 20.0, 77.1, 81.9),
    "tripura": (22.8, 24.7, 90.9, 92.5),
    "uttar pradesh": (23.7, 30.6, 76.9, 84.8),
    "uttarakhand": (28.6, 31.6, 77.4, 81.2),
    "west bengal": (21.3, 27.4, 85.7, 90.0),
}
# The whole country, for an unknown state.
COUNTRY_BOX = (6.0, 37.2, 68.0, 97.5)


def _box(box: tuple[float, float, float, float]) -> str:
    return "array(" + ",".join(f"cast({edge} as decimal(9,6))" for edge in box) + ")"


def bounds_for(state: Column) -> Column:
    """Box of the state as ``[min_lat, max_lat, min_lon, max_lon]``.

    The table is a literal of 37 entries: it never grows with the data, so it
    travels inside the expression and no join is planned.
    """
    table = F.expr("map(" + ",".join(f"'{name}',{_box(box)}" for name, box in STATE_BOXES.items()) + ")")
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(state))), F.expr(_box(COUNTRY_BOX)))


def resolve_coordinates(latitude: Column, longitude: Column, state: Column) -> Column:
    """struct(latitude, longitude, flag): kept, swapped and flagged, or discarded and flagged."""

    def outcome(lat: Column, lon: Column, flag: Column) -> Column:
        return F.struct(
            lat.cast("decimal(9,6)").alias("latitude"),
            lon.cast("decimal(9,6)").alias("longitude"),
            flag.cast("string").alias("flag"),
        )

    def placed(box: Column) -> Column:
        def inside(lat: Column, lon: Column) -> Column:
            return lat.between(box[0], box[1]) & lon.between(box[2], box[3])

        nothing = F.lit(None)
        return (
            F.when(latitude.isNull() | longitude.isNull(), outcome(nothing, nothing, nothing))
            .when(inside(latitude, longitude), outcome(latitude, longitude, nothing))
            .when(inside(longitude, latitude), outcome(longitude, latitude, F.lit("coordinates_transposed")))
            .otherwise(outcome(nothing, nothing, F.lit("coordinates_outside_state")))
        )

    return let(bounds_for(state), placed)
