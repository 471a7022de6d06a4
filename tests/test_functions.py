"""Example tables for the cleaning functions."""

from datetime import date, datetime
from decimal import Decimal as D

from pyspark.sql import functions as F

from lotwise.functions import area, dates, display, geo, money, quality, text
from lotwise.operators import documents

X = F.col


def check(values, build, cases, schema="x string"):
    assert values(build, [c[0] for c in cases], schema) == [c[1] for c in cases]


def test_parse_inr(values):
    check(
        values,
        lambda: money.parse_inr(X("x")),
        [
            ("Rs.3,37,55,000/-", D("33755000.00")),
            ("Rs. 337.55 Lakhs", D("33755000.00")),
            ("Rs 3.3755 Cr", D("33755000.00")),
            ("3.3755cr", D("3.38")),
            ("131850000.00000", D("131850000.00")),
            ("३,३७,५५,०००", D("33755000.00")),
            ("5 thousand only", D("5000.00")),
            ("2.345", D("2.34")),
            ("price on request", None),
            ("", None),
            (None, None),
        ],
    )


def test_money_display_and_ratio(values):
    check(
        values,
        lambda: money.format_inr(X("x").cast("decimal(18,2)")),
        [("33755000", "Rs 3.38 Cr"), ("4520000", "Rs 45.20 L"), ("9500", "Rs 9,500"), (None, "-")],
    )
    assert values(lambda: money.emd_ratio(F.lit(D("131850000.00")), F.lit(D("13185000.00"))), ["x"]) == [D("0.1000")]
    assert values(lambda: money.emd_ratio(F.lit(D("0.00")), F.lit(D("5.00"))), ["x"]) == [None]
    assert values(lambda: money.price_change(F.lit(D("100.00")), F.lit(D("66.00"))), ["x"]) == [D("-0.3400")]


def test_parse_date(values):
    check(
        values,
        lambda: dates.parse_date(X("x")),
        [
            ("05/02/2026", date(2026, 2, 5)),
            ("5-2-2026", date(2026, 2, 5)),
            ("28-Jul-2022", date(2022, 7, 28)),
            ("3 march 2024", date(2024, 3, 3)),
            ("01/01/75", date(1975, 1, 1)),
            ("01-01-68", date(2068, 1, 1)),
            ("05.02.26", None),
            ("2026-09-25T10:00:00", date(2026, 9, 25)),
            ("31/02/2026", None),
            ("02/13/2026", None),
            ("tomorrow", None),
            (None, None),
        ],
    )


def test_moments(values):
    check(
        values,
        lambda: dates.parse_iso_utc(X("x")),
        [
            ("2026-10-28T08:30:00.000Z", datetime(2026, 10, 28, 8, 30)),
            ("2026-10-28T14:00:00+05:30", datetime(2026, 10, 28, 8, 30)),
            ("2026-10-28", datetime(2026, 10, 28)),
            ("2026-10-28 08:30", datetime(2026, 10, 28, 8, 30)),
            ("2026", None),
            ("08:30", None),
            ("2026-02-30T00:00:00Z", None),
        ],
    )
    check(
        values,
        lambda: dates.parse_indian_date(X("x")),
        [
            ("05/02/2026 11:00", datetime(2026, 2, 5, 5, 30)),
            ("05-Feb-2026  11:00 PM", datetime(2026, 2, 5, 17, 30)),
            ("05.02.2026 12.15 AM", datetime(2026, 2, 4, 18, 45)),
            ("5 February 2026", datetime(2026, 2, 4, 18, 30)),
            ("05/02/2026 25:00", None),
        ],
    )


def test_area_and_coordinates(values):
    check(
        values,
        lambda: area.canonical_unit(X("x")),
        [("Sq. Ft.", "sqft"), ("Square Yards", "sqyards"), ("square metres", "sqmetres"), ("Bigha", "bigha"), (" . ", None)],
    )
    check(
        values,
        lambda: area.to_square_feet(X("v"), X("u")),
        [(("100", "Sq. Mt"), D("1076.39")), (("2", "acre"), D("87120.00")), (("5", "bigha"), None), (("-1", "sqft"), None), (("x", "sqft"), None)],
        "v string, u string",
    )
    place = lambda: geo.resolve_coordinates(
        X("a").cast("decimal(9,6)"), X("b").cast("decimal(9,6)"), X("s")
    )
    found = values(
        place,
        [("11.28", "77.58", "Tamil Nadu"), ("77.58", "11.28", "TAMIL NADU "), ("14.64", "71.70", "Uttar Pradesh"), ("14.64", "71.70", None), (None, "1", None)],
        "a string, b string, s string",
    )
    assert [r.flag for r in found] == [None, "coordinates_transposed", "coordinates_outside_state", None, None]
    assert found[1].latitude == D("11.280000") and found[2].latitude is None and found[3].longitude == D("71.700000")


def test_text(values):
    check(
        values,
        lambda: text.clean_text(X("x")),
        [("  a  b ;", "a b"), ("N/A", None), ("x � y", "x - y"), ("itâ€™s", "it's"), ("-", None), ("a\n\tb", "a b")],
    )
    assert values(lambda: text.clean_text(X("x"), 10), ["alpha beta gamma", "abcdefghijklmnop"]) == ["alpha...", "abcdefghij..."]
    check(values, lambda: text.title_case(X("x")), [("STATE BANK (PVT) LTD.", "State Bank (PVT) LTD."), ("MiXed", "MiXed")])
    check(values, lambda: text.normalise_pincode(X("x")), [("Mumbai 400 053", None), ("400 053", "400053"), ("PIN: 400053.", "400053"), ("4000531", None)])
    check(values, lambda: text.normalise_phone(X("x")), [("+91 98123-45678", "9812345678"), ("098123 45678", "9812345678"), ("123", None)])


def test_display_and_hashes(values):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    check(
        values,
        lambda: display.humanise(X("x").cast("timestamp"), now),
        [("2026-02-11 00:00:00", "in 32 days"), ("2026-01-09 22:00:00", "2 hours ago"), ("2026-01-10 00:00:10", "in 1 minute"), (None, "unknown")],
    )
    page = lambda: documents.canonical_sha256(X("x").cast("binary"))
    a, b, c = values(page, ["n Visitor Count:</b>2813191</b> price 5", "n Visitor Count:</b>2813999</b> price 5", "n Visitor Count:</b>2813191</b> price 6"])
    assert a == b != c
    check(values, lambda: documents.mime_extension(X("x")), [("text/html; charset=utf-8", ".html"), ("image/gif", ".bin"), (None, ".bin")])


def test_flags_keep_order_without_repeats(values):
    assert values(lambda: quality.flags(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b")), ["x"]) == [["b", "a"]]


def test_iso_forms_equal_the_standard_reader(values):
    from datetime import UTC, datetime

    forms = [
        "20261028T083000", "20261028", "2026-10-28T08", "2026-W44-3", "2026W443", "2026-W44", "2026W44T0830", "2026-W53-7", "2025-W53-1",
        "2026-W44-3T08:30:15.25+05:30", "20261028T0830+0530", "20261028T083000.123Z", "2026-10-28T08:30:00,5", "2026-10-28x08:30",
        "2026-10-28 08:30:00+05", "2026-10-28T08:30:00-053015", "2026-10-28T08:30:00.123456789Z", "2026-10-28T0830", " 2026-10-28 ",
        "2026-1028", "2026-W443", "2026-W00-1", "2026-W44-8", "2026-13-01", "2026-10-28T25", "2026-10-28T08:3", "later", "", "2026-10", "+00:00",
    ]

    def wanted(text):
        try:
            moment = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
        except ValueError:
            return None
        return (moment.astimezone(UTC) if moment.tzinfo else moment).replace(tzinfo=None).isoformat(timespec="microseconds")

    got = values(lambda: F.date_format(dates.parse_iso_utc(F.col("x")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), forms)
    assert dict(zip(forms, got)) == {text: wanted(text) for text in forms}
