"""Dates and times, always read day first.

Text is rewritten to ISO shape by regular expressions and then cast, so a wrong
day or month gives null and no row ever raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IST = "Asia/Kolkata"
MONTHS = (
    "january", "february", "march", "april", "may", "june", "july",
    "august", "september", "october", "november", "december",
)

_FOUR_DIGIT_YEAR = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})$"
_NAMED_MONTH = r"^(\d{1,2})(-|\s+)([A-Za-z]+)\2(\d{4})$"
_SHORT_MONTH = r"^(\d{1,2})(-)([A-Za-z]{3})-(\d{4})$"
_ISO_DAY = r"^(?!0000)\d{4}-\d{1,2}-\d{1,2}$"


def _month_number(name: Column, short_only: bool) -> Column:
    entries = []
    for number, month in enumerate(MONTHS, start=1):
        entries += [f"'{spelling}','{number}'" for spelling in dict.fromkeys([month[:3], month[:3] if short_only else month])]
    return F.try_element_at(F.expr(f"map({','.join(entries)})"), F.lower(name))


def _named(text: Column, pattern: str, short_only: bool = False) -> Column:
    """ISO text of a day written with a month name, null when it is not one."""
    month = _month_number(F.regexp_extract(text, pattern, 3), short_only)
    return F.concat(F.regexp_extract(text, pattern, 4), F.lit("-"), month, F.lit("-"), F.regexp_extract(text, pattern, 1))


def _as_day(iso: Column) -> Column:
    return F.regexp_extract(iso, _ISO_DAY, 0).try_cast("date")


def parse_date(value: Column) -> Column:
    """Day-first date: ``5/2/2026``, ``28-Jul-2022``, ``05.02.26`` is refused, ISO is accepted.

    Everything after a capital T is dropped first; two-digit years pivot at 69.
    """
    text = F.substring_index(F.trim(value), "T", 1)
    iso = F.regexp_replace(text, _FOUR_DIGIT_YEAR, "$4-$3-$1")
    iso = F.regexp_replace(iso, r"^(\d{1,2})([/-])(\d{1,2})\2(69|[7-9]\d)$", "19$4-$3-$1")
    iso = F.regexp_replace(iso, r"^(\d{1,2})([/-])(\d{1,2})\2(\d{2})$", "20$4-$3-$1")
    return _as_day(F.coalesce(_named(text, _NAMED_MONTH), iso))


def parse_indian_date(value: Column) -> Column:
    """Local date and time, or a date at midnight, read in Indian time; result is the UTC moment."""
    text = F.trim(F.regexp_replace(value, r"(?U)\s+", " "))
    split = r"^(\S+) (.+)$"
    day_text, clock = F.regexp_extract(text, split, 1), F.regexp_extract(text, split, 2)
    day = _as_day(
        F.coalesce(
            _named(day_text, _SHORT_MONTH, short_only=True), F.regexp_replace(day_text, _FOUR_DIGIT_YEAR, "$4-$3-$1")
        )
    )

    h24 = r"^(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?$"
    h12 = r"(?i)^(\d{1,2})(?::(\d{1,2}) ?|\.(\d{1,2}) )([ap])m$"

    def part(pattern: str, group: int) -> Column:
        return F.nullif(F.regexp_extract(clock, pattern, group), F.lit("")).try_cast("int")

    half = part(h12, 1)
    hour = F.when(clock.rlike(h24), part(h24, 1)).when(
        clock.rlike(h12) & half.between(1, 12),
        half % 12 + F.when(F.lower(F.regexp_extract(clock, h12, 4)) == "p", 12).otherwise(0),
    )
    minute = F.when(clock.rlike(h24), part(h24, 2)).otherwise(F.coalesce(part(h12, 2), part(h12, 3)))
    second = F.when(clock.rlike(h24), F.coalesce(part(h24, 3), F.lit(0))).otherwise(F.lit(0))
    sane = hour.between(0, 23) & minute.between(0, 59) & second.between(0, 59)
    midnight = day.cast("timestamp_ntz")
    local = F.when(
        sane, midnight + F.make_dt_interval(F.lit(0), hour, minute, second.cast("decimal(18,6)"))
    )
    only_day = parse_date(text).cast("timestamp_ntz")
    return F.to_utc_timestamp(F.coalesce(local, only_day).cast("timestamp"), IST)


_ISO_WHOLE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2}(?::\d{2})?)$"


def _from_week_date(text: Column) -> Column:
    """Text that starts with an ISO week date (``2026-W44-3``, ``2026W443``, the day may lack) with its calendar date."""
    whole = r"^(\d{4})(?:-W(\d{2})(?:-([1-7]))?|W(\d{2})([1-7])?)(?=$|[^0-9-])"

    def part(k: int) -> Column:
        return F.nullif(F.regexp_extract(text, whole, k), F.lit(""))

    year = part(1).try_cast("int")
    week = F.coalesce(part(2), part(4)).try_cast("int")
    day = F.coalesce(part(3), part(5), F.lit("1")).try_cast("int")
    fourth = F.make_date(year, F.lit(1), F.lit(4))  # always in week 1
    date = F.date_add(F.date_sub(fourth, F.weekday(fourth)), 7 * (week - 1) + day - 1)
    valid = (week >= 1) & (F.extract(F.lit("YEAROFWEEK"), date) == year)
    return F.when(valid, F.concat(date.cast("string"), F.regexp_replace(text, whole, "")))


def _spelt_out(text: Column) -> Column:
    """Other ISO forms as ``date T time zone``: basic forms, hours or minutes alone, any one separator, no zone."""
    text = F.when(text.rlike(r"^\d{4}-?W"), _from_week_date(text)).otherwise(
        F.regexp_replace(text, r"^(\d{4})(\d{2})(\d{2})($|[^0-9])", "$1-$2-$3$4")
    )
    for form, whole in (
        (r"^(.{10})$", "$1T00:00:00"),
        (r"^(.{10}).(\d{2})($|Z|[+-])", "$1T$2:00:00$3"),
        (r"^(.{10}).(\d{2}):?(\d{2})($|Z|[+-])", "$1T$2:$3:00$4"),
        (r"^(.{10}).(\d{2})(\d{2})(\d{2})($|Z|[.+-])", "$1T$2:$3:$4$5"),
        (r"^(.{10}).(\d{2}:\d{2}:\d{2})", "$1T$2"),
        (r"(T[0-9:.]+[+-]\d{2})$", "$1:00"),
        (r"(T[0-9:.]+[+-]\d{2})(\d{2})(?:(\d{2})(?:\.\d+)?)?$", "$1:$2:$3"),
        (r"(T[0-9:.]+[+-]\d{2}:\d{2}):$", "$1"),
        (r"(T[0-9:.]+[+-]\d{2}:\d{2}:\d{2})\.\d+$", "$1"),
        (r"^(.{10}T[0-9:]{8}(?:\.\d+)?)$", "$1Z"),
    ):
        text = F.regexp_replace(text, form, whole)
    return text


def parse_iso_utc(value: Column) -> Column:
    """ISO 8601 moment in any of its forms; ``Z`` and offsets are honoured, naive text is UTC, what is no moment is null."""
    text = F.replace(F.trim(value), F.lit(","), F.lit("."))
    text = F.when(text.rlike(_ISO_WHOLE), text).otherwise(_spelt_out(text))
    return F.regexp_extract(text, _ISO_WHOLE, 0).try_cast("timestamp")


def to_ist(moment: Column) -> Column:
    """Clock reading in India for a UTC moment."""
    return F.from_utc_timestamp(moment, IST)


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days between the date parts."""
    return F.datediff(later, earlier)
