"""Columns meant for readers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.dates import to_ist


def iso_text(moment: Column) -> Column:
    """``2026-10-28T08:30:00+00:00``, with microseconds only when there are any."""
    base = F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(moment, "SSSSSS")
    return F.concat(
        base, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00")
    )


def humanise(moment: Column, now: Column) -> Column:
    """``in 32 days`` / ``2 hours ago``: truncated, never less than one, ``unknown`` for null."""
    seconds = (F.unix_micros(moment) - F.unix_micros(now)) / F.lit(1_000_000)
    size = F.abs(seconds)
    unit = F.when(size < 3600, "minute").when(size < 86400, "hour").otherwise("day")
    per = F.when(size < 3600, 60).when(size < 86400, 3600).otherwise(86400)
    amount = F.greatest(F.floor(size / per).cast("long"), F.lit(1))
    phrase = F.concat(amount.cast("string"), F.lit(" "), unit, F.when(amount == 1, "").otherwise("s"))
    return F.when(moment.isNull(), "unknown").otherwise(
        F.when(seconds > 0, F.concat(F.lit("in "), phrase)).otherwise(F.concat(phrase, F.lit(" ago")))
    )


def format_ist(moment: Column) -> Column:
    return F.coalesce(F.date_format(to_ist(moment), "dd MMM yyyy, HH:mm"), F.lit("Not scheduled"))


def format_day(day: Column) -> Column:
    """Calendar day of a date column."""
    return F.coalesce(F.date_format(day, "dd MMM yyyy"), F.lit("-"))


def format_day_of(moment: Column) -> Column:
    """Calendar day in India of a moment."""
    return format_day(to_ist(moment).cast("date"))
