"""Status worked out from the clock, and the stored status kept current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.schemas import RETENTION_DAYS, TERMINAL_STATUSES


def _days(count: int) -> Column:
    return F.make_dt_interval(F.lit(count))


def effective_status(status: Column, start: Column, end: Column, now: Column) -> Column:
    """What a reader is told: terminal and undated listings keep the stored status.

    With no end an auction is taken to last one day, closed from start + 1 day on.
    """
    return (
        F.when(status.isin(*TERMINAL_STATUSES) | start.isNull(), status)
        .when(now < start, "upcoming")
        .when(end.isNotNull(), F.when(now <= end, "live").otherwise("closed"))
        .otherwise(F.when(now < start + _days(1), "live").otherwise("closed"))
    )


def status_is_stale(status: Column, start: Column, end: Column, now: Column) -> Column:
    return status != effective_status(status, start, end, now)


def derived_status_filter(wanted: str, status: Column, start: Column, end: Column, now: Column) -> Column:
    """Reader-facing status filter; anything but the three clock-driven names is plain equality."""
    active = ~status.isin(*TERMINAL_STATUSES)
    day_after = start + _days(1)
    if wanted == "upcoming":
        return active & (start > now)
    if wanted == "live":
        return active & (start <= now) & ((end >= now) | (end.isNull() & (day_after > now)))
    if wanted == "closed":
        return active & (start <= now) & ((end < now) | (end.isNull() & (day_after <= now)))
    return status == wanted


def _steps(now: Column) -> tuple[Column, Column, Column]:
    """The three lifecycle steps in order, each seeing the result of the one before."""
    status, start, end = F.col("status"), F.col("auction_start_at"), F.col("auction_end_at")
    started = F.coalesce((status == "upcoming") & (start <= now), F.lit(False))
    finished = F.coalesce(status.isin("upcoming", "live") & (end < now), F.lit(False))
    now_live = (status == "live") | started
    assumed = F.coalesce(now_live & end.isNull() & (start < now - _days(1)), F.lit(False))
    return started, finished, assumed


def advance_statuses(listings: DataFrame, now: Column) -> DataFrame:
    """upcoming -> live -> closed by the clock; running it again changes nothing.

    Adds ``became_live`` and ``became_closed``; one listing may do both in one run.
    """
    started, finished, assumed = _steps(now)
    closed = finished | assumed
    moved = listings.withColumns({"became_live": started, "became_closed": closed})
    result = moved.withColumn(
        "status",
        F.when(F.col("became_closed"), "closed").when(F.col("became_live"), "live").otherwise(F.col("status")),
    )
    if "updated_at" in listings.columns:
        touched = F.col("became_live") | F.col("became_closed")
        result = result.withColumn("updated_at", F.when(touched, now).otherwise(F.col("updated_at")))
    return result


def advance_counts(listings: DataFrame, now: Column) -> DataFrame:
    started, finished, assumed = _steps(now)
    return listings.agg(
        F.count_if(started).alias("upcoming_to_live"),
        (F.count_if(finished) + F.count_if(assumed)).alias("to_closed"),
    )


def stale_status_count(listings: DataFrame, now: Column) -> DataFrame:
    """Stored statuses the clock contradicts; a rising count means upkeep has stopped."""
    status, start, end = F.col("status"), F.col("auction_start_at"), F.col("auction_end_at")
    stale = (
        ((status == "upcoming") & (start <= now))
        | ((status == "live") & (end < now))
        | ((status == "live") & end.isNull() & (start < now - _days(1)))
    )
    return listings.agg(F.count_if(stale).alias("stale"))


def expire_old(listings: DataFrame, now: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Unpublish auctions closed for longer than the retention period; no row is removed."""
    expired = F.coalesce(
        F.col("is_published") & (F.col("status") == "closed") & (F.col("auction_start_at") < now - _days(days)),
        F.lit(False),
    )
    result = listings.withColumn("expired", expired).withColumn(
        "is_published", F.col("is_published") & ~F.col("expired")
    )
    if "updated_at" in listings.columns:
        result = result.withColumn("updated_at", F.when(F.col("expired"), now).otherwise(F.col("updated_at")))
    return result
