"""Runs of a source: what to fetch next, how a run went, whether a source is healthy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.schemas import STALE_SOURCE_HOURS


def prioritise(discovered: DataFrame, state: DataFrame, limit: int | None) -> DataFrame:
    """URLs of the next run: never fetched in discovery order, then the stalest.

    ``discovered`` has ``url, position``; ``state`` has ``url, last_fetched_at`` of the same
    source.  With no need to choose, discovery order is kept.
    """
    joined = discovered.join(state.select("url", "last_fetched_at"), "url", "left")
    if limit is None:
        return joined.orderBy("position")
    everything = discovered.agg(F.count(F.lit(1))).scalar() <= limit
    chosen = F.when(~everything, F.col("last_fetched_at"))
    return joined.orderBy(chosen.asc_nulls_first(), "position").limit(limit)


def crawl_report(attempts: DataFrame, skip_unchanged: bool = True) -> DataFrame:
    """Nine counters per (run, source).

    ``attempts`` has ``run_id, source_id, outcome, listings, created, updated, same``: one row
    per URL with its fetch outcome, the number of listings parsed and what each did.
    """
    outcome = F.col("outcome")
    read = (outcome == "new") | ((outcome == "unchanged") & F.lit(not skip_unchanged))

    def total(name: str) -> Column:
        return F.coalesce(F.sum(F.when(read, F.col(name))), F.lit(0))

    return attempts.groupBy("run_id", "source_id").agg(
        F.count(F.lit(1)).alias("discovered"),
        F.count_if(read).alias("fetched"),
        F.count_if(outcome.isin("not_modified", "unchanged")).alias("unchanged"),
        F.count_if(outcome == "blocked_by_robots").alias("blocked"),
        F.count_if(outcome == "failed").alias("failed"),
        total("created").alias("listings_created"),
        total("updated").alias("listings_updated"),
        total("same").alias("listings_unchanged"),
        F.count_if(read & (F.col("listings") == 0)).alias("parse_failures"),
    )


def error_notes(errors: DataFrame, keep: int = 3) -> DataFrame:
    """First messages of each run joined by ``; ``: the cut happens before the lists are built."""
    first = Window.partitionBy("run_id", "source_id").orderBy("position")
    kept = errors.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep)
    return kept.groupBy("run_id", "source_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("nth", "message"))).getField("message"), "; ").alias("notes")
    )


def run_looks_healthy(discovered: Column, fetched: Column, failed: Column, parse_failures: Column) -> Column:
    """False when nothing was found, nothing found could be read, or most attempts failed."""
    attempted = fetched + failed
    return ~(
        (discovered == 0)
        | ((fetched != 0) & (parse_failures >= fetched))
        | ((attempted != 0) & (failed * 2 > attempted))
    )


def run_times(attempts: DataFrame) -> DataFrame:
    """When each run of a source ended, and its seconds from the first attempt to the last."""
    first, last = F.min("attempted_at"), F.max("attempted_at")
    took = ((F.unix_micros(last) - F.unix_micros(first)) / F.lit(1_000_000)).cast("decimal(10,2)")
    return attempts.groupBy("run_id", "source_id").agg(last.alias("ran_at"), took.alias("duration_seconds"))


def health_rows(reports: DataFrame, notes: DataFrame, times: DataFrame) -> DataFrame:
    """Rows to append to the health history, which ``check_health`` reads."""
    seen = F.col("listings_created") + F.col("listings_updated") + F.col("listings_unchanged")
    ok = run_looks_healthy(F.col("discovered"), F.col("fetched"), F.col("failed"), F.col("parse_failures"))
    told = reports.join(notes, ["run_id", "source_id"], "left").join(times, ["run_id", "source_id"])
    return told.select(
        "run_id", "source_id", "ran_at", "duration_seconds", "discovered", "fetched", "unchanged", "failed", "parse_failures",
        "listings_created", "listings_updated", seen.alias("listings_seen"), ok.alias("ok"), "notes",
    )


def check_health(history: DataFrame, sources: DataFrame, now: Column, stale_hours: int = STALE_SOURCE_HOURS) -> DataFrame:
    """Verdict per wanted source: one combined aggregate over the history."""
    runs = history.groupBy("source_id").agg(
        F.max("ran_at").alias("last_run"),
        F.max(F.when(F.col("listings_seen") > 0, F.col("ran_at"))).alias("last_productive"),
        F.max_by("ok", "ran_at").alias("last_ok"),
    )
    hours = (F.unix_micros(now) - F.unix_micros("last_productive")) / F.lit(3_600_000_000)
    joined = sources.select("source_id").join(runs, "source_id", "left").withColumn("hours_since_new", hours)
    never = F.col("last_run").isNull()
    failed = F.col("last_ok") == F.lit(False)
    barren = F.col("last_productive").isNull()
    stale = F.col("hours_since_new") > stale_hours
    reason = (
        F.when(never, "never run")
        .when(failed, "last run failed its own checks")
        .when(barren, "has never produced a listing")
        .when(
            stale,
            F.concat(
                F.lit("produced no listings for "), F.bround("hours_since_new", 0).cast("long").cast("string"), F.lit("h")
            ),
        )
        .otherwise("healthy")
    )
    return joined.select(
        "source_id", (never | (reason == "healthy")).alias("ok"), reason.alias("reason"), "last_run", "hours_since_new"
    )
