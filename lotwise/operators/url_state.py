"""What is known about each URL, folded from the fetch log.

The log has one row per attempt: ``url, fetched_at, seq, outcome, content_hash,
etag, document`` and, if they are kept, ``source_id`` and ``last_modified``.  ``outcome`` is ``ok`` (a body came), ``not_modified`` or
anything else (failed, blocked: records nothing).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.ordered import with_previous

ORDER = ("fetched_at", "seq")


def fetch_outcome(robots_ok: Column, http_status: Column, known_hash: Column, new_hash: Column) -> Column:
    """Class of one attempt: blocked, not_modified, failed, unchanged or new.

    A null ``http_status`` is an attempt that ran out of retries.
    """
    return (
        F.when(~robots_ok, "blocked_by_robots")
        .when(http_status == 304, "not_modified")
        .when(http_status.isNull() | (http_status >= 400), "failed")
        .when(known_hash == new_hash, "unchanged")
        .otherwise("new")
    )


def _kept(log: DataFrame, name: str) -> Column:
    return F.col(name) if name in log.columns else F.lit(None).cast("string")


def _day(column: str = "fetched_at") -> Column:
    return F.date_trunc("day", F.col(column))


def fold_segments(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """One summary row per (url, segment); a busy URL is spread over its segments.

    Positions count the segment's recording rows.  Whether a segment's first body is
    a change depends on earlier segments and is left open here.
    """
    ok = F.col("outcome") == "ok"
    rows = log.filter(F.col("outcome").isin("ok", "not_modified")).withColumn(
        "_segment", _day() if segment is None else segment
    )
    inside = Window.partitionBy("url", "_segment").orderBy(*ORDER)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "_pos": F.row_number().over(inside).cast("long"),
            "_known": F.last(F.when(ok, F.col("content_hash")), ignorenulls=True).over(before),
        }
    )
    opens = ok & F.col("_known").isNull()
    turns = ok & (F.col("_known") != F.col("content_hash"))
    mark = F.struct(
        F.col("_pos").alias("pos"),
        F.col("fetched_at").alias("at"),
        F.col("content_hash").alias("hash"),
        F.col("document").alias("document"),
        _kept(log, "source_id").alias("source_id"),
    )
    body = F.struct(
        F.col("_pos").alias("pos"), F.col("content_hash").alias("hash"), F.col("etag").alias("etag"),
        _kept(log, "last_modified").alias("last_modified"),
    )
    return rows.groupBy("url", "_segment").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("fetched_at").alias("last_at"),
        F.min(F.when(opens, mark)).alias("opening"),
        F.max(F.when(turns, mark)).alias("turning"),
        F.count_if(turns).alias("turns"),
        F.max(F.when(ok, body)).alias("body"),
    )


def fold_url_state(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """Batch fold: first and last fetch, last change, counters, current hash, tag and document.

    Rules: the first body creates the row (count 1, streak 0); another hash is a change
    (streak 0); the same hash or a 304 adds one to the streak; a 304 before any body
    records nothing and never touches the tag.  ``source_id`` is that of the first body and
    ``last_modified`` that of the last, where the log has them.
    """
    along = Window.partitionBy("url").orderBy("_segment")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("url")
    segments = fold_segments(log, segment).withColumn(
        "known", F.last("body.hash", ignorenulls=True).over(earlier)
    )
    first_body_changes = F.col("opening").isNotNull() & (
        F.col("known").isNull() | (F.col("known") != F.col("opening.hash"))
    )
    counted = (
        F.when(F.col("known").isNotNull(), F.col("n"))
        .when(F.col("opening").isNotNull(), F.col("n") - F.col("opening.pos") + 1)
        .otherwise(F.lit(0).cast("long"))
    )
    segments = segments.withColumns(
        {
            "counted": counted,
            "change": F.coalesce(F.col("turning"), F.when(first_body_changes, F.col("opening"))),
            "changes": F.col("turns") + F.when(first_body_changes, 1).otherwise(0),
        }
    )
    segments = segments.withColumn(
        "era", F.sum(F.when(F.col("change").isNotNull(), 1).otherwise(0)).over(along)
    ).withColumn("last_era", F.max("era").over(whole))
    since = F.when(F.col("change").isNotNull(), F.col("n") - F.col("change.pos")).otherwise(F.col("counted"))
    with_body = F.when(F.col("body").isNotNull(), F.col("_segment"))
    more = {
        "source_id": F.min_by("opening.source_id", F.when(F.col("opening").isNotNull(), F.col("_segment"))),
        "last_modified": F.max_by("body.last_modified", with_body),
    }
    return (
        segments.groupBy("url")
        .agg(
            *[value.alias(name) for name, value in more.items() if name in log.columns],
            F.max_by("body.hash", with_body).alias("content_hash"),
            F.max_by("body.etag", with_body).alias("etag"),
            F.max_by("change.document", F.when(F.col("change").isNotNull(), F.col("_segment"))).alias("document"),
            F.min("opening.at").alias("first_seen_at"),
            F.max(F.when(F.col("counted") > 0, F.col("last_at"))).alias("last_fetched_at"),
            F.max("change.at").alias("last_changed_at"),
            F.sum("counted").alias("fetch_count"),
            F.sum(F.when(F.col("era") == F.col("last_era"), since).otherwise(0)).alias("unchanged_streak"),
            F.sum("changes").alias("versions"),
        )
        .filter(F.col("fetch_count") > 0)
    )


def mark_changes(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """Bodies of the log with ``previous`` (hash, at) of the body before and whether it changed."""
    bodies = log.filter(F.col("outcome") == "ok")
    value = F.struct(F.col("content_hash").alias("hash"), F.col("fetched_at").alias("at"))
    marked = with_previous(bodies, ["url"], ORDER, _day() if segment is None else segment, value)
    return marked.withColumn("changed", ~F.col("content_hash").eqNullSafe(F.col("previous.hash")))


def fold_documents(log: DataFrame, segment: Column | None = None) -> DataFrame:
    """Document rows (url, document): first fetch, last seen, times published.

    Only a real change makes or revisits a row; a body that differs in noise alone
    refreshes the row that is current.  Returning to old content reuses its row.
    """
    segment = _day() if segment is None else segment
    marked = mark_changes(log, segment)
    changes = marked.filter("changed").select("url", "document", *ORDER, F.col("previous.at").alias("before_at"))
    linked = with_previous(changes, ["url"], ORDER, segment, F.struct("document"), name="replaced")
    published = linked.select(
        "url", "document", F.col("fetched_at").alias("made_at"), F.col("fetched_at").alias("seen_at")
    )
    # The last body before a change was the last sight of the document it replaced.
    replaced = linked.filter(F.col("replaced").isNotNull()).select(
        "url", F.col("replaced.document").alias("document"), F.lit(None).cast("timestamp").alias("made_at"),
        F.col("before_at").alias("seen_at"),
    )
    current = marked.groupBy("url").agg(
        F.max_by("document", F.when(F.col("changed"), F.struct(*ORDER))).alias("document"),
        F.lit(None).cast("timestamp").alias("made_at"),
        F.max("fetched_at").alias("seen_at"),
    )
    return (
        published.unionByName(replaced)
        .unionByName(current)
        .groupBy("url", "document")
        .agg(
            F.min("made_at").alias("fetched_at"),
            F.max("seen_at").alias("last_seen_at"),
            F.count("made_at").alias("times_published"),
        )
    )
