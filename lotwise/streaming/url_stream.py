"""URL state kept by a stream of fetches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql import functions as F

#: What is kept per URL between batches; times are microseconds of the epoch.
STATE_SCHEMA = (
    "source_id string, last_modified string, content_hash string, etag string, document string, first_seen long, last_fetched long, last_changed long, "
    "fetch_count long, unchanged_streak long, versions long"
)
STATE_NAMES = [part.split()[0] for part in STATE_SCHEMA.split(", ")]
#: Columns that a fetch log may lack.
HEADERS = ("source_id", "last_modified")
OUTPUT_SCHEMA = "url string, " + STATE_SCHEMA


def fold_batch(known: dict | None, events: pd.DataFrame) -> dict | None:
    """State after one batch of a URL's recording attempts, ordered by (fetched_at, seq).

    An attempt older than the state's last fetch only counts: a late body cannot say
    what the page holds now.  Headers that the attempts lack are null.
    """
    events = events.assign(**{name: None for name in HEADERS if name not in events.columns})
    for event in events.sort_values(["fetched_us", "seq"]).itertuples(index=False):
        body, at = event.outcome == "ok", event.fetched_us
        if known is None:
            if body:
                known = {
                    "source_id": event.source_id, "last_modified": event.last_modified,
                    "content_hash": event.content_hash, "etag": event.etag, "document": event.document,
                    "first_seen": at, "last_fetched": at, "last_changed": at,
                    "fetch_count": 1, "unchanged_streak": 0, "versions": 1,
                }
            continue
        known["fetch_count"] += 1
        if at < known["last_fetched"]:
            known["unchanged_streak"] += 1
            continue
        known["last_fetched"] = at
        changed = body and event.content_hash != known["content_hash"]
        if body:
            known["etag"], known["last_modified"] = event.etag, event.last_modified
        if changed:
            known.update(content_hash=event.content_hash, document=event.document, last_changed=at, unchanged_streak=0)
            known["versions"] += 1
        else:
            known["unchanged_streak"] += 1
    return known


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = dict(zip(STATE_NAMES, state.get, strict=True)) if state.exists else None
    known = fold_batch(known, pd.concat(list(batches)))
    if known is not None:
        state.update(tuple(known[name] for name in STATE_NAMES))
        yield pd.DataFrame([{"url": key[0], **known}])


def url_state_stream(log: DataFrame) -> DataFrame:
    """Streaming DataFrame of changed URL states (update mode).

    ``source_id`` is that of the first body and ``last_modified`` that of the last, null where the log lacks them.

    Only recording attempts enter the stateful step.  One URL's share of one micro-batch
    is folded together, so bound a trigger's input where a URL may be fetched very often.
    """
    recording = log.filter(F.col("outcome").isin("ok", "not_modified")).withColumn(
        "fetched_us", F.unix_micros("fetched_at")
    )
    headers = [
        F.col(name).cast("string") if name in log.columns else F.lit(None).cast("string").alias(name) for name in HEADERS
    ]
    narrow = recording.select("url", "seq", "fetched_us", "outcome", "content_hash", "etag", "document", *headers)
    return narrow.groupBy("url").applyInPandasWithState(
        _advance, OUTPUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout
    )


def as_url_state(rows: DataFrame, headers: Sequence[str] = ()) -> DataFrame:
    """Stream output with times as timestamps, in the shape of the batch fold over a log with these ``headers``."""
    return rows.select(
        "url", *headers, "content_hash", "etag", "document",
        F.timestamp_micros("first_seen").alias("first_seen_at"),
        F.timestamp_micros("last_fetched").alias("last_fetched_at"),
        F.timestamp_micros("last_changed").alias("last_changed_at"),
        "fetch_count", "unchanged_streak", "versions",
    )


def latest(rows: DataFrame) -> DataFrame:
    """Last emitted row per URL from an append-only sink of update rows: counters only grow."""
    picked = rows.groupBy("url").agg(F.max_by(F.struct(*STATE_NAMES), "fetch_count").alias("s"))
    return picked.select("url", "s.*")
