"""Merging parsed listings into the stored ones, with field history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.display import iso_text
from lotwise.functions.quality import is_publishable
from lotwise.operators.ordered import hot_keys, known_hot_keys, with_previous
from lotwise.schemas import CONTENT_FIELDS, CONTENT_NAMES, TRACKED_FIELDS

KEY = ("source_id", "external_id")


def as_text(name: str, kind: T.DataType) -> Column:
    """History text of a value: ISO moments, plain decimals."""
    return iso_text(F.col(name)) if isinstance(kind, T.TimestampType) else F.col(name).cast("string")


def fingerprint(fields: tuple[tuple[str, T.DataType], ...] = CONTENT_FIELDS) -> Column:
    """sha256 over the content fields as sorted JSON text; confidence and payload stay out."""
    texts = [as_text(name, kind).alias(name) for name, kind in sorted(fields, key=lambda f: f[0])]
    return F.sha2(F.to_json(F.struct(*texts), {"ignoreNullFields": "false"}), 256)


def with_fingerprint(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("content_hash", fingerprint())


def listing_id() -> Column:
    """Id of a listing first seen here: a function of its key, so retries agree."""
    return F.xxhash64(*KEY)


def _timeline(stored: DataFrame, parsed: DataFrame) -> DataFrame:
    """Stored rows (version 0) and parsed versions in one table, with ``action`` per parsed row.

    ``parsed`` carries ``seq`` (> 0, the order of application), ``seen_at`` and optionally
    ``source_document_id``.  A version equal to the state it meets is ``unchanged``; the state's
    hash is always that of the version before, so one look back decides.
    """
    shared = [*KEY, *CONTENT_NAMES, "confidence", "quality_flags", "raw_payload", "source_document_id", "content_hash"]
    if "source_document_id" not in parsed.columns:
        parsed = parsed.withColumn("source_document_id", F.lit(None).cast("long"))
    if "content_hash" not in parsed.columns:
        parsed = with_fingerprint(parsed)
    old = stored.select(
        *shared, "id", "round_number", "is_published", "first_seen_at", "last_verified_at", "updated_at",
        F.lit(0).cast("long").alias("seq"), F.lit(None).cast("timestamp").alias("seen_at"),
    )
    new = parsed.select(*shared, F.col("seq").cast("long").alias("seq"), "seen_at")
    return old.unionByName(new, allowMissingColumns=True)


def _versions_per_segment() -> Column:
    return F.floor(F.col("seq") / 10_000)


def _with_actions(timeline: DataFrame, segment: Column, hot: DataFrame | tuple[()]) -> DataFrame:
    marked = with_previous(timeline, KEY, ("seq",), segment, F.struct("content_hash"), hot=hot)
    action = (
        F.when(F.col("seq") == 0, "stored")
        .when(F.col("previous").isNull(), "created")
        .when(F.col("previous.content_hash") == F.col("content_hash"), "unchanged")
        .otherwise("updated")
    )
    return marked.withColumn("action", action).drop("previous")


def merge_listings(
    stored: DataFrame, parsed: DataFrame, segment: Column | None = None, hot: DataFrame | tuple[()] | None = None
) -> DataFrame:
    """Stored rows and parsed versions with the action each version causes: created, updated or unchanged.

    Write the result to a table when both the snapshot and the revisions are wanted.
    """
    segment = _versions_per_segment() if segment is None else segment
    return _with_actions(_timeline(stored, parsed), segment, busy_listings(parsed) if hot is None else hot)


def busy_listings(parsed: DataFrame) -> DataFrame:
    """Listings holding a large share of a batch's versions; stored rows add one each and cannot."""
    return hot_keys(parsed, KEY)


def known_busy_listings(parsed: DataFrame) -> DataFrame | tuple[()]:
    """``busy_listings`` written first, or an empty tuple: nothing is shuffled for a list that is short or empty."""
    return known_hot_keys(parsed, KEY)


#: What a snapshot takes from a listing's last version as it is.
CARRIED_OVER = (*CONTENT_NAMES, "confidence", "quality_flags", "raw_payload", "source_document_id", "content_hash")


def snapshot(actions: DataFrame, carried: Sequence[str] = CARRIED_OVER) -> DataFrame:
    """The listing table after the merge: one combined aggregate per key, whatever the number of versions.

    Content, confidence, flags, payload, document and publication come from the last version
    that changed anything; an unchanged version only refreshes ``last_verified_at``.
    ``carried`` may name fewer of ``CARRIED_OVER`` for a narrower table; the others are then not shuffled.
    """
    applied = F.when(F.col("action") != "unchanged", F.col("seq"))
    content = F.struct(
        *carried,
        F.when(F.col("action") == "stored", F.col("is_published"))
        .otherwise(is_publishable(F.col("confidence")))
        .alias("is_published"),
        F.coalesce(F.col("updated_at"), F.when(F.col("action") == "updated", F.col("seen_at"))).alias("updated_at"),
    )
    merged = actions.groupBy(*KEY).agg(
        F.max("id").alias("stored_id"),
        F.max("round_number").alias("stored_round"),
        F.max_by(content, applied).alias("c"),
        F.min(F.coalesce("first_seen_at", F.when(F.col("action") == "created", F.col("seen_at")))).alias(
            "first_seen_at"
        ),
        F.max(F.coalesce("seen_at", "last_verified_at")).alias("last_verified_at"),
    )
    kept = {name: F.col(f"c.{name}") for name in carried}
    kept |= {name: F.col(f"c.{name}") for name in ("is_published", "updated_at")}
    kept |= {name: F.col(name) for name in (*KEY, "first_seen_at", "last_verified_at")}
    kept["id"] = F.coalesce("stored_id", listing_id())
    kept["round_number"] = F.coalesce("stored_round", F.lit(1)).cast("int")
    order = (
        "id", *KEY, *CONTENT_NAMES, "confidence", "quality_flags", "raw_payload", "round_number", "source_document_id",
        "is_published", "content_hash", "first_seen_at", "last_verified_at", "updated_at",
    )
    return merged.select(*[kept[name].alias(name) for name in order if name in kept])


def revisions(
    actions: DataFrame,
    segment: Column | None = None,
    hot: DataFrame | tuple[()] | None = None,
    tracked: Sequence[str] = TRACKED_FIELDS,
) -> DataFrame:
    """One row per tracked field that an update changed, old and new as text.

    Only rows that changed the state are compared, so the usual unchanged majority is
    dropped before the look back.  ``tracked`` may name fewer fields; the texts of others are then not made or shuffled.
    Pass the batch's ``busy_listings`` as ``hot`` to spare a count.
    """
    kinds = dict(CONTENT_FIELDS)
    effective = actions.filter(F.col("action") != "unchanged").withColumn(
        "texts", F.struct(*[as_text(name, kinds[name]).alias(name) for name in tracked])
    )
    before = F.struct("texts", "id")
    linked = with_previous(
        effective, KEY, ("seq",), _versions_per_segment() if segment is None else segment, before, "before", hot
    ).filter(F.col("action") == "updated")
    changes = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("field_name"),
                    F.col(f"before.texts.{name}").alias("old_value"),
                    F.col(f"texts.{name}").alias("new_value"),
                )
                for name in tracked
            ]
        ),
        lambda c: ~c["old_value"].eqNullSafe(c["new_value"]),
    )
    return linked.select(
        *KEY,
        F.col("seq"),
        F.col("seen_at").alias("changed_at"),
        "source_document_id",
        F.explode(changes).alias("c"),
    ).select(*KEY, "seq", "changed_at", "source_document_id", "c.field_name", "c.old_value", "c.new_value")


def with_listing_ids(history: DataFrame, listings: DataFrame) -> DataFrame:
    """Revision rows keyed by listing id."""
    return history.join(listings.select("id", *KEY), list(KEY)).withColumnRenamed("id", "listing_id")


def reserve_direction(history: DataFrame) -> DataFrame:
    """Reserve price moves, ``down`` or ``up``, where both values are present and not zero."""
    old, new = (F.col(c).try_cast("decimal(18,2)") for c in ("old_value", "new_value"))
    moves = history.filter((F.col("field_name") == "reserve_price") & (old != 0) & (new != 0))
    return moves.withColumn("direction", F.when(new < old, "down").otherwise("up"))


def revisions_of(listings: DataFrame, history: DataFrame) -> DataFrame:
    """History beside its listing, in order of change."""
    return listings.join(history, list(KEY)).orderBy(*KEY, "changed_at", "seq", "field_name")


def sync_missing(local: DataFrame, remote: DataFrame, key: list[str]) -> DataFrame:
    """Local rows the remote table lacks, archive pointers cleared; existing rows win."""
    fresh = local.join(remote.select(*key), key, "left_anti")
    return fresh.withColumn("source_document_id", F.lit(None).cast("long"))


def sync_counts(local: DataFrame, remote: DataFrame, table: str) -> DataFrame:
    """Row counts of both sides, for a dry run."""
    there = remote.agg(F.count(F.lit(1)).alias("n")).scalar()
    return local.agg(F.count(F.lit(1)).alias("local_rows")).select(
        F.lit(table).alias("table_name"), "local_rows", there.alias("remote_rows")
    )
