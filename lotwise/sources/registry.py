"""Sources by id, and the job that turns fetched pages into listings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.operators.upsert import known_busy_listings, merge_listings, with_fingerprint
from lotwise.schemas import PARSED_LISTING
from lotwise.session import saved
from lotwise.sources import property as property_source
from lotwise.sources import vehicle as vehicle_source
from lotwise.sources.sitemap import discover_urls

#: Columns that travel with a page through its parser.
CARRIED = ("url", "page_seq", "seen_at")


@dataclass(frozen=True)
class Source:
    """A source plug-in: where its detail pages are, and how pages become listing rows.

    ``rows(pages, now)`` returns at least one row per page; a row with a null
    ``external_id`` is a page that could not be read.  One page may give many rows.
    """

    source_id: str
    detail_path: str
    rows: Callable[[DataFrame, Column], DataFrame]
    enabled: bool = True

    def discover(self, sitemaps: DataFrame, limit: int | None = None) -> DataFrame:
        return discover_urls(sitemaps, self.detail_path, limit)

    def parse(self, pages: DataFrame, now: Column) -> DataFrame:
        """Readable listings in the declared schema, page columns carried along."""
        return readable(conform(self.rows(pages, now), carried(pages)))


def carried(pages: DataFrame) -> list[str]:
    return [name for name in CARRIED if name in pages.columns]


def conform(rows: DataFrame, extra: list[str]) -> DataFrame:
    """Declared columns and types; fields a source never states are null."""
    columns = [
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in PARSED_LISTING.fields
    ]
    return rows.select(*columns, *extra)


def readable(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("external_id").isNotNull())


def default_registry() -> dict[str, Source]:
    """The two page layouts known out of the box; ids are the caller's to choose."""
    known = (
        Source("psb_property", property_source.DETAIL_PATH, property_source.property_rows),
        Source("psb_vehicle", vehicle_source.DETAIL_PATH, vehicle_source.vehicle_rows),
    )
    return {source.source_id: source for source in known}


def parse_attempts(pages: DataFrame, registry: dict[str, Source], now: Column) -> DataFrame:
    """Rows of every page of an enabled registered source, unreadable pages included."""
    extra = carried(pages)
    parts = [
        conform(source.rows(pages.filter(F.col("source_id") == source.source_id), now), extra)
        for source in registry.values()
        if source.enabled
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def parse_all(pages: DataFrame, registry: dict[str, Source], now: Column) -> DataFrame:
    """Listings of all registered sources; pages of other sources are left out."""
    return readable(parse_attempts(pages, registry, now))


def reparse(
    archive: DataFrame, stored: DataFrame, registry: dict[str, Source], now: Column
) -> tuple[DataFrame, DataFrame]:
    """(attempts, actions) of reading the archive again; nothing is fetched.

    Feed ``actions`` to the snapshot and revision operators, both to ``reparse_report``.
    ``archive`` carries ``page_seq`` (order of application) and ``seen_at``.
    Pages are parsed once: the attempts are saved, and everything after reads them.
    """
    attempts = saved(with_fingerprint(parse_attempts(archive, registry, now)))
    parsed = readable(attempts).withColumnRenamed("page_seq", "seq")
    actions = merge_listings(stored, parsed, hot=known_busy_listings(parsed))
    return attempts, actions


def reparse_report(attempts: DataFrame, actions: DataFrame) -> DataFrame:
    """Documents read, parsed and failed, and listings by action, per source."""
    read = attempts.groupBy("source_id").agg(
        F.countDistinct("url", "page_seq").alias("discovered"),
        F.countDistinct(F.when(F.col("external_id").isNotNull(), F.struct("url", "page_seq"))).alias("fetched"),
        F.countDistinct(F.when(F.col("external_id").isNull(), F.struct("url", "page_seq"))).alias("parse_failures"),
    )
    done = actions.filter(F.col("action") != "stored").groupBy("source_id").agg(
        *[F.count_if(F.col("action") == a).alias(f"listings_{a}") for a in ("created", "updated", "unchanged")]
    )
    return read.join(done, "source_id", "left").na.fill(0)
