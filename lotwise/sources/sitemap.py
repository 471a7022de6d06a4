"""URL discovery from published sitemaps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOCATION = r"(?s)<loc>(.*?)</loc>"


def discover_urls(sitemaps: DataFrame, path_fragment: str, limit: int | None = None) -> DataFrame:
    """(url, position): detail URLs in first-seen order, repeats dropped, optionally the first ``limit``.

    ``sitemaps`` has ``sitemap_no, body``; a sitemap that could not be read has a null body and adds nothing.
    Repeats are settled by a combined minimum, so a URL listed everywhere costs one row per partial result.
    """
    found = sitemaps.select(
        "sitemap_no", F.posexplode(F.regexp_extract_all("body", F.lit(LOCATION), F.lit(1))).alias("pos", "url")
    ).filter(F.col("url").contains(path_fragment))
    first = found.groupBy("url").agg(F.min(F.struct("sitemap_no", "pos")).alias("position"))
    return first.orderBy("position").limit(limit) if limit else first
