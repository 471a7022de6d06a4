"""Kept counts against counting the listings, after inserts, updates and unpublishing."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import kept_counts, search, status, upsert
from lotwise.operators.search import SearchQuery
from lotwise.plans.relations import clock, listings
from lotwise.plans.state_queries import parsed_listings
from lotwise.schemas import LISTING

SF = "/root/testdata/sf0.001"
QUERIES = [SearchQuery(), SearchQuery(state="INDIA"), SearchQuery(bank="Bank 3"), SearchQuery(city="no such", include_unpublished=True)]


def rows_of(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """(path, final listings): created in two batches, changed by readings, moved by the clock, unpublished."""
    path = str(tmp_path_factory.mktemp("counts"))
    none = {"quality_flags": F.lit(None).cast("array<string>"), "raw_payload": F.lit(None).cast("string")}
    given = listings(spark, SF).withColumn("external_id", F.col("id").cast("string"))
    first = upsert.with_fingerprint(given.withColumns(none)).select(*[c.name for c in LISTING]).cache()
    empty = first.filter("false")
    kept_counts.add_batch(empty, first.filter("id % 3 > 0"), path, 0)
    kept_counts.add_batch(empty, first.filter("id % 3 = 0"), path, 1)
    parsed = parsed_listings(spark, SF).withColumns(none)
    merged = upsert.snapshot(upsert.merge_listings(first, parsed)).cache()
    touched = parsed.select(*upsert.KEY).distinct()
    changed = [rows.join(touched, list(upsert.KEY), "left_semi") for rows in (first, merged)]
    kept_counts.add_batch(*changed, path, 2)
    moved = status.advance_statuses(merged, clock()).drop("became_live", "became_closed")
    kept_counts.add_batch(merged, moved, path, 3)
    final = status.expire_old(moved, clock(), days=30).drop("expired").cache()
    kept_counts.add_batch(moved, final, path, 4)
    kept_counts.add_batch(moved, final, path, 4)  # the last batch is run again
    assert merged.filter("NOT is_published").count() != final.filter("NOT is_published").count()
    return path, final


@pytest.mark.parametrize("query", QUERIES)
def test_facets_equal_a_count(spark, kept, query):
    path, final = kept
    wanted = rows_of(search.facets(final, query, clock(), 7))
    assert rows_of(kept_counts.facets(spark, path, query, 7)) == wanted != []


def test_totals_and_counts_equal_a_count(spark, kept):
    path, final = kept
    assert rows_of(kept_counts.totals(spark, path)) == rows_of(search.totals(final))
    assert rows_of(kept_counts.count_by(spark, path, "bank")) == rows_of(search.count_by(final, "bank_name"))
    for published in (True, False):
        found = kept_counts.count_listings(spark, path, published)
        assert rows_of(found) == rows_of(search.count_listings(final, published))


def test_folded_batches_tell_the_same(spark, kept, tmp_path):
    path, _ = kept
    folded = str(tmp_path / "folded")
    kept_counts.fold_batches(spark, path, folded)
    for query in QUERIES[:2]:
        assert rows_of(kept_counts.facets(spark, folded, query)) == rows_of(kept_counts.facets(spark, path, query))
    assert rows_of(kept_counts.totals(spark, folded)) == rows_of(kept_counts.totals(spark, path))


def test_only_the_chosen_facet_is_opened(spark, kept):
    rows = kept_counts.read_counts(spark, kept[0], "bank", F.col("by_value") == "Bank 3")
    opened = rows._jdf.queryExecution().executedPlan().toString()
    assert "by" in opened.split("PartitionFilters: [")[1].split("]")[0]
    assert "by_value" in opened.split("PushedFilters: [")[1].split("]")[0]


def test_a_batch_that_changes_nothing_moves_nothing(kept):
    _, final = kept
    assert kept_counts.deltas(final, final).count() == 0


def test_nothing_kept_yet_and_filters_without_counts(spark, tmp_path):
    path = str(tmp_path / "none")
    assert kept_counts.facets(spark, path, SearchQuery()).count() == 0
    assert tuple(kept_counts.totals(spark, path).first()) == (0, 0, 0)
    for query in (SearchQuery(state="a", bank="b"), SearchQuery(text="flat"), SearchQuery(status="live"), SearchQuery(min_price=1)):
        with pytest.raises(ValueError):
            kept_counts.facets(spark, path, query)
