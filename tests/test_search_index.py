"""The stored text index against the row-by-row search it replaces."""

import random

import pytest
from pyspark.sql import functions as F

from lotwise.operators import search, search_index, textsearch
from lotwise.operators.search import Page, SearchQuery
from lotwise.operators.search_index import GRAM, WORD

WORDS = "flat shop Flat plot unit 12 phase-2 élan bank Road a b".split()
COLUMNS = "id long, title string, city string, locality string, state string, bank_name string, address string, auction_start_at timestamp, is_published boolean"
SEARCHES = [
    "flat", '"flat shop"', '"unit 12" or bank -road', "flat -shop", '"a a"', '"a b a"', "lat sh", "100%", "f_at", "élan", "-flat",
    "zzz", "flat or -shop", '"bank road"', "", "a\\b", "a\\", "100\\%", "phase 2", "12",
]


def some_listings(seed, ids):
    rng = random.Random(seed)

    def text(most):
        return rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, most)))])

    return [(n, text(6), text(2), text(2), text(2), text(3), text(8), None, n % 3 > 0) for n in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def plain_search(listings, text):
    kept = listings.filter(search.text_predicate(text)) if text else listings.limit(0)
    return sorted((r.id, r.rank) for r in kept.select("id", textsearch.rank(text).alias("rank")).collect())


def found(listings, stored, text):
    rows = search_index.indexed_text(listings, stored, text, 8) if text else listings.limit(0).withColumn(search.RANK, F.lit(0.0))
    return sorted((r.id, r[search.RANK]) for r in rows.collect())


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """An index written, changed three times; the listings as they are then."""
    path = str(tmp_path_factory.mktemp("index"))
    first, altered, more = some_listings(1, range(60)), some_listings(2, range(20, 40)), some_listings(3, range(60, 90))
    search_index.write_index(frame(spark, first), path, 8)
    search_index.add_changes(frame(spark, first[20:40]), frame(spark, altered), path, 1, 8)
    search_index.add_changes(frame(spark, []), frame(spark, more), path, 2, 8)
    search_index.add_changes(frame(spark, first[:5]), frame(spark, []), path, 3, 8)
    search_index.add_changes(frame(spark, first[:5]), frame(spark, []), path, 3, 8)  # a retried job
    now = frame(spark, first[5:20] + altered + first[40:] + more)
    return now, path


def test_merged_index_equals_a_rebuild(spark, built, tmp_path):
    now, path = built
    stored = search_index.read_index(spark, path)

    def rows(postings):
        return sorted((r.kind, r.term, r.id, tuple(map(tuple, r.spots))) for r in postings.collect())

    assert rows(search_index.compacted(stored)) == rows(search_index.postings(now))
    search_index.write_compacted(stored, str(tmp_path / "one"), 8)
    again = search_index.read_index(spark, str(tmp_path / "one"))
    assert again.select("segment").distinct().count() == 1
    assert rows(search_index.compacted(again)) == rows(search_index.postings(now))


@pytest.mark.parametrize("text", SEARCHES)
def test_same_listings_and_rank_as_row_by_row(spark, built, text):
    now, path = built
    assert found(now, search_index.read_index(spark, path), text) == plain_search(now, text)


def test_page_equals_the_plain_page(spark, built):
    now, path = built
    full = now
    for name in ("reserve_price", "first_seen_at", "status", "auction_end_at"):
        full = full.withColumn(name, F.lit(None).cast("string"))
    clock = F.lit("2026-01-01").cast("timestamp")
    asked = SearchQuery(text="flat or bank", sort="relevance", page=Page(2, 5))
    plain = [r.id for r in search.search_page(full, asked, clock).collect()]
    assert plain == [r.id for r in search_index.indexed_page(full, search_index.read_index(spark, path), asked, clock, 8).collect()]


def test_only_the_asked_terms_are_read(spark, built):
    _, path = built
    stored = search_index.read_index(spark, path)
    plan = search_index.of_terms(stored, WORD, ["flat"], 8)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(term,flat)" in plan
    home = stored.select(search_index.bucket_of(F.lit("flat"), 8)).first()[0]
    files = {r[0] for r in stored.filter(F.col("bucket") == home).select(F.input_file_name()).distinct().collect()}
    every = {r[0] for r in stored.select(F.input_file_name()).distinct().collect()}
    assert 0 < len(files) * 3 < len(every)
    assert all(f"bucket={home}/" in f for f in files)


def test_what_the_index_cannot_answer(spark, built):
    assert [search_index.answers(t) for t in ("flat", "-flat", "a or -b", "", "...")] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        search_index.add_changes(built[0], built[0], built[1], 0)
    assert search_index.postings(frame(spark, [])).collect() == []
    kinds = {r.kind for r in search_index.postings(built[0]).select("kind").distinct().collect()}
    assert kinds == {WORD, GRAM}
