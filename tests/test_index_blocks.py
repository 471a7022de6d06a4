"""The stored index in blocks of listings: few rows, each block made, compared and merged by itself."""

from pyspark.sql import functions as F
from test_search_index import found, frame, plain_search, some_listings

from lotwise.operators import search_index
from lotwise.operators.search_index import GRAM, WORD


def test_a_common_term_has_one_row_in_a_block(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_LISTINGS", 100)
    rows = some_listings(5, range(400))
    search_index.write_index(frame(spark, rows), str(tmp_path), 4)
    stored = search_index.read_index(spark, str(tmp_path))
    held = {r.term: r.n for r in stored.filter(F.col("kind") == WORD).groupBy("term").agg(F.count("term").alias("n")).collect()}
    assert max(held.values()) == 4 and held["flat"] == 4
    assert stored.count() * 3 < search_index.postings(frame(spark, rows)).count()


def test_changes_meet_in_their_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_LISTINGS", 7)
    first, altered = some_listings(6, range(50)), some_listings(7, range(10, 30))
    search_index.write_index(frame(spark, first), str(tmp_path), 8)
    search_index.add_changes(frame(spark, first[10:30]), frame(spark, altered), str(tmp_path), 1, 8)
    search_index.add_changes(frame(spark, altered), frame(spark, altered), str(tmp_path), 2, 8)
    stored = search_index.read_index(spark, str(tmp_path))
    assert stored.filter("segment = 2").count() == 0
    now = frame(spark, first[:10] + altered + first[30:])
    for text in ("flat", '"flat shop"', "lat sh", "12 or bank"):
        assert found(now, stored, text) == plain_search(now, text)


def test_grams_are_cut_by_letters(spark):
    title = "a\U0001f600\U0001f601É12"
    rows = frame(spark, [(1, title, None, None, None, None, None, None, True), (2, "ab", None, None, None, None, None, None, True)])
    grams = search_index.postings(rows).filter(F.col("kind") == GRAM).collect()
    lowered = title.lower()
    assert sorted((r.id, r.term) for r in grams) == sorted((1, lowered[k : k + 3]) for k in range(4))


def test_an_index_begun_empty_takes_changes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search_index, "BLOCK_LISTINGS", 5)
    rows = some_listings(8, range(20))
    search_index.write_index(frame(spark, []), str(tmp_path), 8)
    search_index.add_changes(frame(spark, []), frame(spark, rows), str(tmp_path), 1, 8)
    stored, now = search_index.read_index(spark, str(tmp_path)), frame(spark, rows)
    assert {r.blocks for r in stored.select("blocks").distinct().collect()} == {4}
    assert found(now, stored, "flat") == plain_search(now, "flat")
