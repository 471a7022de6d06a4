"""Linkage batch by batch against one scan of everything."""

import pytest
from pyspark.sql import functions as F

from lotwise.operators import key_index, linkage
from lotwise.plans.relations import listings

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows(spark):
    return listings(spark, SF).filter("id % 3 = 0").cache()


@pytest.mark.parametrize("cell_rows", [4000, 3])
def test_batches_add_up_to_the_scan(spark, rows, tmp_path, cell_rows):
    path = str(tmp_path / "keys")
    for number, chosen in enumerate(["id % 5 < 3", "id % 5 = 3", "id < 0", "id % 5 = 4"]):
        key_index.add_batch(rows.filter(chosen), path, number, 8, cell_rows)
    key_index.add_batch(rows.filter("id % 5 = 4"), path, 3, 8, cell_rows)  # the last batch is run again
    wanted = linkage.scan(rows).first()
    assert wanted.compared > 0
    assert key_index.read_tally(spark, path).first() == wanted


def test_one_listing_against_the_table(spark, rows, tmp_path):
    path = str(tmp_path / "keys")
    with pytest.raises(ValueError):
        key_index.matches_of(rows, path, 1)
    for number in range(2):
        key_index.add_batch(rows.filter(F.col("id") % 2 == number), path, number, 8)
    busy = linkage.best_match(rows, folded := linkage.profiles(rows), linkage.scored_pairs(folded)).orderBy(F.desc("matches"), "id").first()
    found = key_index.matches_of(rows, path, busy.id, 8).groupBy("relationship").agg(F.sum("members").alias("n"))
    plain = linkage.find_for(rows, busy.id).groupBy("relationship").agg(F.count("other_id").alias("n"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect())) != []


def test_a_small_batch_opens_few_files(spark, rows, tmp_path):
    path = str(tmp_path / "keys")
    key_index.add_batch(rows, path, 0, 64)
    stored = key_index.read_keys(spark, path)
    fresh = key_index.keyed(linkage.profiles(rows.limit(1)))
    some = key_index.touched(fresh, stored, 64)

    def files(frame):
        return frame.select(F.input_file_name()).distinct().count()

    assert 0 < files(some) * 4 < files(stored)
    assert "bucket" in some._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]


def test_a_table_for_matches_alone_compares_nothing(spark, rows, tmp_path):
    for name, add in (("both", key_index.add_batch), ("keys", key_index.add_keys)):
        for number in range(2):
            add(rows.filter(F.col("id") % 2 == number), str(tmp_path / name), number, 8)
    stored = [key_index.read_keys(spark, str(tmp_path / name)) for name in ("both", "keys")]
    assert stored[0].count() == stored[1].count() > 0
    assert stored[0].exceptAll(stored[1]).isEmpty()
    assert not (tmp_path / "keys" / "tallies").exists()


def test_stored_rows_have_marks_and_older_ones_get_them(spark, rows, tmp_path):
    key_index.add_keys(rows, str(tmp_path / "keys"), 0, 8)
    stored = key_index.read_keys(spark, str(tmp_path / "keys"))
    marks = ["address_marks", "address_count", "locality_marks", "locality_count", "city_mark", "area"]
    assert stored.filter("address_marks IS NULL").isEmpty()
    older = stored.withColumns({name: F.lit(None).cast(stored.schema[name].dataType) for name in marks})
    for given in (older, stored.drop(*marks)):
        assert linkage.with_marks(given).select(stored.columns).exceptAll(stored).isEmpty()
