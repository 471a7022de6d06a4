import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.operators import linkage
from lotwise.operators.pair_blocks import rounded
from lotwise.plans import linkage_queries
from test_linkage import D, frame, listing, plan, random_rows

SF = "/root/testdata/sf0.001"
WORDS = [f"word{n}" for n in range(90)]


def crowd(count: int) -> list[dict]:
    """Rows of one busy key with more shared words than one number has bits."""
    return [
        listing(
            5000 + n, address=" ".join(WORDS[n % 7 :: 1 + n % 11]), locality=("East", "East Park", None)[n % 3],
            area_sqft=D(850 + n % 5), reserve_price=D(5_000_000 + n % 4),
        )
        for n in range(count)
    ]


@pytest.fixture(scope="module")
def folded(spark):
    rows = random_rows(90, seed=11) + crowd(120)
    rows += [dict(r, id=r["id"] + 20_000) for r in rows[:40]]
    data = frame(spark, rows)
    return data, linkage.profiles(data).cache()


@pytest.mark.parametrize("cell_rows", [25, 4000])
def test_blocks_give_the_pairs_of_the_join(spark, folded, cell_rows):
    data, rows = folded
    columns = linkage.matched_pairs(rows, cell_rows).columns
    known = linkage.scored_pairs(rows, cell_rows).select(*columns)
    found = linkage.matched_pairs(linkage.folds(data), cell_rows)
    assert found.count() > 500 and found.exceptAll(known).isEmpty() and known.exceptAll(found).isEmpty()

    low, high = F.least("earlier_id", "later_id"), F.greatest("earlier_id", "later_id")
    every = linkage.scored_pairs(rows, cell_rows, keep_distinct=True)
    known = every.select(low.alias("low_id"), high.alias("high_id"), F.round("score", 6).alias("score"), "pairs")
    found = linkage.pair_scores(rows, cell_rows)
    assert found.exceptAll(known).isEmpty() and known.exceptAll(found).isEmpty()
    ids, known = linkage.pair_ids(rows, cell_rows), known.drop("score")
    assert ids.exceptAll(known).isEmpty() and known.exceptAll(ids).isEmpty()
    order, known = linkage.pair_order(rows, cell_rows), linkage.time_order(linkage.candidate_pairs(rows, cell_rows))
    assert order.exceptAll(known).isEmpty() and known.exceptAll(order).isEmpty()

    best = linkage.best_match_in_blocks(data, rows, cell_rows)
    known = linkage.best_match(data, rows, linkage.scored_pairs(rows, cell_rows))
    assert best.exceptAll(known).isEmpty() and known.exceptAll(best).isEmpty()


def test_scores_are_rounded_as_by_spark(spark):
    values = np.array([k / 1e6 + 5e-7 for k in range(0, 1_000_000, 997)] + [0.65, 1.0, 0.1234565, 2 / 3, 0.0])
    values = np.concatenate([values, np.nextafter(values, 2), np.nextafter(values, -1)])
    rows = spark.createDataFrame([(n, float(x)) for n, x in enumerate(values)], "n int, x double")
    wanted = [r.y for r in rows.select("n", F.round("x", 6).alias("y")).orderBy("n").collect()]
    assert rounded(values).tolist() == wanted


def test_copies_come_from_one_pass(spark):
    rows = linkage_queries.twins(spark, SF)
    assert plan(rows).split("Initial Plan")[0].count("orders.parquet") == 1
    wanted = linkage_queries.relation(spark, SF, linkage_queries.TWINS)
    assert rows.exceptAll(wanted).isEmpty() and wanted.exceptAll(rows).isEmpty()
    members = linkage.profile_members(rows, linkage.folds(rows))
    assert members.count() == rows.count()


def test_no_pair_is_joined_where_a_count_is_asked(spark):
    for query in ("scan", "linkage_tally", "classify", "similarity", "candidate_pairs"):
        text = plan(getattr(linkage_queries, query)(spark, SF))
        assert "MapInArrow" in text and "SortMergeJoin" not in text
