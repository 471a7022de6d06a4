"""Merging a batch in which no listing is busy: one narrow shuffle, the same answers."""

from pyspark.sql import functions as F

from lotwise.operators.ordered import known_hot_keys, with_previous
from lotwise.plans import state_queries


def rows(spark):
    return spark.range(200).select((F.col("id") % 7).alias("k"), F.col("id").alias("n"), (F.col("id") * 3).alias("v"))


def looked_back(frame, hot):
    back = with_previous(frame, ("k",), ("n",), F.floor(F.col("n") / 10), F.col("v"), hot=hot)
    return sorted((r.k, r.n, -1 if r.previous is None else r.previous) for r in back.collect())


def test_no_hot_keys_is_told_and_gives_the_same(spark):
    frame = rows(spark)
    assert known_hot_keys(frame, ("k",)) == ()
    some = known_hot_keys(frame, ("k",), floor=28)
    assert sorted(r.k for r in some.collect()) == [0, 1, 2, 3]
    assert looked_back(frame, ()) == looked_back(frame, some) == looked_back(frame, None)


def test_upsert_shuffles_only_what_it_shows(spark):
    plan = state_queries.upserted(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if " Exchange hashpartitioning" in line]
    assert len(shuffled) == 1 and "outstanding_dues" not in shuffled[0]
    assert "max_by(struct(status" in plan and "struct(source_id" not in plan
