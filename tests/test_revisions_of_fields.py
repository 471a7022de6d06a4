"""Revisions of some fields alone, and the listing of busy listings they go by."""

from lotwise.plans import state_queries

SF = "/root/testdata/sf0.001"


def test_fewer_tracked_fields_give_the_same_rows_of_these(spark):
    every = state_queries._revisions(spark, SF).filter("field_name = 'reserve_price'")
    one = state_queries._revisions(spark, SF, ("reserve_price",))
    assert one.count() == every.count() > 0
    assert one.exceptAll(every).isEmpty()
