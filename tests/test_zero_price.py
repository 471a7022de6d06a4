"""A stated amount of 0 is a missing price, as ``reservePrice or price or sortPrice`` reads it."""

from pyspark.sql import functions as F

from lotwise.sources.fields import either, read_fields, rupees


def test_zero_counts_as_no_price(spark):
    texts = ['{"reservePrice":0,"price":0}', '{"reservePrice":0,"price":8000}', '{"reservePrice":0,"price":0,"sortPrice":0}']
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, j string").withColumn("v", F.parse_json("j"))
    amounts = {"reserve": "reservePrice", "price": "price", "sort_price": "sortPrice"}
    read = read_fields(rows, "v", {}, amounts).withColumn("paid", rupees(either(*[F.col(name) for name in amounts])))
    assert [r.paid if r.paid is None else int(r.paid) for r in read.orderBy("n").collect()] == [None, 8000, 0]
