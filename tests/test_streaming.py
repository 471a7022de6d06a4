"""Streams give the results of the batch folds, in one micro-batch or many, and again after a repeat."""

from pyspark.sql import functions as F

from lotwise.operators import crawl, upsert, url_state
from lotwise.plans.relations import ATTEMPTS, FETCH_LOG, relation
from lotwise.plans.state_queries import FETCH_LOG_OF_SOURCES, parsed_listings
from lotwise.schemas import LISTING
from lotwise.streaming import listing_stream, url_stream

SF = "/root/testdata/sf0.001"


def drop_files(rows, folder, by, parts):
    """Rows written as ``parts`` files in order of ``by``, for a stream that takes one file at a time."""
    edges = rows.approxQuantile(by, [i / parts for i in range(parts + 1)], 0.0)
    for i in range(parts):
        low, high = edges[i], edges[i + 1]
        part = rows.filter((F.col(by) >= low) & ((F.col(by) < high) | F.lit(i == parts - 1)))
        part.coalesce(1).write.mode("append").parquet(folder)


def run_once(stream, folder, mode="append", sink="parquet", name=None):
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}-checkpoint")
    writer = writer.trigger(availableNow=True)
    writer = writer.format(sink).queryName(name) if name else writer.format(sink).option("path", folder)
    query = writer.start()
    query.awaitTermination(300)
    assert query.exception() is None


def fetch_stream(spark, tmp_path, parts):
    log = relation(spark, SF, FETCH_LOG).cache()
    source = str(tmp_path / f"log{parts}")
    drop_files(log, source, "seq", parts)
    return log, spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)


def state_rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


def test_url_state_stream_equals_batch(spark, tmp_path):
    for parts in (1, 4):
        log, stream = fetch_stream(spark, tmp_path, parts)
        name = f"url_rows_{parts}"
        run_once(url_stream.url_state_stream(stream), str(tmp_path / name), "update", "memory", name)
        kept = url_stream.as_url_state(url_stream.latest(spark.table(name)))
        assert state_rows(kept) == state_rows(url_state.fold_url_state(log))


def test_url_state_stream_keeps_source_and_date_header(spark, tmp_path):
    log = relation(spark, SF, FETCH_LOG_OF_SOURCES).cache()
    source = str(tmp_path / "log")
    drop_files(log, source, "seq", 3)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_once(url_stream.url_state_stream(stream), str(tmp_path / "rows"), "update", "memory", "url_rows_of_sources")
    kept = url_stream.as_url_state(url_stream.latest(spark.table("url_rows_of_sources")), url_stream.HEADERS)
    wanted = url_state.fold_url_state(log)
    assert kept.filter("source_id IS NOT NULL AND last_modified IS NOT NULL").count() > 0
    assert state_rows(kept) == state_rows(wanted)


def test_listing_stream_equals_batch_and_repeats_safely(spark, tmp_path):
    parsed = parsed_listings(spark, SF).withColumns(
        {"quality_flags": F.lit(None).cast("array<string>"), "raw_payload": F.lit(None).cast("string")}
    )
    saved = str(tmp_path / "parsed")
    parsed.write.parquet(saved)
    parsed = spark.read.parquet(saved)
    empty = spark.createDataFrame([], LISTING)
    actions = upsert.merge_listings(empty, parsed)
    whole = upsert.snapshot(actions).drop("last_verified_at")
    root = str(tmp_path / "kept")
    write = listing_stream.upsert_batch(root, "first", buckets=4)
    for number in range(2):
        write(parsed.filter(F.col("seq") == number + 1), number)
    write(parsed.filter(F.col("seq") == 2), 1)  # the last batch is run again
    write(parsed.filter(F.lit(False)), 2)
    # A new query over the store begins at batch 0 and goes on from what is stored.
    listing_stream.upsert_batch(root, "second", buckets=4)(parsed.filter(F.col("seq") == 3), 0)
    kept = listing_stream.read_listings(spark, root).drop("last_verified_at")
    assert kept.count() == whole.count() > 0
    assert kept.exceptAll(whole.select(kept.columns)).count() == 0
    history = listing_stream.read_history(spark, root).select("source_id", "external_id", "seq", "field_name", "old_value", "new_value")
    expected = upsert.revisions(actions).select(history.columns)
    assert history.exceptAll(expected).count() == 0 and history.count() == expected.count() > 0


def test_a_batch_rewrites_its_own_buckets_only(spark, tmp_path):
    parsed = parsed_listings(spark, SF).withColumns(
        {"quality_flags": F.lit(None).cast("array<string>"), "raw_payload": F.lit(None).cast("string")}
    )
    parsed = parsed.filter(F.col("seq") == 1)
    root = str(tmp_path / "store")
    assert listing_stream.read_listings(spark, root).count() == 0
    write = listing_stream.upsert_batch(root, buckets=8)
    write(parsed, 0)
    before = listing_stream.read_pointers(spark, root)
    one = parsed.filter(F.col("external_id") == parsed.agg(F.min("external_id")).scalar())
    write(one, 1)
    after = listing_stream.read_pointers(spark, root)
    assert set(before.buckets.values()) == {1} and sorted(after.buckets.values())[-2:] == [1, 2]
    assert listing_stream.read_listings(spark, root).count() == parsed.select("source_id", "external_id").distinct().count()


def test_report_stream_equals_batch(spark, tmp_path):
    attempts = relation(spark, SF, ATTEMPTS).cache()
    source = str(tmp_path / "attempts")
    drop_files(attempts, source, "position", 3)
    stream = spark.readStream.schema(attempts.schema).option("maxFilesPerTrigger", 1).parquet(source)
    run_once(listing_stream.report_stream(stream), str(tmp_path / "report"), "complete", "memory", "reports")
    assert state_rows(spark.table("reports")) == state_rows(crawl.crawl_report(attempts))
