"""State folds: sequences, hot keys cut into segments, idempotency."""

import itertools
import json
import random
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import functions as F

from lotwise.operators import documents, ordered, search, status, upsert, url_state
from lotwise.operators.search import SearchQuery
from lotwise.plans.relations import clock, listings
from lotwise.sources import archive, payload
from lotwise.streaming.url_stream import fold_batch

SF = "/root/testdata/sf0.001"
DAY = datetime(2024, 1, 1)
LOG = "url string, seq long, fetched_at timestamp, outcome string, content_hash string, etag string, document string"


def log_rows(url, steps):
    rows = []
    for n, step in enumerate(steps):
        outcome = {"304": "not_modified", "x": "failed"}.get(step, "ok")
        body = step if outcome == "ok" else None
        rows.append((url, n, DAY + timedelta(hours=7 * n), outcome, body, f"e{n}" if body else None, f"d-{body}" if body else None))
    return rows


def fold_by_hand(rows):
    known = None
    for url, seq, at, outcome, body, etag, document in rows:
        if outcome == "failed":
            continue
        event = pd.DataFrame([{"fetched_us": int(at.timestamp() * 1e6), "seq": seq, "outcome": outcome, "content_hash": body, "etag": etag, "document": document}])
        known = fold_batch(known, event)
    return known


def test_url_sequences(spark):
    cases = {
        "same": ["a", "a"], "two": ["a", "b"], "304s": ["a", "304", "304"], "unknown": ["304", "304"],
        "back": ["a", "b", "a"], "failed": ["x", "a", "x"], "late": ["304", "a", "304", "b", "b", "304"],
    }
    pick = random.Random(5)
    for n in range(25):
        cases[f"r{n}"] = [pick.choice(["a", "b", "304", "x", "a"]) for _ in range(pick.randint(1, 25))]
    rows = {url: log_rows(url, steps) for url, steps in cases.items()}
    log = spark.createDataFrame(list(itertools.chain(*rows.values())), LOG)
    state = {r.url: r for r in url_state.fold_url_state(log).collect()}
    for url, events in rows.items():
        wanted = fold_by_hand(events)
        if wanted is None:
            assert url not in state
            continue
        got = state[url]
        names = ("content_hash", "etag", "document", "fetch_count", "unchanged_streak", "versions")
        assert [got[n] for n in names] == [wanted[n] for n in names], url
        assert got.last_changed_at.timestamp() * 1e6 == wanted["last_changed"]
    assert state["304s"].unchanged_streak == 2 and state["304s"].fetch_count == 3
    kept = {(r.url, r.document): r.times_published for r in url_state.fold_documents(log).collect()}
    assert kept["back", "d-a"] == 2 and kept["back", "d-b"] == 1


def test_previous_row_is_the_same_for_hot_keys(spark):
    rows = spark.range(4000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 200).alias("k"), F.col("id").alias("n"), F.md5(F.col("id").cast("string")).alias("v")
    )
    plain = ordered.with_previous(rows, ["k"], ["n"], F.col("n"), F.col("v"))
    hot = ordered.hot_keys(rows, ["k"], floor=100)
    assert [r.k for r in hot.collect()] == [0]
    cut = ordered.with_previous(rows, ["k"], ["n"], F.expr("n div 500"), F.col("v"), hot=hot)
    assert cut.exceptAll(plain).count() == 0 and cut.count() == 4000


def test_upkeep_is_idempotent(spark):
    rows = listings(spark, SF)
    once = status.advance_statuses(rows, clock()).select(*rows.columns)
    assert status.advance_counts(once, clock()).first()[0:2] == (0, 0)
    kept = status.expire_old(once, clock()).drop("expired")
    again = status.expire_old(kept, clock())
    assert again.filter("expired").count() == 0 and kept.count() == rows.count()


def test_archive_append_twice_adds_nothing(spark, tmp_path):
    docs = spark.createDataFrame(
        [("s", f"u{n % 3}", bytearray(b"page %d" % (n % 2)), "text/html", 200, DAY + timedelta(days=n % 2), None, None) for n in range(6)],
        "source_id string, url string, content binary, mime_type string, http_status int, fetched_at timestamp, etag string, last_modified string",
    )
    path = str(tmp_path / "archive")
    archive.append_archive(spark, path, docs, first_write=True)
    first = archive.read_archive(spark, path).count()
    archive.append_archive(spark, path, docs)
    stored = archive.read_archive(spark, path)
    assert stored.count() == first == 2
    assert documents.scan_archive(stored, "s", 1).first().storage_key.startswith("s/2024/01/02/")


def test_facets_ignore_their_own_filter(spark):
    rows = listings(spark, SF)
    chosen = SearchQuery(state="NATION_7")
    found = search.facets(rows, chosen, clock())
    states = found.filter("facet = 'state'").count()
    assert states == min(15, rows.filter("is_published").select("state").distinct().count()) > 1
    assert {r.value.split("-")[0] for r in found.filter("facet = 'city'").collect()} == {"NATION_7"}


def test_fingerprint_ignores_confidence(spark):
    rows = listings(spark, SF)
    a = upsert.with_fingerprint(rows).select("id", "content_hash")
    b = upsert.with_fingerprint(rows.withColumn("confidence", F.lit(0).cast("decimal(3,2)"))).select("id", "content_hash")
    assert a.exceptAll(b).count() == 0


def test_objects_in_a_payload():
    page = '{"k":1} x {"a":{"k":2,"b":"}{"},"s":"\\"}"} {"k":[1,{"k":3}],"c":0} {"k":'
    assert [text for text, _ in payload.objects_by_key(page, ["k"])["k"]] == ['{"k":1}', '{"k":2,"b":"}{"}', '{"k":[1,{"k":3}],"c":0}', '{"k":3}']


def test_large_and_unclosed_objects_are_read_in_one_pass():
    large = json.dumps({"k": 1, "text": "{\\" + "x" * 300_000, "n": 2})
    page = 'say "' + large + '{"other":{"k":5}}' + '{"k":' * 20_000
    found = payload.objects_by_key(page, ["k", "other", "absent"])
    assert [r for _, r in found["k"]] == [json.loads(large), {"k": 5}] and found["absent"] == []
    assert found["other"] == [('{"other":{"k":5}}', {"other": {"k": 5}})]
