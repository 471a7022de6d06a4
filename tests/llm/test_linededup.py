import random

import numpy as np
from pyspark.sql import functions as F

from lotwise.llm import linededup
from test_copies import groups
from texts import descriptions, listings, none, prose


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randint(0, 14))) for _ in range(2))
        most = rng.randint(0, 14)
        assert linededup.edit_distance(a, b, most) == min(distance(a, b), most + 1)


def test_close_hashes_meet_in_a_bucket():
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 2**64, 500, dtype=np.uint64)
    other = marks.copy()
    for _ in range(linededup.DISTANCE):
        other ^= np.uint64(1) << rng.integers(0, 64, 500, dtype=np.uint64)
    assert (linededup.bucket_keys(marks) == linededup.bucket_keys(other)).any(axis=0).all()


def brute(texts):
    places, first = [], {}
    for n, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            if body := linededup.normalised(line):
                places.append((n, k, body))
                first.setdefault(body, (n, k))
    bodies = list(first)
    marks = linededup.simhashes([b.split() for b in bodies])
    links = []
    for a in range(len(bodies)):
        for b in range(a):
            x, y = bodies[a].decode(), bodies[b].decode()
            near = int(np.bitwise_count(marks[a] ^ marks[b])) <= linededup.DISTANCE
            if near and abs(len(x) - len(y)) * 5 <= max(len(x), len(y)) and distance(x, y) * 5 <= max(len(x), len(y)):
                links.append((a, b))
    found = groups(range(len(bodies)), links)
    kept = {}
    for k, body in enumerate(bodies):
        kept[found[k]] = min(kept.get(found[k], first[body]), first[body])
    number = {b: k for k, b in enumerate(bodies)}
    gone = {(n, k) for n, k, b in places if kept[found[number[b]]] != (n, k)}
    texts = [
        "\n".join(x for k, x in enumerate((t or "").split("\n")) if (n, k) not in gone) for n, t in enumerate(texts)
    ]
    return texts, len(links), len(gone)


def corpus():
    rng = random.Random(8)
    lines = [prose(rng, n) for n in (2, 5, 9, 30, 60, 60, 80)]
    texts = [t for t in descriptions(3) if len(t or "") < 5000]
    for _ in range(25):
        own = []
        for _ in range(rng.randint(1, 5)):
            line = rng.choice(lines)
            if rng.random() < 0.5:
                words = line.split()
                words[rng.randrange(len(words))] += rng.choice(["x", "y", "7", "é"])
                line = " ".join(words)
            own.append(rng.choice([line, line.upper(), "", "  ", prose(rng, 12)]))
        texts.append("\n".join(own))
    return texts


def test_lines_equal_brute_force(spark):
    texts = corpus()
    wanted, links, gone = brute(texts)
    given = listings(spark, texts)
    rows = {r.id: r for r in linededup.remove_near_lines(given).collect()}
    assert links > 5 and gone > 20
    assert [rows[n].description for n in range(len(texts))] == wanted
    assert sum(r.removed_lines for r in rows.values()) == gone
    assert rows[3].block == "b" and rows[3].start == 6 and rows[3].key == 1.5


def test_layout_may_change_between_jobs(spark, tmp_path):
    texts = corpus()
    wanted, _, _ = brute(texts)
    listings(spark, texts, partitions=8).select("id", "description").write.parquet(str(tmp_path / "listings"))
    cleaned = linededup.remove_near_lines(spark.read.parquet(str(tmp_path / "listings")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "64m"):  # other splits than those the first jobs saw
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = {r.id: r.description for r in cleaned.collect()}
            assert [rows[n] for n in range(len(texts))] == wanted
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_rows_keep_one_occurrence(spark):
    frame = spark.createDataFrame([(1, "same line here"), (1, "same line here"), (None, "Same  line here")], "id long, description string")
    found = linededup.remove_near_lines(frame.withColumn("removed_lines", F.lit("old"))).collect()
    assert sorted((r.description, r.removed_lines) for r in found) == [("", 1), ("", 1), ("Same  line here", 0)]
    assert linededup.remove_near_lines(none(spark)).count() == 0


def test_lines_of_other_numbers_stay(spark):
    texts = ["41\n2019: 1,234\ntotal 17", "57\n2021: 9,876\ntotal 88", "41\nlot 5"]
    rows = {r.id: r.description for r in linededup.remove_near_lines(listings(spark, texts)).collect()}
    assert [rows[n] for n in range(3)] == ["41\n2019: 1,234\ntotal 17", "57\n2021: 9,876\ntotal 88", "lot 5"]
