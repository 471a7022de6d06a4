import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from texts import descriptions, listings, none, prose

from lotwise.llm import balltree
from lotwise.llm.balltree import BallTree, rank_listings, terms_of

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def plain_terms(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lowered)


def plain_ranks(rows, searches, k):
    """(search_id, rank, id, score) by scoring every listing for every search."""
    held = [(id_, Counter(plain_terms(text))) for id_, text in rows if id_ is not None and plain_terms(text)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    terms = {}
    for search, text in searches:
        if search is not None:
            terms.setdefault(search, []).extend(plain_terms(text))
    out = []
    for search, own in terms.items():
        scored = []
        for id_, counts in held:
            m = 100 - 75 + (75 * sum(counts.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * counts[t] // (1000 * counts[t] + 8 * m))
                for t in own if t in counts
            )
            if score > 0:
                scored.append((-score, id_))
        out += [(search, place, id_, -order) for place, (order, id_) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def searches_of(spark, rows):
    return spark.createDataFrame(rows, "search_id long, text string").withColumns({"term": F.lit(1), "id": F.lit("x")}).repartition(2)


def test_terms():
    for text in ["Flat No.12-B, ₹5 लाख", "é_É  x", "", None, "a\x00b\x7fc", "ÀB"]:
        assert [w.decode() for w in terms_of(text) if w] == plain_terms(text)


@pytest.mark.parametrize("small", [False, True])
def test_ranks_equal_scoring_everything(spark, monkeypatch, small):
    if small:  # many blocks on both sides
        monkeypatch.setattr(balltree, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(balltree, "SEARCH_BYTES", 200)
    rng = random.Random(5)
    texts = descriptions() + [prose(rng, rng.choice([2, 8, 30])) for _ in range(150)]
    texts += [texts[9]] * 60  # a group of copies: many equal scores
    asked = [(n, prose(rng, rng.choice([1, 3, 12]))) for n in range(25)]
    asked += [(30, texts[9]), (31, None), (32, ""), (33, "zzz unknown"), (34, "bank bank BANK"), (34, "flat"), (None, "bank"), (-5, "घर sale")]
    found = rank_listings(listings(spark, texts), searches_of(spark, asked), k=7)
    assert found.columns == ["search_id", "rank", "id", "score"]
    assert sorted(map(tuple, found.collect())) == plain_ranks(list(enumerate(texts)), asked, 7)


def test_repeated_rows_null_ids_and_empty_tables(spark):
    rows = [(1, "flat bank"), (1, "flat bank"), (None, "flat flat"), (2, "flat"), (3, None)]
    given = spark.createDataFrame(rows, "id long, description string")
    asked = [(1, "flat bank")]
    assert sorted(map(tuple, rank_listings(given, searches_of(spark, asked), 10).collect())) == plain_ranks(rows, asked, 10)
    assert rank_listings(none(spark), searches_of(spark, asked), 10).collect() == []
    assert rank_listings(given, searches_of(spark, []), 10).collect() == []


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(3)
    columns = [np.unique(rng.integers(0, 200, 6)) for _ in range(20)]
    rows = [columns[k % 20] for k in range(400)]
    starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    codes = np.concatenate(rows)
    values = 1_000_000_000 + rng.integers(1, 50_000_000, len(codes))
    tree = BallTree(200, starts, codes, values)
    dense = np.zeros((400, 200))
    for k in range(400):
        dense[k, codes[starts[k] : starts[k + 1]]] = values[starts[k] : starts[k + 1]]
    assert sorted(tree.rows.tolist()) == list(range(400))
    for node, centre in enumerate(tree.centroids):
        inside = dense[tree.rows[tree.first[node] : tree.stop[node]]]
        assert (np.linalg.norm(inside - centre, axis=1) <= tree.radii[node]).all()
    best = []
    scored = tree.search(columns[3], np.ones(len(columns[3]), np.int64), np.arange(400), best, 3)
    wanted = sorted(zip(dense[:, columns[3]].sum(axis=1).astype(int).tolist(), range(400)), key=lambda x: (-x[0], x[1]))[:3]
    assert sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])) == wanted
    assert scored < 200  # groups of other columns are never opened
