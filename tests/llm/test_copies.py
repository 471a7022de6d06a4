import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import linking, ngramjoin
from lotwise.llm.components import components
from texts import descriptions, listings, none, prose


def groups(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts, percent, width):
    sets = {n: shingles(t, width) for n, t in enumerate(texts)}
    links = [
        (a, b) for a, b in itertools.combinations(sets, 2)
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) > 0
    ]
    found = groups(sets, links)
    return {n: (len(sets[n]), found[n]) for n in sets}


def corpus(seed):
    rng = random.Random(seed)
    texts = list(descriptions(seed))
    for _ in range(12):
        words = prose(rng, rng.choice([4, 5, 6, 9, 20, 50, 120, 400])).split()
        for _ in range(rng.randint(1, 6)):
            changed = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                changed[rng.randrange(len(words))] = str(rng.random())
            texts.append(" ".join(changed[: rng.choice([None, None, -1, -3])]))
    return texts


@pytest.mark.parametrize(("percent", "width", "cell"), [(85, 4, 1024), (80, 5, 1024), (60, 2, 3)])
def test_groups_equal_brute_force(spark, monkeypatch, percent, width, cell):
    monkeypatch.setattr(linking, "CELL_ITEMS", cell)
    monkeypatch.setattr(ngramjoin, "BLOCK_BYTES", 20_000)
    texts = corpus(percent)
    rows = ngramjoin.near_copies(listings(spark, texts), percent, width).collect()
    assert {r.id: (r.size, r.component) for r in rows} == brute(texts, percent, width)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 85, 95):
        for size in [*range(1, 60), 100, 333, 1000, 5000]:
            whole = np.unique(rng.integers(0, 2**64, size + 40, dtype=np.uint64))
            left = np.sort(rng.permutation(whole)[:size])
            lost = int(rng.integers(0, size // 4 + 1))
            other = np.unique(np.concatenate([rng.permutation(left)[lost:], rng.permutation(whole)[: rng.integers(0, lost + 1)]]))
            common = len(np.intersect1d(left, other))
            if 100 * common >= percent * (len(left) + len(other) - common) and not np.array_equal(left, other):
                both = np.intersect1d(ngramjoin.signatures(left, percent), ngramjoin.signatures(other, percent))
                assert len(both), (percent, size)
            marks = ngramjoin.prepare_sketches([ngramjoin.sketch(left), ngramjoin.sketch(other)])
            apart = int(np.bitwise_count(marks[1][0] ^ marks[1][1]).sum())
            assert apart <= len(left) + len(other) - 2 * common


def test_null_and_equal_ids(spark):
    text = "one two three four five six seven eight"
    frame = spark.createDataFrame([(None, text), (4, text), (4, text), (2, text), (9, None)], "id long, description string")
    found = sorted((r.id, r.component) for r in ngramjoin.near_copies(frame).collect())
    assert found == [(2, 2), (4, 2), (4, 2), (9, 9)]
    assert ngramjoin.near_copies(none(spark)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    links = [(n, n + 1) for n in range(100, 140)] + [(500, n) for n in range(501, 560)]
    links += [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(7, 7)]
    frame = spark.createDataFrame(links, "x long, y long").repartition(4)
    found = {r.node: r.component for r in components(frame).collect()}
    ids = {x for pair in links for x in pair}
    wanted = groups(ids, links)
    assert found == {i: wanted[i] for i in found} and {i for i in ids if wanted[i] != i} <= set(found)
    assert components(frame.filter(F.lit(False))).count() == 0
