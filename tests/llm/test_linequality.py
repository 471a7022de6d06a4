import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from lotwise.llm import linequality
from texts import descriptions, listings, none, prose


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    counts = np.array([3, 1, 5, 2, 5])
    lift, steps = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    good, pairs, total = linequality.marginals(lift, counts, steps, pairs=True)
    at, want_pairs, want_total = 0, np.zeros((2, 2)), 0.0
    for n in counts:
        weights, chance = {}, np.zeros(n)
        for labels in itertools.product((0, 1), repeat=int(n)):
            score = sum(lift[at + k] for k, y in enumerate(labels) if y)
            weights[labels] = np.exp(score + sum(steps[a, b] for a, b in itertools.pairwise(labels)))
        whole = sum(weights.values())
        for labels, weight in weights.items():
            chance += np.array(labels) * weight / whole
            for a, b in itertools.pairwise(labels):
                want_pairs[a, b] += weight / whole
        assert np.allclose(good[at : at + n], chance)
        want_total += np.log(whole)
        at += n
    assert np.allclose(pairs, want_pairs) and np.isclose(total, want_total)


def labelled(seed, count):
    rng = random.Random(seed)
    rows = []
    for n in range(count):
        bad = rng.random() < 0.3
        lines = []
        for _ in range(rng.randint(1, 8)):
            text = prose(rng, rng.randint(4, 30))
            lines.append(" | ".join(text.upper().split()) + "!!" if bad and rng.random() < 0.9 else text)
        rows.append((n, "\n".join(lines), int(not bad)))
    return rows


def test_held_out_accuracy(spark):
    rows = labelled(1, 400)
    texts = spark.createDataFrame([r[:2] for r in rows], "id long, description string").repartition(3)
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 4], "id long, quality int")
    model = linequality.fit(texts, labels)
    found = {r.id: r.score for r in model.score(texts).collect()}
    right = [(found[n] >= linequality.DIVIDE) == bool(label) for n, _, label in rows if n % 4 == 0]
    assert sum(right) / len(right) > 0.95
    again = {r.id: r.s for r in texts.select("id", model.column("description").alias("s")).collect()}
    assert all(abs(found[n] - again[n]) < 1e-12 for n in found)


def test_rows_of_every_sort(spark):
    rows = labelled(2, 60)
    texts = spark.createDataFrame([r[:2] for r in rows], "id long, description string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(None, 1), (3, None), (4, 1)], "id long, quality int")
    model = linequality.fit(texts, labels, sample=40)
    found = model.score(listings(spark, descriptions())).collect()
    assert len(found) == len(descriptions()) and all(0 <= r.score <= 1 for r in found)
    assert model.score(none(spark)).count() == 0
    unknown = linequality.fit(texts, labels.filter(F.lit(False)))
    assert unknown.of_texts(["a", ""]).tolist() == [0.5, 0.5]
    one = linequality.fit(texts, labels.filter("quality = 1"))
    assert all(0 <= s <= 1 for s in one.of_texts(["a", "B | C"]))


def test_long_texts_give_a_stretch_of_whole_text_features():
    assert linequality.stretch(None, 1) == slice(0, 1)
    assert linequality.stretch("a\nb", 2) == slice(0, 2)
    texts = ["\n".join(f"line {n} of {k}" for k in range(1000)) for n in range(30)]
    found = [linequality.stretch(t, 1000) for t in texts]
    assert all(s.stop - s.start == linequality.FIT_LINES and 0 <= s.start and s.stop <= 1000 for s in found)
    assert len({s.start for s in found}) > 20 and max(s.stop for s in found) > 900
