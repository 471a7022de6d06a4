import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import tiles
from lotwise.llm.neighbours import nearest
from lotwise.llm.topk import scaled, top_products


def rows(seed=1, count=150, dims=8):
    rng = random.Random(seed)
    made = [(n, [rng.gauss(0, 1) for _ in range(dims)]) for n in range(count)]
    made += [(count + n, made[n % 3][1]) for n in range(40)]  # many equal vectors
    made += [(900, None), (901, [1.0, None] * 4), (902, [math.nan] * dims), (903, [math.inf] + [0.0] * 7), (904, [0.0] * dims)]
    made += [(905, []), (906, [1.0, 2.0]), (None, [1.0] * dims)]
    return made


def usable(made, zero):
    return {
        i: np.array(v) for i, v in made
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))
    }


def frame(spark, made):
    schema = "vec_id long, embedding array<double>"
    return spark.createDataFrame(made, schema).withColumns({"ids": F.lit("x"), "part": F.lit(1)}).repartition(5)


def best(vectors, query, score, k):
    mine = [(score(vectors[query], v), i) for i, v in vectors.items() if i != query and len(v) == len(vectors[query])]
    return sorted(mine)[:k]


@pytest.fixture(params=[False, True])
def small_cells(request, monkeypatch):
    if request.param:
        for name, size in (("BLOCK_ROWS", 7), ("CELL_QUERIES", 10), ("CELL_CANDIDATES", 20), ("FAN_IN", 2)):
            monkeypatch.setattr(tiles, name, size)


def test_products_equal_brute_force(spark, small_cells):
    made = rows()
    whole = scaled(frame(spark, made))
    found = {}
    for r in top_products(whole.filter("vec_id % 5 = 0"), whole, k=6).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    vectors = {i: np.floor(64 * v).astype(np.int64) for i, v in usable(made, zero=True).items()}
    wanted = {q: best(vectors, q, lambda a, b: -int(a @ b), 6) for q in vectors if q % 5 == 0}
    assert {q: [own[k] for k in sorted(own)] for q, own in found.items()} == {q: w for q, w in wanted.items() if w}


def test_nearest_equal_brute_force(spark, small_cells):
    made = rows(2)
    found = {}
    given = frame(spark, made)
    for r in nearest(given.filter("vec_id % 4 = 0"), given, k=5).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    vectors = usable(made, zero=False)
    wanted = {q: best(vectors, q, lambda a, b: float(np.sqrt(((a - b) ** 2).sum())), 5) for q in vectors if q % 4 == 0}
    assert set(found) == {q for q, w in wanted.items() if w}
    for q, own in found.items():
        assert [own[k][1] for k in sorted(own)] == [i for _, i in wanted[q]]
        assert np.allclose([own[k][0] for k in sorted(own)], [s for s, _ in wanted[q]], rtol=1e-12)


def test_large_whole_numbers_stay_exact(spark):
    made = [(n, [float(2**30 + n), float(n)]) for n in range(12)]
    found = top_products(frame(spark, made), frame(spark, made), k=3).filter("query_id = 3").orderBy("rank").collect()
    product = lambda n: (2**30 + 3) * (2**30 + n) + 3 * n
    assert [(r.vec_id, r.score) for r in found] == [(n, product(n)) for n in (11, 10, 9)]


def test_empty_tables(spark):
    nothing = frame(spark, rows()).filter("vec_id > 10000")
    assert top_products(nothing, nothing, 3).count() == 0
    assert nearest(frame(spark, rows()), nothing, 3).count() == 0
