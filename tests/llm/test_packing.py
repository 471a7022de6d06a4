import random

import pytest

from lotwise.llm.packing import Limits, pack_listings


def packed(spark, rows, limits, partitions=2):
    frame = spark.createDataFrame(rows, "id long, token_ids array<int>, loss_from int, offset string")
    return pack_listings(frame.repartition(partitions), limits).collect()


@pytest.mark.parametrize("limits", [Limits(64, 5, 64), Limits(64, 50, 20), Limits(16, 2, 16), Limits(128, 8, 100, window=3)])
def test_every_token_once_and_every_limit_kept(spark, limits):
    rng = random.Random(3)
    rows = [(n, [rng.randint(0, 9) for _ in range(rng.choice([0, 1, 3, 20, 200]))], rng.choice([None, 0, 2, 500]), "x") for n in range(80)]
    rows += [(200, None, None, None), (None, [1, 2], None, None)]
    pieces = packed(spark, rows, limits)
    by_id, by_sequence = {}, {}
    for p in pieces:
        by_id.setdefault(p.id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    loss = {r[0]: r[2] or 0 for r in rows}
    for id_, ids, _, _ in rows:
        whole = [t for p in sorted(by_id.get(id_, []), key=lambda p: p.start) for t in p.token_ids]
        assert whole == (ids or [])
    for p in pieces:
        assert p.length == len(p.token_ids) > 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
        total = sum(p.length for p in own)
        assert total <= limits.max_tokens and len(own) <= limits.max_segments
        assert total == limits.max_tokens or total & (total - 1) == 0
        assert sum(max(0, p.start + p.length - max(p.start, loss[p.id])) for p in own) <= limits.max_loss_tokens


def test_whole_examples_fit_together_without_cuts(spark):
    rows = [(n, [1] * size, 0, "") for n, size in enumerate([10, 6, 9, 7, 8, 8] * 5)]
    pieces = packed(spark, rows, Limits(16, 8, 16), partitions=1)
    assert len(pieces) == len(rows) and len({p.sequence_id for p in pieces}) == 15


def test_repeated_rows_and_empty_table(spark):
    assert len(packed(spark, [(1, [5, 6], 0, "")] * 3, Limits(4, 4, 4))) >= 3
    assert packed(spark, [], Limits(4, 4, 4)) == []
    with pytest.raises(ValueError):
        Limits(0, 1, 1)
