import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from texts import descriptions, listings, none
from tokenizers import Tokenizer

from lotwise.llm import bestfit, queries
from lotwise.llm.bestfit import best_fit_decreasing, cut_listings, least_sequences, pack_best_fit, sequences_needed
from lotwise.llm.bytebpe import encode_descriptions

BYTES = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    " a  b", "a b ", "x<|endoftext|> y", "a᠎ b", "a ​ b", "don't 's ' s we\x27re", "\x1c b\x1c", "x\n\nb", "x \nb",
    "дabc abcд abc", "b’s l’été d'un", "a\t\tb\n c", "(a)b_c__d 1a2", "a b   c", "ét x́y", "12 3  45\t 6", " ", "\n",
]


def exact_bins(lengths, limit):
    """The least number of sequences, by trying every placing."""
    best = len(lengths)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= lengths[k]}.values():
            rooms[j] -= lengths[k]
            place(k + 1, rooms)
            rooms[j] += lengths[k]
        place(k + 1, [*rooms, limit - lengths[k]])

    place(0, [])
    return best


def plain_best_fit(lengths, limit):
    rooms = []
    for size in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= size]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - size)
        else:
            rooms.append(limit - size)
    return sorted(rooms)


def test_best_fit_equals_one_by_one_and_bounds_hold():
    rng = random.Random(2)
    for limit in (10, 30, 100):
        for _ in range(40):
            lengths = np.array([rng.randint(1, limit) for _ in range(rng.randint(1, 80))])
            sequence, offset = best_fit_decreasing(lengths, limit)
            filled = np.bincount(sequence, weights=lengths).astype(int)
            assert sorted((limit - filled).tolist()) == plain_best_fit(lengths.tolist(), limit)
            for own in range(sequence.max() + 1):
                places = sorted(zip(offset[sequence == own].tolist(), lengths[sequence == own].tolist()))
                assert [p for p, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
    for _ in range(60):
        lengths = [rng.randint(1, 20) for _ in range(8)]
        needed = sequences_needed(*np.unique(lengths, return_counts=True), 20)
        assert -(-sum(lengths) // 20) <= needed <= exact_bins(lengths, 20)
    assert sequences_needed(np.array([11]), np.array([7]), 20) == 7  # the share alone says four
    assert sequences_needed(np.array([7]), np.array([9]), 20) == 5


@pytest.mark.parametrize("pieces_each", [200_000, 60])
def test_whole_packing(spark, monkeypatch, pieces_each):
    monkeypatch.setattr(bestfit, "PARTITION_PIECES", pieces_each)
    rng = random.Random(4)
    rows = [(n if n % 50 else None, rng.choice([1, 3, 17, 40, 64, 60, 33, 33, 22]), "x", 9) for n in range(700)]
    rows += [(1000, 0, "empty", 1), (1001, None, "null", 1)] + [(2000, 31, "same", 2)] * 30
    given = spark.createDataFrame(rows, "id long, length long, offset string, partition int").repartition(5)
    found = pack_best_fit(given, 64).collect()
    assert sorted((r.id or 0, r.length, r.partition) for r in found) == sorted((a or 0, b, d) for a, b, _, d in rows if b)
    held = {}
    for r in found:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in held.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= 64
    least = least_sequences(given.filter("length > 0"), 64)
    assert least <= len(held) <= least + (1 if pieces_each > 700 else 3)
    if pieces_each > 700 and len(held) == least:
        assert all(r.certified for r in found)


def test_cuts_ids_and_empty_table(spark):
    texts = [*descriptions(), *ODD, "word " * 3000]
    tokenizer = Tokenizer.from_file(BYTES)
    encoded = encode_descriptions(listings(spark, texts), BYTES, ended_by=2)
    whole = {r.id: r.token_ids for r in encoded.collect()}
    assert whole == {n: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for n, t in enumerate(texts)}
    by_id = {}
    for r in cut_listings(encoded.withColumn("piece", F.lit("clash")), 64).collect():
        by_id.setdefault(r.id, []).append(r)
    for id_, pieces in by_id.items():
        pieces.sort(key=lambda r: r.piece)
        assert [t for r in pieces for t in r.token_ids] == whole[id_]
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == len(r.token_ids) == 64 for r in pieces[1:]) and 1 <= pieces[0].length <= 64
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)])[:-1].tolist()
    rows = spark.createDataFrame([(1, None), (None, []), (2, [5, None, 7])], "id long, token_ids array<int>")
    assert [tuple(r) for r in cut_listings(rows, 2).collect()] == [(2, 0, 0, 1, [5]), (2, 1, 1, 2, [0, 7])]
    empty = cut_listings(encode_descriptions(none(spark), BYTES), 64)
    assert pack_best_fit(empty, 64).collect() == [] and least_sequences(empty, 64) == 0
    with pytest.raises(Exception, match="longer than the limit"):
        pack_best_fit(spark.createDataFrame([(1, 65)], "id long, length long"), 64).collect()


def test_query(spark, tmp_path):
    texts = [*descriptions(), *ODD]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(BYTES)
    whole = {n: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for n, t in enumerate(texts)}
    rows = queries.QUERIES["op13_certified_best_fit"](spark, str(tmp_path)).collect()
    assert sum(r.length for r in rows) == sum(map(len, whole.values()))
    for r in rows:
        ids = whole[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
    sizes = [len(w) for w in whole.values()]
    assert len({r.sequence_id for r in rows}) <= -(-sum(sizes) // 1024) + 1


def test_parts_are_numbered_all_at_once():
    from lotwise.llm.bytebpe import _Parts

    parts = _Parts()
    parts.meet(["a", "b", "a", "", "c\n"])
    parts.meet(["b", "d"])
    assert {parts["a"], parts["b"]} == {0, 1} and parts["d"] == 2 and parts[""] == parts["c\n"] == -1
    assert sorted(parts.fresh) == [" a", " b", " d"]
