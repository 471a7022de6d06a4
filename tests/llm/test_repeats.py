import random

import numpy as np
import pyarrow as pa
import pytest

from lotwise.llm import columnbwt, repeats, textblocks
from lotwise.llm.columnbwt import repeated_starts
from texts import descriptions, listings, none


def brute(texts, width):
    seen = {}
    for text in texts:
        for k in range(len(text) - width + 1):
            seen[text[k : k + width]] = seen.get(text[k : k + width], 0) + 1
    out = []
    for text in texts:
        covered = bytearray(len(text))
        for k in range(len(text) - width + 1):
            if seen[text[k : k + width]] > 1:
                covered[k : k + width] = b"\1" * width
        edges = [k for k in range(len(text)) if covered[k] and (k == 0 or not covered[k - 1])]
        ends = [k + 1 for k in range(len(text)) if covered[k] and (k + 1 == len(text) or not covered[k + 1])]
        kept = bytes(x for x, c in zip(text, covered, strict=True) if not c)
        out.append((len(text), list(zip(edges, ends, strict=True)), kept))
    return out


def test_transform_finds_the_repeats_of_a_collection():
    rng = random.Random(6)
    for _ in range(200):
        width, letters = rng.randint(2, 9), rng.choice(["ab", "abcd", "abcdefghijklmnop"])
        base = "".join(rng.choice(letters) for _ in range(40)).encode()
        strings = [base[rng.randint(0, 30) :][: rng.randint(0, 25)] for _ in range(rng.randint(1, 10))]
        strings += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))).encode() for _ in range(3)]
        starts = [s[k : k + width] for s in strings for k in range(len(s) - width + 1)]
        wanted = [[starts.count(s[k : k + width]) > 1 for k in range(len(s) - width + 1)] for s in strings]
        assert [x.tolist() for x in repeated_starts(strings, width)] == wanted


@pytest.mark.parametrize(("width", "hot", "block"), [(2, 20_000, 1000), (7, 20_000, 8 << 20), (7, 1, 300), (50, 20_000, 5000), (21, 2, 100)])
def test_removal_equals_brute_force(spark, monkeypatch, width, hot, block):
    monkeypatch.setattr(repeats, "HOT_RUNS", hot)
    monkeypatch.setattr(textblocks, "BLOCK_BYTES", block)
    rng = random.Random(width)
    base = "".join(rng.choice("abcdé fg") for _ in range(300))
    texts = [t for t in descriptions(4) if len(t or "") < 3000]
    for _ in range(50):
        at = rng.randint(0, 250)
        texts.append(rng.choice("xyz") * rng.randint(0, 9) + base[at : at + rng.randint(0, 120)] + str(rng.random())[:5])
        texts.append("abcab"[: rng.randint(1, 5)] * rng.randint(1, 40))
    rows = {r.id: r for r in repeats.remove_repeats(listings(spark, texts), width).collect()}
    for n, wanted in enumerate(brute([(t or "").encode() for t in texts], width)):
        assert (rows[n].n_bytes, [tuple(s) for s in rows[n].spans], bytes(rows[n].kept)) == wanted


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 64)
    rng = random.Random(1)
    base = "".join(rng.choice("abc") for _ in range(2000))
    texts = [base, "zz" + base[300:900] + "q" + base[500:700]]
    rows = {r.id: r for r in repeats.remove_repeats(listings(spark, texts), 30).collect()}
    for n, wanted in enumerate(brute([t.encode() for t in texts], 30)):
        assert (rows[n].n_bytes, [tuple(s) for s in rows[n].spans], bytes(rows[n].kept)) == wanted


def test_repeated_rows_null_ids_and_empty_table(spark):
    frame = spark.createDataFrame([(None, "abcdef"), (None, "abcdef"), (3, "xyzxy")], "id long, description string")
    found = sorted((r.id or 0, r.n_bytes, bytes(r.kept)) for r in repeats.remove_repeats(frame, 4).collect())
    assert found == [(0, 6, b""), (0, 6, b""), (3, 5, b"xyzxy")]
    assert repeats.remove_repeats(none(spark)).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(frame, 300)


def test_starts_by_any_width_of_a_symbol_and_in_few_rounds(monkeypatch):
    rng = random.Random(8)
    rounds = []
    least = columnbwt._least
    monkeypatch.setattr(columnbwt, "_least", lambda *given: rounds.append(1) or least(*given))
    for width in (5, 6, 16, 24, 40, 90, 200):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, width))) for _ in range(4)]
        strings = list({b"".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(30)})
        begins = [s[k : k + width] for s in strings for k in range(len(s) - width + 1)]
        expected = [[begins.count(s[k : k + width]) > 1 for k in range(len(s) - width + 1)] for s in strings]
        rounds.clear()
        assert [x.tolist() for x in columnbwt.repeated_starts(strings, width)] == expected
    # Two ranges a round, and a round for every 40 bytes of the longest string.
    assert len(rounds) == 2 * (max(map(len, strings)) // 40)


def test_keys_are_dealt_evenly_though_they_are_least_hashes():
    rng = np.random.default_rng(3)
    runs = repeats.find_runs(rng.integers(0, 256, 200_000, dtype=np.uint8), np.array([200_000]), 200)
    places, members = repeats._shared_out(np.unique(runs.key), 20)
    sizes = [len(m) for m in members]
    assert len(places) == 20 and max(sizes) < 1.5 * min(sizes)


def test_buckets_follow_the_bytes_and_transforms_are_built_in_parts(spark, monkeypatch):
    asked, built = [], []
    monkeypatch.setattr(repeats, "BUCKET_BYTES", 50)
    name_keys, starts = repeats._name_keys, repeats.repeated_starts
    monkeypatch.setattr(repeats, "_name_keys", lambda width, buckets: asked.append(buckets) or name_keys(width, buckets))
    rng = random.Random(5)
    base = "".join(rng.choice("abcdefgh") for _ in range(900))
    texts = [base[at : at + 400] + str(at) for at in range(0, 500, 13)]
    rows = {r.id: r for r in repeats.remove_repeats(listings(spark, texts), 20).collect()}
    for n, wanted in enumerate(brute([t.encode() for t in texts], 20)):
        assert (rows[n].n_bytes, [tuple(s) for s in rows[n].spans], bytes(rows[n].kept)) == wanted
    assert asked == [-(-sum(map(len, texts)) // 50)]

    data = np.frombuffer("".join(texts).encode(), np.uint8)
    runs = repeats.find_runs(data, np.array(list(map(len, texts))), 20)
    found = repeats.by_key(runs)
    keys = repeats._rows([(0, repeats.KEYS, 0, repeats.pack_sorted(found.keys), repeats.squeeze(bytes([repeats.DIFFER]) * len(found.keys)), b"")])
    row = {"block": 0, "text": repeats.squeeze(data.tobytes()), "lengths": repeats.pack_numbers(np.array(list(map(len, texts))))}
    sent = repeats._name_runs(20, 1)(pa.Table.from_pylist([row]), keys)
    monkeypatch.setattr(repeats, "repeated_starts", lambda strings, width: built.append(len(strings)) or starts(strings, width))
    repeats._judge_runs(20)(sent)
    assert len(built) == repeats.PARTS and max(built) < sum(built) / 4
