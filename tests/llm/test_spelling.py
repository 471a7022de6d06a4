import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import descriptions, listings, none

from lotwise.llm.spelling import description_words, spelling_groups, vocabulary


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_groups(counts, times=2):
    out = {}
    for word, n in counts.items():
        near = sorted((-m, o) for o, m in counts.items() if one_edit(word, o))
        reaches = near and -near[0][0] >= times * n and near[0][0] < 0
        out[word] = n, near[0][1] if reaches else None, -near[0][0] if reaches else None, len(near)
    rows = []
    for word, (n, form, form_n, n_near) in out.items():
        root = word
        while out[root][1] is not None:
            root = out[root][1]
        rows.append((word, n, form, form_n, n_near, root))
    return sorted(rows)


def grouped(spark, rows, times=2):
    frame = spark.createDataFrame(rows, "word string, n long").withColumns({"key": F.lit("k"), "other": F.lit(1)})
    found = spelling_groups(frame.repartition(3), times)
    assert found.columns == ["word", "n", "form", "form_n", "n_near", "root"]
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("times", [2, 3])
def test_groups_equal_all_pairs(spark, times):
    rng = random.Random(7)
    words = {"".join(rng.choice("abdeqéÿ") for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 12]))) for _ in range(250)}
    for word in list(words)[:120]:
        k = rng.randrange(len(word))
        words |= {word[:k] + word[k + 1 :], word[:k] + rng.choice("abq") + word[k:], word[:k] + rng.choice("aéz") + word[k + 1 :]}
    words |= {"aaaaaa", "aaaaaaa", "aaaaaaaa", "aaaaaab", "", "a", "𝒳bcde", "bcdef", "𝒳bcdef"}
    counts = {word: rng.choice([0, 1, 3, 3, 7, 20, 100]) for word in words}
    assert grouped(spark, list(counts.items()), times) == plain_groups(counts, times)


def test_chains_ties_repeats_and_nulls(spark):
    chain = {"bank" + "s" * k: 4**k for k in range(12)}
    ties = {"plota": 10, "plotb": 10, "plot": 5, "x" * 3000: 1, "x" * 2999: 2}
    counts = chain | ties
    rows = list(counts.items()) + [(None, 5)]
    assert grouped(spark, rows) == plain_groups(counts)
    assert grouped(spark, [("flats", 1), ("flats", 2), ("flat", 6), ("flap", None)]) == plain_groups({"flats": 3, "flat": 6, "flap": 0})
    assert grouped(spark, []) == []
    with pytest.raises(ValueError):
        grouped(spark, [], times=1)


def test_words_and_vocabulary(spark):
    texts = [*descriptions(), "Élan élan ELAN Straße STRASSE x×y ÿ", "Flat-flat FLAT's"]
    words = description_words(listings(spark, texts))
    import re

    wanted = Counter()
    for text in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        wanted.update(re.findall("[A-Za-zÀ-ÿ]+", lowered))
    assert Counter(r.word for r in words.collect()) == wanted
    kept = {(w, n) for w, n in wanted.items() if len(w) >= 4 and n >= 2}
    assert set(map(tuple, vocabulary(words, 4, 2).collect())) == kept
    assert vocabulary(description_words(none(spark))).collect() == []
