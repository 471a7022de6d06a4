import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from lotwise.llm import lmscore
from texts import descriptions, listings, none, prose


def words_of(text):
    return (text or "").encode().lower().split()


def brute(texts, chosen, n, counted=True):
    """Losses of text n with exact tables: equal to hashed ones as long as nothing collides."""
    sums = []
    for members in ([k for k in range(len(texts)) if chosen[k]], list(range(len(texts)))):
        if counted:
            members = [k for k in members if k != n]
        word, head, pair = Counter(), Counter(), Counter()
        for k in members:
            own = words_of(texts[k])
            word.update(own)
            head.update([None, *own[:-1]] if own else [])
            pair.update(zip([None, *own[:-1]], own))
        total, loss = sum(word.values()), 0.0
        own = words_of(texts[n])
        for a, b in zip([None, *own[:-1]], own):
            alone = (word[b] + lmscore.FLOOR) / (total + lmscore.FLOOR * lmscore.WORDS)
            loss -= np.log((pair[a, b] + lmscore.PULL * alone) / (head[a] + lmscore.PULL))
        sums.append(loss / max(1, len(own)))
    return sums


def test_losses_equal_exact_models(spark):
    texts = [t for t in descriptions(2) if len(t or "") < 3000]
    chosen = [n % 3 == 0 for n in range(len(texts))]
    given = listings(spark, texts).withColumn("in_target", (F.col("id") % 3 == 0) | F.when(F.col("id") % 2 == 0, None))
    scorer = lmscore.fit(given)
    rows = {r.id: r for r in scorer.score(given).collect()}
    for n, text in enumerate(texts):
        own = words_of(text)
        assert rows[n].n_words == len(own)
        if own:
            target, background = brute(texts, chosen, n)
            assert np.isclose(rows[n].target_loss, target, rtol=1e-3)
            assert np.isclose(rows[n].background_loss, background, rtol=1e-3)
            assert np.isclose(rows[n].difference, rows[n].target_loss - rows[n].background_loss)
        else:
            assert rows[n].difference is None
    fresh = scorer.score(listings(spark, texts[5:6]), counted=False).first()
    assert np.isclose(fresh.target_loss, brute(texts, chosen, 5, counted=False)[0], rtol=1e-3)


def test_target_like_texts_score_lower(spark):
    rng = random.Random(1)
    kinds = [("red green blue", n % 2 == 0) if n % 2 == 0 else ("one two three", False) for n in range(80)]
    texts = [" ".join(rng.choice(k.split()) for _ in range(30)) for k, _ in kinds]
    rows = [(n, t, kinds[n][1]) for n, t in enumerate(texts)]
    given = spark.createDataFrame(rows, "id long, description string, in_target boolean").repartition(3)
    found = {r.id: r.difference for r in lmscore.fit(given).score(given).collect()}
    assert max(found[n] for n in range(0, 80, 2)) < min(found[n] for n in range(1, 80, 2))


def test_empty_table(spark):
    given = none(spark).withColumn("in_target", F.lit(True))
    assert lmscore.fit(given).score(given).count() == 0
    scorer = lmscore.fit(given)
    one = scorer.score(listings(spark, [prose(random.Random(1), 5)]), counted=False).first()
    assert one.difference == 0


def test_rare_words_stay_rare_among_many(spark):
    """More words and pairs than the tables of fixed size had slots for: every count is still that of its own word."""
    texts = [" ".join(f"w{n * 700 + k}" for k in range(700)) for n in range(400)]
    texts += ["again and again", "again and again", "w1 w2 w3 unheard"]
    given = spark.createDataFrame([(n, t, n % 2 == 0) for n, t in enumerate(texts)], "id long, description string, in_target boolean")
    given = given.repartition(3, "id")
    scorer = lmscore.fit(given)
    rows = {r.id: r for r in scorer.score(given).collect()}
    words = len({w for t in texts for w in t.split()})
    for n in (0, 1, 399, 400, 402):
        chosen = [k % 2 == 0 for k in range(len(texts))]
        target, background = many(texts, chosen, n, words)
        assert np.isclose(rows[n].target_loss, target, rtol=1e-9)
        assert np.isclose(rows[n].background_loss, background, rtol=1e-9)


def many(texts, chosen, n, vocabulary):
    """``brute`` over a vocabulary of another size."""
    kept, lmscore.WORDS = lmscore.WORDS, vocabulary
    try:
        return brute(texts, chosen, n)
    finally:
        lmscore.WORDS = kept


def test_other_listings_are_scored_with_and_without_their_own_counts(spark):
    texts = [t for t in descriptions(4) if len(t or "") < 3000]
    chosen = [n % 3 == 0 for n in range(len(texts))]
    given = listings(spark, texts).withColumn("in_target", F.col("id") % 3 == 0)
    scorer = lmscore.fit(given)
    part = {r.id: r for r in scorer.score(given.filter("id % 4 = 1")).collect()}
    fresh = {r.id: r for r in scorer.score(given.filter("id % 4 = 1"), counted=False).collect()}
    for n in range(5, len(texts), 4):
        assert np.isclose(part[n].target_loss, brute(texts, chosen, n)[0], rtol=1e-9)
        assert np.isclose(fresh[n].background_loss, brute(texts, chosen, n, counted=False)[1], rtol=1e-9)
