"""Listing descriptions with the awkward cases: null, empty, blank, very long, copies, ties, other scripts."""

import random

from pyspark.sql import functions as F

WORDS = "flat shop land plot sale bank auction reserve price city road near sector tower lakh deposit Bank's élan घर 12,500".split()


def prose(rng: random.Random, count: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", ".", ",", str(rng.randint(0, 99))]) for _ in range(count))


def descriptions(seed: int = 1) -> list[str | None]:
    rng = random.Random(seed)
    base = [prose(rng, n) for n in (3, 40, 60, 90, 150)]
    near = []
    for text in base[1:]:
        words = text.split(" ")
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(words))] = "other"
            near.append(" ".join(changed))
    return [
        None, "", "   \n\t ", "a", "a b", "a B c", *base, *near, base[2], base[2], base[3] + "\n" + base[4],
        "the " * 300, prose(rng, 9000), " flat plot\u0085shop", "<|endoftext|> sold <|startoftext|>x",
    ]


def listings(spark, texts, partitions: int = 3):
    """Rows as (id, description), with columns whose names the operators use inside."""
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, description string")
    clash = {"block": F.lit("b"), "key": F.lit(1.5), "node": F.lit(None).cast("string"), "start": F.col("id") * 2}
    return rows.withColumns(clash).repartition(partitions, "id")


def none(spark):
    return spark.createDataFrame([], "id long, description string")
