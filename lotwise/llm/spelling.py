"""Spelling variants of the words of listing descriptions, over a reduced alphabet.

Letters are hashed to a few symbols (code point modulo 16 in words of up to six letters, modulo 8 in longer ones), so
that a reduced word has few neighbours.  Every word generates the one-edit neighbourhood of its reduced word, which is
joined with the reduced vocabulary; the pairs that meet are verified on the original strings.  Of a neighbourhood only
the reduced word itself, the shorter neighbours and those with a smaller symbol are made: every pair of words is met
from one of its sides (an insertion is a deletion from the other side), so no link is lost and none is made twice.

Neighbours are 64-bit keys worked out from running sums of a polynomial, at constant cost each; words of any length
take linear work.  A key held by many words is an ordinary key of a sort-merge join, which Spark splits by measured
size.  Links and groups are never collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.session import saved

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Longest words of the larger alphabet, and the sizes of both; the smaller one is the larger one folded.
SHORT = 6
SHORT_SYMBOLS, SYMBOLS = 16, 8
#: Keys worked out at once in a worker.
AT_ONCE = 1 << 20
BASE = 0x9E3779B97F4A7C15
KEYS = "key long, word string, n long"


def description_words(listings: DataFrame) -> DataFrame:
    """(id, word): every run of letters of every whole ``description``, A-Z in lower case; a null one has none.

    One row per occurrence.  Ids may be null or repeat; other columns are not read.
    """
    lowered = F.translate(F.col("description").cast("string"), UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit(f"({LETTERS})"), F.lit(1))
    return listings.select(F.col("id"), F.explode(found).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n): the distinct words of at least so many code points that occur at least so often, n times.

    Counts cover all rows and are combined before the shuffle.  A null word is none.
    """
    long_enough = words.filter(F.length("word") >= least_length)
    return long_enough.groupBy("word").agg(F.count("word").alias("n")).filter(F.col("n") >= least_count)


def _symbols(length: int) -> int:
    return SHORT_SYMBOLS if length <= SHORT else SYMBOLS


def _powers(length: int) -> np.ndarray:
    base = np.full(length + 1, BASE, np.uint64)
    base[0] = 1
    return np.multiply.accumulate(base)


def _finished(sums: np.ndarray, length: int) -> np.ndarray:
    """Keys from polynomial sums: words of other lengths have other keys, and neighbours lie apart."""
    x = (sums ^ np.uint64(length)) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) ^ (x >> np.uint64(27))


def reduced_keys(codes: np.ndarray) -> np.ndarray:
    """The key of the reduced word of each row of code points, all rows of one length."""
    length = codes.shape[1]
    symbols = codes % np.uint64(_symbols(length)) + np.uint64(1)
    return _finished((symbols * _powers(length)[:length]).sum(axis=1, dtype=np.uint64), length)


def neighbour_keys(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of the reduced word and its neighbours that are shorter or have a smaller symbol.

    All rows of ``codes`` have one length.  A deletion is worked out in the alphabet of its own length; of a run of
    one symbol only the last is deleted, as all leave the same word.
    """
    count, length = codes.shape
    powers = _powers(length)
    size = _symbols(length)
    symbols = codes % np.uint64(size)
    whole = ((symbols + np.uint64(1)) * powers[:length]).sum(axis=1, dtype=np.uint64)
    yield np.arange(count), _finished(whole, length)
    for less in range(1, size):
        rows, places = np.nonzero(symbols >= less)
        yield rows, _finished(whole[rows] - np.uint64(less) * powers[places], length)
    if length:
        shorter = codes % np.uint64(_symbols(length - 1))
        terms = (shorter + np.uint64(1)) * powers[:length]
        before = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        inverse = np.uint64(pow(BASE, -1, 1 << 64))
        after = (terms.sum(axis=1, dtype=np.uint64)[:, None] - before - terms) * inverse
        last = np.ones(codes.shape, bool)
        last[:, :-1] = shorter[:, :-1] != shorter[:, 1:]
        rows, places = np.nonzero(last)
        yield rows, _finished((before + after)[rows, places], length - 1)


def _keyed(keys_of):
    """(word, n) to (key, word, n), words of one length at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch.column(0).to_pylist(), dtype=object)
            if not len(words):
                continue
            lengths = np.fromiter(map(len, words), np.int64, len(words))
            for length in np.unique(lengths).tolist():
                chosen = np.flatnonzero(lengths == length)
                step = max(1, AT_ONCE // (length * 4 + 1))
                for first in range(0, len(chosen), step):
                    part = chosen[first : first + step]
                    flat = np.frombuffer("".join(words[part]).encode("utf-32-le"), "<u4")
                    for rows, keys in keys_of(flat.reshape(len(part), length).astype(np.uint64)):
                        taken = pa.array(part[rows])
                        columns = [pa.array(keys.view(np.int64)), batch.column(0).take(taken), batch.column(1).take(taken)]
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "word", "n"])

    return run


def _own(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    yield np.arange(len(codes)), reduced_keys(codes)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n): every pair of words exactly one edit apart, once, ``word`` before ``other``.

    An edit inserts, deletes or replaces one code point.  ``words`` has distinct words ``word`` with counts ``n``.
    """
    given = words.select("word", "n")
    known = given.mapInArrow(_keyed(_own), KEYS).withColumnsRenamed({"word": "other", "n": "other_n"})
    met = given.mapInArrow(_keyed(neighbour_keys), KEYS).join(known, "key")
    near = met.filter((F.col("word") != F.col("other")) & (F.levenshtein("word", "other", 1) == 1))
    first, second = F.struct("word", "n"), F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"))
    ordered = near.select(F.least(first, second).alias("a"), F.greatest(first, second).alias("b")).distinct()
    return ordered.select("a.word", "a.n", F.col("b.word").alias("other"), F.col("b.n").alias("other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word reached, by doubling; forms lead to larger counts, never round."""
    now = saved(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("going")))
    while not now.filter("going").isEmpty():
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        joined = now.join(onward, "root", "left")
        now = saved(joined.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("going")))
    return now.select("word", "root")


def spelling_groups(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, n, form, form_n, n_near, root): what each word of a vocabulary is most likely a variant of.

    ``words`` has ``word`` and its count ``n``, as ``vocabulary`` gives them from listing descriptions.  ``form`` is the
    word one edit away that has the largest count (of equal ones the first in code-point order), if that is at least
    ``times`` (2 or more) times the word's own, else null with ``form_n``; ``n_near`` counts all words one edit away;
    ``root`` follows forms to the last one and is the word itself where it has none.  One row per distinct word: the
    counts of repeated rows add up, a null word is left out, a null count is 0, the empty word is a word; other columns
    are not read; an empty table gives no rows.
    """
    if times < 2:
        raise ValueError("times is at least 2")
    counted = words.filter(F.col("word").isNotNull()).groupBy("word")
    given = saved(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n")))
    sides = F.array(
        F.struct("word", F.col("other").alias("near"), F.col("other_n").alias("near_n")),
        F.struct(F.col("other").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")),
    )
    met = near_pairs(given).select(F.explode(sides).alias("side")).select("side.*")
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near"))).alias("best")
    summed = met.groupBy("word").agg(F.count("near").alias("n_near"), best)
    reaches = (-F.col("best.order") >= times * F.col("n")) & (F.col("best.order") < 0)
    found = given.join(summed, "word", "left").select(
        "word", "n",
        F.when(reaches, F.col("best.near")).alias("form"),
        F.when(reaches, -F.col("best.order")).alias("form_n"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )
    found = saved(found)
    return found.join(_roots(found.filter(F.col("form").isNotNull())), "word", "left").select(
        "word", "n", "form", "form_n", "n_near", F.coalesce("root", "word").alias("root")
    )
