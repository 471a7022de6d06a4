"""Language-model scores of listing descriptions: cross-entropy difference of two matched n-gram models.

A target model is counted over chosen listings and a background model over all of them (Moore and Lewis, 2010).
Both are bigram models smoothed towards their unigrams with the same constants over one vocabulary, that of all
counted words, so nothing is unknown to one model and known to the other.  A listing that was counted itself is
scored without its own counts, so that no model merely knows it by heart.

Words, firsts of a pair and pairs are counted each for itself, however many there are.  A block of listings adds up
its own counts and sends each bucket of the number range its distinct numbers once, packed; the bucket adds up the
blocks' counts and answers every block that asks with the sums of its numbers.  No table is gathered or broadcast:
the driver gets three sums, a block no more than what its own texts hold, and a frequent word is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm import textblocks
from lotwise.llm.ngramjoin import M1, M2, WordHashes, mixed
from lotwise.llm.wire import pack_numbers, pack_sorted, squeeze, unpack_numbers, unpack_sorted, unsqueeze
from lotwise.session import saved

#: The smallest vocabulary over which a unigram estimate is smoothed; more words than these count themselves.
WORDS = 1 << 16
#: Weight of the unigram estimate in a bigram estimate, and of the uniform one in a unigram estimate, as counts.
PULL = 4.0
FLOOR = 0.5
BUCKETS_PER_PARTITION = 2
#: Texts whose words are held at once.
TEXTS_AT_ONCE = 1000
#: What a number counts, in its two lowest bits; the others are a hash.
WORD, HEAD, PAIR = np.arange(3, dtype=np.uint64)
_HASH = ~np.uint64(3)

ASK = "block long, bucket int, asking boolean, numbers binary, target binary, background binary"
REPLY = "block long, bucket int, others binary, target binary, background binary, words long, target_total long, total long"
SCORES = "id long, n_words long, target_loss double, background_loss double, difference double"


def _tokens(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """One row each of word, head and pair numbers of all words, each text begun by an empty word, and texts' sizes."""
    words = [text.encode().lower().split() for text in texts]
    sizes = np.array(list(map(len, words)), dtype=np.int64)
    flat = mixed(hashes.of([w for own in words for w in own]))
    before = np.zeros_like(flat)
    before[1:] = mixed(flat[:-1] * M1 + M2)
    before[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
    pair = mixed(before * M2 + flat)
    return np.stack([(x & _HASH) | kind for x, kind in ((flat, WORD), (before, HEAD), (pair, PAIR))]), sizes


def _parts(texts: list[str], hashes: WordHashes) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    for first in range(0, len(texts), TEXTS_AT_ONCE):
        part = slice(first, first + TEXTS_AT_ONCE)
        yield part, *_tokens(texts[part], hashes)


def _counted(
    parts: list[tuple[slice, np.ndarray, np.ndarray]], chosen: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct numbers of a block, ascending, and their counts in its chosen texts and in all."""
    empty = np.zeros(0, np.uint64)
    numbers, times = np.unique(np.concatenate([empty, *[x.ravel() for _, x, _ in parts]]), return_counts=True)
    inside = [x[:, np.repeat(chosen[part], sizes)].ravel() for part, x, sizes in parts]
    some, often = np.unique(np.concatenate([empty, *inside]), return_counts=True)
    target = np.zeros(len(numbers), np.int64)
    target[np.searchsorted(numbers, some)] = often
    return numbers, target, times.astype(np.int64)


def _opened(row: dict) -> tuple[list[str], np.ndarray]:
    return textblocks.texts_of(row), np.array(textblocks.rest_of(row).column(0).to_pylist(), bool)


def _pack(counts: np.ndarray) -> bytes:
    planes = np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return squeeze(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def _homes(numbers: np.ndarray, buckets: int) -> np.ndarray:
    return (numbers >> np.uint64(40)).astype(np.int64) * buckets >> 24


def _asks(buckets: int, counting: bool, asking: bool):
    """Blocks to what they send to each bucket: their numbers, with counts if they are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for row in batch.to_pylist():
                texts, chosen = _opened(row)
                numbers, *counts = _counted(list(_parts(texts, hashes)), chosen)
                if not counting:
                    counts = [np.zeros_like(x) for x in counts]
                places, firsts = np.unique(_homes(numbers, buckets), return_index=True)
                split = [np.split(x, firsts[1:]) if len(places) else [] for x in (numbers, *counts)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": pa.array([row["block"]] * len(places), pa.int64()),
                        "bucket": pa.array(places, pa.int32()),
                        "asking": pa.array([asking] * len(places), pa.bool_()),
                        "numbers": pa.array([pack_sorted(x) for x in split[0]], pa.binary()),
                        "target": pa.array([pack_numbers(x) for x in split[1]], pa.binary()),
                        "background": pa.array([pack_numbers(x) for x in split[2]], pa.binary()),
                    }
                )

    return run


def _answer(rows: pa.Table) -> pa.Table:
    """Sums of a bucket for the blocks that ask, where they are not the block's own counts, and one row of totals.

    The block knows its numbers: bits over those it sent say which the sums are of.
    """
    sent = [unpack_sorted(x) for x in rows.column("numbers").to_pylist()]
    own = [
        [unpack_numbers(x).astype(np.int64) for x in rows.column(name).to_pylist()] for name in ("target", "background")
    ]
    found, at = np.unique(np.concatenate(sent), return_inverse=True)
    # Whole numbers below 2 ** 53 are exact in these sums.
    sums = [np.bincount(at, np.concatenate(x), len(found)).astype(np.int64) for x in own]
    ends = np.cumsum([len(x) for x in sent])
    out, bucket = [], rows.column("bucket")[0].as_py()
    for k, (block, asking) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("block", "asking")), strict=True)):
        if asking:
            place = at[ends[k] - len(sent[k]) : ends[k]]
            other = (sums[0][place] != own[0][k]) | (sums[1][place] != own[1][k])
            if other.any():
                others = squeeze(np.packbits(other).tobytes())
                out.append((block, bucket, others, *[_pack(x[place[other]]) for x in sums]))
    word = (found & ~_HASH) == WORD
    totals = int(np.count_nonzero(sums[1][word])), int(sums[0][word].sum()), int(sums[1][word].sum())
    rows = [(*r, None, None, None) for r in out] + [(None, bucket, None, None, None, *totals)]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 3]
    names = ["block", "bucket", "others", "target", "background", "words", "target_total", "total"]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _own_counts(places: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """How often each number occurs in its own text."""
    _, at, times = np.unique(owner << 32 | places, return_inverse=True, return_counts=True)
    return times[at]


def _losses(counts: np.ndarray, own: np.ndarray, size: np.ndarray, total: int, vocabulary: int) -> np.ndarray:
    """Negative log-likelihood of every word behind the one before it, ``own`` counts and text sizes taken out."""
    word, head, pair = (counts - own).astype(np.float64)
    alone = (word + FLOOR) / (total - size + FLOOR * vocabulary)
    return -np.log((pair + PULL * alone) / (head + PULL))


def _score(buckets: int, counted: bool, sent: bool, totals: tuple[int, int], vocabulary: int):
    """Blocks and answers to scores; what is not answered is what the block has ``sent`` itself, or nothing."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        out = [pa.table([pa.array([], k) for k in (pa.int64(), pa.int64(), *[pa.float64()] * 3)], names=_NAMES)]
        for row in blocks.to_pylist():
            texts, chosen = _opened(row)
            ids = textblocks.unpack_ids(row["ids"], len(texts))
            parts = list(_parts(texts, WordHashes()))
            numbers, *sums = _counted(parts, chosen)
            if not sent:
                sums = [np.zeros_like(x) for x in sums]
            first = np.searchsorted(_homes(numbers, buckets), np.arange(buckets + 1))
            for reply in replies.to_pylist():
                start, end = first[reply["bucket"]], first[reply["bucket"] + 1]
                others = np.frombuffer(unsqueeze(reply["others"]), np.uint8)
                place = start + np.flatnonzero(np.unpackbits(others, count=end - start))
                for own, name in zip(sums, ("target", "background"), strict=True):
                    own[place] = _unpack(reply[name])
            for part, x, sizes in parts:
                place, ends = np.searchsorted(numbers, x), np.cumsum(sizes)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                own = np.stack([_own_counts(p, owner) for p in place]) * counted
                size, none, losses = np.repeat(sizes, sizes) * counted, sizes == 0, []
                members = chosen[part][owner], np.ones(len(owner), bool)
                for known, member, total in zip(sums, members, totals, strict=True):
                    each = _losses(known[place], own * member, size * member, total, vocabulary)
                    run_ = np.concatenate([[0.0], np.cumsum(each)])
                    losses.append((run_[ends] - run_[ends - sizes]) / np.maximum(sizes, 1))
                columns = [pa.array(y, mask=none) for y in (*losses, losses[0] - losses[1])]
                out.append(pa.table([pa.array(ids[part], pa.int64()), pa.array(sizes), *columns], names=_NAMES))
        return pa.concat_tables(out)

    return run


_NAMES = ["id", "n_words", "target_loss", "background_loss", "difference"]


def _blocks(listings: DataFrame, labelled: bool) -> DataFrame:
    """Blocks written once: both jobs over them need the same rows under one block number."""
    chosen = F.coalesce(F.col("in_target").cast("boolean"), F.lit(False)) if labelled else F.lit(False)
    return saved(textblocks.cut(listings.select("id", "description", chosen.alias("in_target")), rest=True))


@dataclass(frozen=True)
class Scorer:
    """The counted listings, in blocks; the counts themselves are brought to the listings to be scored."""

    listings: DataFrame
    blocks: DataFrame

    def score(self, listings: DataFrame, counted: bool = True) -> DataFrame:
        """(id, n_words, target_loss, background_loss, difference): mean losses per word of every ``description``.

        A smaller difference, target less background, means nearer to the target.  ``counted`` says that the models
        were fitted on these listings; ``in_target`` then marks those of the target.  Words are runs without ASCII
        white space, A-Z in lower case, told apart by 62-bit hashes, as pairs are.  A null, empty or blank description
        has no words and null losses.  One row per input row; repeated rows are scored like one another, each without
        its own counts; other columns are not read.  Runs a job that adds up the counts.
        """
        buckets = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
        same = counted and listings is self.listings
        blocks = self.blocks if same else _blocks(listings, counted)
        asks = self.blocks.mapInArrow(_asks(buckets, True, same), ASK)
        if not same:
            asks = asks.unionByName(blocks.mapInArrow(_asks(buckets, False, True), ASK))
        found = saved(asks.groupBy("bucket").applyInArrow(_answer, REPLY))
        zero = F.lit(0).cast("long")
        sums = [F.coalesce(F.sum(c), zero).alias(c) for c in ("words", "target_total", "total")]
        words, *totals = found.filter("block IS NULL").agg(*sums).first()
        replies = found.filter("block IS NOT NULL").select("block", "bucket", "others", "target", "background")
        run = _score(buckets, counted, same, tuple(totals), max(WORDS, words))
        return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, SCORES)


def fit(listings: DataFrame) -> Scorer:
    """Both models over every ``description``, the target's over those with ``in_target``; null is false.

    Writes the listings in blocks; they are counted when listings are scored.
    """
    return Scorer(listings, _blocks(listings, True))
