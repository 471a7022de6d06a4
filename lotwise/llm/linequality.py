"""Quality of listing descriptions by a linear-chain conditional random field over their lines.

Every line is good or bad.  Features describe the line's shape and that of the lines before and after it, and the
field adds a weight for each pair of neighbouring labels.  Forward and backward passes give each line's probability
of being good; their mean, weighted by line length, is the description's quality, moved so that 0.7 divides best.

``fit`` learns from a bounded sample of labelled listings, ``QualityModel.score`` is one pass over the listings
without a shuffle.  The model is a few hundred numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound of the fitting sample: listings, and lines of one listing, a stretch of them anywhere in it.
FIT_LISTINGS = 4000
FIT_LINES = 400
ROUNDS = 150
RATE = 0.15
SHRINK = 1e-3
#: The score that divides kept from rejected listings.
DIVIDE = 0.7

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
DIGITS = bytes(range(48, 58))
SIGNS = b"!#$%&*@^~_<>=+[]{}\\/"
ENDS = (b".", b"!", b"?", b":", b'"')

#: Bucket edges of each measure of a line.
EDGES = (
    ("length", (1, 8, 16, 32, 64, 128, 256, 512, 1024, 4096)),
    ("upper", (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.6, 0.8)),
    ("signs", (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.4)),
    ("bars", (0.001, 0.01, 0.03, 0.06, 0.1, 0.2)),
    ("digits", (0.001, 0.02, 0.1, 0.3, 0.6)),
    ("letters", (0.2, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    ("distinct", (0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 0.95, 1.0)),
    ("repeats", (0.001, 0.02, 0.05, 0.1, 0.2, 0.4, 0.8)),
    ("word", (2, 3, 4, 5, 6, 8, 12, 20)),
    ("ended", (0.5,)),
    ("again", (0.5,)),
)
NAMES = [name for name, _ in EDGES]
WIDTHS = [len(edges) + 1 for _, edges in EDGES]
OFFSETS = np.concatenate([[0], np.cumsum(WIDTHS)])
#: Measures also seen from the neighbouring lines; one bucket more says that there is no such line.
NEIGHBOUR = [NAMES.index(n) for n in ("length", "upper", "signs", "bars", "distinct", "repeats", "letters")]
SIDE_WIDTHS = [WIDTHS[k] + 1 for k in NEIGHBOUR]
SIDE_OFFSETS = np.concatenate([[0], np.cumsum(SIDE_WIDTHS)])
FEATURES = int(OFFSETS[-1] + 2 * SIDE_OFFSETS[-1])


def _measures(line: bytes, seen: set[bytes]) -> tuple[float, ...]:
    size = len(line)
    if not size:
        return (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)
    words = line.split()
    letters = size - len(line.translate(None, LETTERS))
    again = line in seen
    seen.add(line)
    return (
        size,
        (size - len(line.translate(None, UPPER))) / max(letters, 1),
        (size - len(line.translate(None, SIGNS))) / size,
        line.count(b"|") / size,
        (size - len(line.translate(None, DIGITS))) / size,
        letters / size,
        len(set(words)) / max(len(words), 1),
        sum(map(eq, words, words[1:])) / max(len(words), 1),
        size / max(len(words), 1),
        line.endswith(ENDS),
        again,
    )


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, weights, counts): per line its active features and its length in bytes, per text its lines.

    A text without lines counts as one empty line.
    """
    rows, counts = [], []
    for text in texts:
        lines = (text or "").encode().split(b"\n")
        seen: set[bytes] = set()
        rows.extend([_measures(line.strip(), seen) for line in lines])
        counts.append(len(lines))
    raw, counts = np.array(rows, dtype=float).reshape(-1, len(EDGES)), np.array(counts, dtype=np.int64)
    buckets = np.stack([np.digitize(raw[:, k], edges) for k, (_, edges) in enumerate(EDGES)], axis=1)
    first = np.zeros(len(raw), bool)
    last = np.zeros(len(raw), bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last[ends - 1] = True
    near = buckets[:, NEIGHBOUR]
    none = np.array(SIDE_WIDTHS) - 1
    before = np.where(first[:, None], none, np.roll(near, 1, axis=0)) + SIDE_OFFSETS[:-1]
    after = np.where(last[:, None], none, np.roll(near, -1, axis=0)) + SIDE_OFFSETS[:-1]
    own = buckets + OFFSETS[:-1]
    active = np.concatenate([own, before + OFFSETS[-1], after + OFFSETS[-1] + SIDE_OFFSETS[-1]], axis=1)
    return active.astype(np.int16), np.maximum(raw[:, 0], 1), counts


def stretch(text: str | None, lines: int, most: int = FIT_LINES) -> slice:
    """The lines of a text that are learned from: all, or ``most`` neighbouring ones, placed by a hash of the text."""
    first = crc32((text or "").encode()) % (lines - most + 1) if lines > most else 0
    return slice(first, first + min(lines, most))


def _chains(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts from the longest down, where each begins, and how many have a line at each position."""
    order = np.argsort(-counts, kind="stable")
    starts = (np.cumsum(counts) - counts)[order]
    longest = int(counts.max(initial=0))
    alive = len(counts) - np.searchsorted(np.sort(counts), np.arange(longest), side="right")
    return order, starts, alive


def marginals(
    lift: np.ndarray, counts: np.ndarray, steps: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray, float]:
    """Every line's probability of being good, the expected label pairs, and the log of all chains' totals.

    ``lift`` is each line's score for good against bad, ``steps[a, b]`` the score of label b after a.  Chains of
    many texts advance together, one line position at a time.
    """
    _, starts, alive = _chains(counts)
    move = np.exp(steps)
    top = np.maximum(lift, 0)
    local = np.stack([np.exp(-top), np.exp(lift - top)], axis=1)
    forward, scale, backward = np.empty_like(local), np.empty(len(lift)), np.ones_like(local)
    for t, n in enumerate(alive):
        at = starts[:n] + t
        mass = local[at] if t == 0 else (forward[at - 1] @ move) * local[at]
        scale[at] = mass.sum(axis=1)
        forward[at] = mass / scale[at, None]
    for t in range(len(alive) - 1, 0, -1):
        at = starts[: alive[t]] + t
        backward[at - 1] = (local[at] * backward[at]) @ move.T / scale[at, None]
    joint = forward * backward
    good = joint[:, 1] / joint.sum(axis=1)
    expected = np.zeros((2, 2))
    if pairs:
        inner = np.ones(len(lift), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        both = forward[at - 1][:, :, None] * move * (local[at] * backward[at])[:, None, :] / scale[at, None, None]
        expected = both.sum(axis=0)
    return good, expected, float(np.log(scale).sum() + top.sum())


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    steps: np.ndarray
    shift: float

    def of_texts(self, texts: list[str]) -> np.ndarray:
        features, size, counts = line_features(texts)
        good, _, _ = marginals(self.weights[features].sum(axis=1), counts, self.steps)
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts)
        return _moved(mean, self.shift)

    def score(self, listings: DataFrame) -> DataFrame:
        """(id, score): quality of every ``description`` from 0 to 1, null and empty ones included.

        One row per input row; nothing but the description is read for the score.
        """

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first in range(0, batch.num_rows, 1000):
                    part = batch.slice(first, 1000)
                    scores = pa.array(self.of_texts(part.column(1).to_pylist()), pa.float64())
                    yield pa.RecordBatch.from_arrays([part.column(0), scores], names=["id", "score"])

        texts = listings.select(F.col("id").cast("long").alias("id"), F.col("description").cast("string"))
        return texts.mapInArrow(run, "id long, score double")

    def column(self, description: Column | str) -> Column:
        """The score as a column, for a filter."""

        @F.arrow_udf("double")
        def scored(texts: pa.Array) -> pa.Array:
            parts = [self.of_texts(texts.slice(k, 1000).to_pylist()) for k in range(0, len(texts), 1000)]
            return pa.array(np.concatenate(parts) if parts else [], pa.float64())

        return scored(description)


def _logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def _moved(mean: np.ndarray, shift: float) -> np.ndarray:
    return 1 / (1 + np.exp(-(_logit(mean) + shift)))


def train(features: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> QualityModel:
    """Maximum likelihood by gradient steps; every line of a listing carries the listing's label."""
    weights, steps = np.zeros(FEATURES), np.zeros((2, 2))
    if not len(labels):
        return QualityModel(weights, steps, 0.0)
    truth = np.repeat(labels.astype(float), counts)
    flat, wide = features.ravel(), features.shape[1]
    seen = np.bincount(flat, np.repeat(truth, wide), FEATURES)
    same = np.array([[((counts - 1) * (labels == a)).sum() if a == b else 0 for b in (0, 1)] for a in (0, 1)])
    parameters = np.concatenate([weights, steps.ravel()])
    speed, spread = np.zeros_like(parameters), np.zeros_like(parameters)
    for n in range(1, ROUNDS + 1):
        weights, steps = parameters[:FEATURES], parameters[FEATURES:].reshape(2, 2)
        good, expected, _ = marginals(weights[features].sum(axis=1), counts, steps, pairs=True)
        slope = np.concatenate([seen - np.bincount(flat, np.repeat(good, wide), FEATURES), (same - expected).ravel()])
        slope = slope / len(truth) - SHRINK * parameters
        speed = 0.9 * speed + 0.1 * slope
        spread = 0.99 * spread + 0.01 * slope**2
        parameters = parameters + RATE * (speed / (1 - 0.9**n)) / (np.sqrt(spread / (1 - 0.99**n)) + 1e-8)
    weights, steps = parameters[:FEATURES], parameters[FEATURES:].reshape(2, 2)
    good, _, _ = marginals(weights[features].sum(axis=1), counts, steps)
    starts = np.cumsum(counts) - counts
    mean = _logit(np.add.reduceat(good * size, starts) / np.add.reduceat(size, starts))
    return QualityModel(weights, steps, float(_logit(DIVIDE) - _divider(mean, labels)))


def _divider(values: np.ndarray, labels: np.ndarray) -> float:
    """The value that divides labels 0 and 1 with the fewest mistakes, in the middle of the widest such gap."""
    order = np.argsort(values, kind="stable")
    values, labels = values[order], labels[order]
    if labels.min() == labels.max():
        return float(_logit(0.5))
    wrong = np.concatenate([[0], np.cumsum(labels)]) + np.concatenate([np.cumsum(1 - labels[::-1])[::-1], [0]])
    gaps = np.diff(values)
    inner = wrong[1:-1]
    best = np.flatnonzero(inner == inner.min())
    place = best[np.argmax(gaps[best])]
    return float((values[place] + values[place + 1]) / 2)


def fit(listings: DataFrame, labels: DataFrame, sample: int = FIT_LISTINGS) -> QualityModel:
    """Learns from ``labels`` (id, quality 0 or 1) of ``listings`` (id, description).

    At most ``sample`` labelled listings are used, the first by a hash of their ids, and ``FIT_LINES`` neighbouring lines
    of each, from anywhere in it: that bounds what one task gathers.  Whole texts are measured, where they lie.  Null ids and labels fall out, a null
    description is an empty one, repeated label rows count again.  Runs a job, as fitting does.
    """
    kept = labels.filter(F.col("quality").isin(0, 1)).select(F.col("id").cast("long").alias("id"), "quality")
    chosen = kept.orderBy(F.xxhash64("id"), "id", "quality").limit(sample)
    texts = listings.select(F.col("id").cast("long").alias("id"), F.col("description").cast("string"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            features, size, counts = line_features(texts)
            starts = np.cumsum(counts) - counts
            chosen = [stretch(t, n) for t, n in zip(texts, counts.tolist(), strict=True)]
            packed = [features[a + s.start : a + s.stop].tobytes() for a, s in zip(starts, chosen, strict=True)]
            sizes = [size[a + s.start : a + s.stop].tobytes() for a, s in zip(starts, chosen, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())],
                names=["id", "quality", "features", "sizes"],
            )

    def learned(rows: pa.Table) -> pa.Table:
        found = sorted(rows.to_pylist(), key=lambda r: (r["id"], r["quality"], r["features"]))
        features = [np.frombuffer(r["features"], np.int16).reshape(-1, len(EDGES) + 2 * len(NEIGHBOUR)) for r in found]
        size = np.concatenate([np.frombuffer(r["sizes"]) for r in found])
        model = train(np.concatenate(features), size, np.array(list(map(len, features))), np.array([r["quality"] for r in found]))
        return pa.table({"weights": [model.weights.tolist()], "steps": [model.steps.ravel().tolist()], "shift": [model.shift]})

    lines = texts.join(F.broadcast(chosen), "id").select("id", "quality", "description")
    lines = lines.mapInArrow(measured, "id long, quality int, features binary, sizes binary")
    found = lines.groupBy(F.lit("all")).applyInArrow(learned, "weights array<double>, steps array<double>, shift double").first()
    if found is None:
        return QualityModel(np.zeros(FEATURES), np.zeros((2, 2)), 0.0)
    return QualityModel(np.array(found.weights), np.array(found.steps).reshape(2, 2), found.shift)
