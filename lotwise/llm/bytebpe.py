"""Byte-level BPE ids of listing descriptions, each stretch of text encoded once per worker.

Texts are split at lone spaces between two characters that are no white space, where a byte-level vocabulary's splitter
always starts a token.  Such parts repeat, and a worker remembers their ids.  A part seen for the first time is put
together from its words: a run of Latin letters, with the space before it, is cut off where one token always ends and
the next starts, and what lies between such words is a stretch too.  Words are remembered as well; all is forgotten when
there is too much of it.  Rows stay where they lie: nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.bpe import tokenizer
from lotwise.llm.wire import spread

#: Parts and words that a worker remembers, and text characters encoded at once.
MOST_PARTS, MOST_WORDS = 300_000, 500_000
AT_ONCE = 1 << 20
#: A word that can be cut off: ASCII other than letters and apostrophes before it (or its own space), ASCII other than
#: letters behind it, and no two white spaces before it, of which the splitter would leave one alone.
_WORD = re.compile(
    r"((?: |(?<![^\x00-&(-@\[-`{-\x7f])(?<!\s\s))[A-Za-zÀ-ÖØ-öø-ÿ]++(?=[\x00-@\[-`{-\x7f]|\Z))"
)


class _Ids:
    """Ids of numbered strings, end to end."""

    def __init__(self):
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def add(self, counts: np.ndarray, flat: np.ndarray) -> None:
        self.counts, self.flat = np.concatenate([self.counts, counts]), np.concatenate([self.flat, flat])

    def of(self, numbers: np.ndarray) -> np.ndarray:
        starts = np.cumsum(self.counts) - self.counts
        return self.flat[spread(starts[numbers], self.counts[numbers])]


class _Parts(dict):
    """Numbers of parts, given where they are first met; -1 for one whose ends are no safe places to split.

    A part stands behind a space; what has none before it is kept as a tuple.
    """

    def __init__(self):
        self.made, self.fresh = 0, []

    def met(self, key: str | tuple[str], text: str) -> int:
        self.fresh.append(text)
        self[key] = number = self.made
        self.made += 1
        return number

    def meet(self, parts: list[str]) -> None:
        """Numbers those of a text's parts that are new, all at once."""
        new = set(filterfalse(self.__contains__, parts))
        safe = [p for p in new if p and len(p.strip()) == len(p)]
        if len(safe) < len(new):
            self.update(dict.fromkeys(new.difference(safe), -1))
        self.update(zip(safe, range(self.made, self.made + len(safe)), strict=True))
        self.fresh += map(" ".__add__, safe)
        self.made += len(safe)


class _Known:
    """Parts and words seen, their numbers and ids."""

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self.specials = [t.content for t in tokenizer(vocabulary).get_added_tokens_decoder().values()]
        self.parts, self.part_ids, self.uncut = _Parts(), _Ids(), set()
        self.words, self.word_ids = {}, _Ids()

    def forget(self) -> None:
        """Frees what is remembered beyond the limits; between calls of ``learn`` only."""
        if len(self.parts) > MOST_PARTS:
            self.parts, self.part_ids = _Parts(), _Ids()
        if len(self.words) > MOST_WORDS:
            self.words, self.word_ids = {}, _Ids()

    def _whole(self, text: str, special: bool = False) -> np.ndarray:
        number = self.parts.get((text,))
        if number is None:
            number = self.parts.met((text,), text)
            if special:
                self.uncut.add(text)
        return np.array([number], np.int64)

    def codes(self, text: str) -> np.ndarray:
        """The numbers of the parts of a text; one that cannot be split safely is one part."""
        if special := any(s in text for s in self.specials):
            return self._whole(text, special)
        first, *rest = text.split(" ")
        if rest and (not first or first[-1].isspace()):
            return self._whole(text)
        self.parts.meet(rest)
        numbers = np.fromiter(map(self.parts.__getitem__, rest), np.int64, len(rest))
        if len(numbers) and numbers.min() < 0:
            return self._whole(text)
        return np.concatenate([self._whole(first), numbers])

    def learn(self) -> None:
        """Works out the ids of the parts met since the last call."""
        words, ends = [], [0]
        for part in self.parts.fresh:
            # A space and ASCII letters are one word as they are.
            if part in self.uncut or (part.isascii() and part[:1] == " " and part[1:].isalpha()):
                words.append(part)
            else:
                words += filter(None, _WORD.split(part))
            ends.append(len(words))
        known = self.words
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
        for first in range(0, len(fresh), 20_000):
            some = tokenizer(self.vocabulary).encode_batch_fast(fresh[first : first + 20_000], add_special_tokens=False)
            ids = [x.ids for x in some]
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            self.word_ids.add(np.fromiter(map(len, ids), np.int64, len(ids)), flat)
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        sizes = np.concatenate([[0], np.cumsum(self.word_ids.counts[codes])])
        self.part_ids.add(np.diff(sizes[np.array(ends)]), self.word_ids.of(codes))
        self.parts.fresh, self.uncut = [], set()


@lru_cache(maxsize=1)
def _known(vocabulary: str) -> _Known:
    """One per worker process, kept from task to task."""
    return _Known(vocabulary)


def encoded(batches: Iterator[pa.RecordBatch], vocabulary: str, ended_by: int | None) -> Iterator[pa.RecordBatch]:
    """(id, description) to (id, token_ids), some texts at a time."""
    tail = np.array([] if ended_by is None else [ended_by], np.int32)
    known = _known(vocabulary)

    def some(ids: list, texts: list[str]) -> pa.RecordBatch:
        codes = [known.codes(text) for text in texts]
        known.learn()
        every = np.concatenate(codes)
        flat = known.part_ids.of(every)
        sizes = np.concatenate([[0], np.cumsum(known.part_ids.counts[every])])
        ends = sizes[np.cumsum([0, *map(len, codes)])]
        lists = [x for low, high in zip(ends[:-1], ends[1:], strict=True) for x in (flat[low:high], tail)]
        offsets = pa.array(ends + len(tail) * np.arange(len(ends)), pa.int32())
        known.forget()
        values = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(lists)))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), values], names=["id", "token_ids"])

    for batch in batches:
        ids, texts, held = [], [], 0
        for id_, text in zip(batch.column(0), batch.column(1), strict=True):
            ids.append(id_.as_py())
            texts.append(text.as_py() or "")
            held += len(texts[-1])
            if held >= AT_ONCE:
                yield some(ids, texts)
                ids, texts, held = [], [], 0
        if ids:
            yield some(ids, texts)


def chosen(listings: DataFrame) -> DataFrame:
    return listings.select(F.col("id").cast("long").alias("id"), F.col("description").cast("string").alias("description"))


def encode_descriptions(listings: DataFrame, vocabulary: str, ended_by: int | None = None) -> DataFrame:
    """(id, token_ids): the byte-level BPE ids of every listing's whole ``description``, no special tokens added.

    Ids equal those of the tokenizers library for a byte-level vocabulary without prefix space; special tokens spelt
    inside a text get their own ids.  With ``ended_by``, that id follows every text's.  A null or empty description
    has no ids of its own.  One row per input row: repeated rows stay, ``id`` may be null, other columns are not
    read, an empty table gives none.
    """
    return chosen(listings).mapInArrow(lambda batches: encoded(batches, vocabulary, ended_by), "id long, token_ids array<int>")
