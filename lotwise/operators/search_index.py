"""A stored inverted index over listing texts, searched instead of the listings themselves.

Listings are dealt into blocks of about ``BLOCK_LISTINGS`` by the hash of their id.  ``write_index`` stores one row per
(term, block) with the block's listings that hold the term and every place of it, partitioned by a bucket of the term
and sorted by term and block.  A search names its terms, so the scan is pruned to their buckets' files and, inside, to
the row groups of the terms.  Phrases are found by meeting places; ranks count places by weight class.
Titles are stored as three-letter grams beside the words, which narrows the match of a text anywhere in a title.

Changes append a segment: ``add_changes`` compares a listing before and after, and writes a posting for a term that
came or moved and an empty one for a term that went.  A reader takes the newest posting of each (term, listing), block by
block; ``compacted`` gives the same index in one segment.  Segments are whole files, so a search needs no lock, and a
segment written again under its number by a retried job replaces itself.

A listing's text is all that is shuffled to make postings: a block's postings are made, compared and merged where the
block lies.  A very common term is no hot task: it has a row in every block, and files of one bucket are divided by size.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.operators import textsearch
from lotwise.operators.search import RANK, SearchQuery, apply_filters, sort_order, title_pattern
from lotwise.operators.textsearch import WEIGHTED_FIELDS, Term, alternatives, words_line
from lotwise.session import prepare

BUCKETS = 64
#: Listings expected in a block by the first segment that has any; later segments keep its number of blocks.
BLOCK_LISTINGS = 16_384
WORD, GRAM = "word", "gram"
#: Postings of a term in a block, listings ascending: ``sizes`` counts the places of each, -1 where the term went; ``places``
#: lie end to end, each the number of its word in the whole text times 8 and its weight class.  Grams have no places.
_POSTINGS = "kind string, term string, block int, blocks int, ids array<long>, sizes array<int>, places array<int>"
POSTING = f"{_POSTINGS}, segment int, bucket int"
_PIECE = r"[ -~]+"
_SPOT = "struct<field:int,place:int>"
_FIELDS = [name for name, _ in WEIGHTED_FIELDS]


def bucket_of(term: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


# --- postings of a block ----------------------------------------------------


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours starts."""
    return np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indexes ``start .. start + count - 1`` of every span, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def _word_entries(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(words, code, row, place) of all words, places running on from field to field."""
    words, owners, fields = [], [], []
    for number, name in enumerate(_FIELDS):
        pieces = pc.split_pattern(rows.column(name).combine_chunks(), " ")
        flat, owner = pc.list_flatten(pieces), pc.list_parent_indices(pieces)
        kept = pc.not_equal(flat, "")
        words.append(flat.filter(kept))
        owners.append(owner.filter(kept).to_numpy(zero_copy_only=False).astype(np.int64))
        fields.append(np.full(len(words[-1]), number, np.int64))
    owner, field = np.concatenate(owners), np.concatenate(fields)
    coded = pa.chunked_array(words, pa.string()).combine_chunks().dictionary_encode()
    order = np.argsort(owner, kind="stable")  # a listing's words in the order of its fields
    owner, field = owner[order], field[order]
    starts = _runs(owner)
    lengths = np.diff(np.r_[starts, len(owner)])
    place = np.arange(len(owner)) - np.repeat(starts, lengths)
    return coded.dictionary, coded.indices.to_numpy()[order].astype(np.int64), owner, place * 8 + field


def _gram_entries(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(grams, code, row, no places) of all three-letter grams, by code points."""
    titles = rows.column("lowered").combine_chunks().fill_null("")
    sizes = pc.utf8_length(titles).to_numpy().astype(np.int64)
    letters = np.frombuffer("".join(titles.to_pylist()).encode("utf-32-le"), "<u4").astype(np.int64)
    counts = np.maximum(sizes - 2, 0)
    first = _spans(np.cumsum(sizes) - sizes, counts)
    packed = (letters[first] << 42) | (letters[first + 1] << 21) | letters[first + 2] if len(first) else first
    known, code = np.unique(packed, return_inverse=True)
    text = ["".join(map(chr, (n >> 42, n >> 21 & 0x1FFFFF, n & 0x1FFFFF))) for n in known.tolist()]
    return pa.array(text, pa.string()), code, np.repeat(np.arange(len(sizes)), counts), np.zeros(len(first), np.int64)


class _Postings:
    """Postings of a block in order of (term, listing, side), places end to end."""

    def __init__(self, entries: tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray], sides: np.ndarray, listing: np.ndarray, with_places: bool):
        self.terms, code, row, place = entries
        n = max(int(listing.max()) + 1, 1)
        keys = (code * n + listing[row]) * 2 + sides[row]
        order = np.argsort(keys, kind="stable")
        keys, self.places = keys[order], place[order] if with_places else np.zeros(0, np.int64)
        starts = _runs(keys)
        keys = keys[starts]
        self.sizes = np.diff(np.r_[starts, len(order)]) if with_places else np.zeros(len(keys), np.int64)
        self.term, self.listing, self.side = keys // (2 * n), keys // 2 % n, keys % 2

    def changed(self) -> np.ndarray:
        """What a reader must learn: the side after, where it differs from the one before, and the side before alone."""
        begins = np.cumsum(self.sizes) - self.sizes
        twin = np.flatnonzero((self.term[1:] == self.term[:-1]) & (self.listing[1:] == self.listing[:-1]))
        even = twin[self.sizes[twin] == self.sizes[twin + 1]]
        counts = self.sizes[even]
        apart = self.places[_spans(begins[even], counts)] != self.places[_spans(begins[even + 1], counts)]
        same = np.bincount(np.repeat(np.arange(len(even)), counts)[apart], minlength=len(even)) == 0
        kept = np.ones(len(self.term), bool)
        kept[twin] = False
        kept[even[same] + 1] = False
        return np.flatnonzero(kept)


def _block_rows(kind: str, terms: pa.Array, term, ids, sizes, places, block: int, blocks: int) -> pa.Table:
    """Rows of ``_POSTINGS`` from postings in order of (term, listing)."""
    starts = _runs(term)
    held = np.maximum(sizes, 0)
    ends = np.r_[0, np.cumsum(held)]
    cuts = np.r_[starts, len(term)]
    n = len(starts)

    def lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))

    return pa.table(
        {
            "kind": pa.array([kind] * n, pa.string()), "term": terms.take(pa.array(term[starts], pa.int64())),
            "block": pa.array(np.full(n, block), pa.int32()), "blocks": pa.array(np.full(n, blocks), pa.int32()),
            "ids": lists(cuts, ids, pa.int64()), "sizes": lists(cuts, sizes, pa.int32()),
            "places": lists(ends[cuts], places, pa.int32()),
        }
    )


def _made(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The postings of a block's listings; of those that are there before and after, what changed."""
    block, blocks = (k.as_py() for k in key)
    ids, listing = np.unique(rows.column("id").to_numpy(), return_inverse=True)
    sides = rows.column("side").to_numpy().astype(np.int64)
    parts = []
    for kind, entries in ((WORD, _word_entries(rows)), (GRAM, _gram_entries(rows))):
        every = _Postings(entries, sides, listing, kind == WORD)
        kept = every.changed()
        begins = np.cumsum(every.sizes) - every.sizes
        sizes = np.where(every.side[kept] == 0, -1, every.sizes[kept])
        places = every.places[_spans(begins[kept], np.maximum(sizes, 0))]
        parts.append(_block_rows(kind, every.terms, every.term[kept], ids[every.listing[kept]], sizes, places, block, blocks))
    return pa.concat_tables(parts)


def _lines(listings: DataFrame, side: int) -> DataFrame:
    """What postings are made of: the words of each field and the title in lower case."""
    words = [words_line(F.col(name)).alias(name) for name in _FIELDS]
    return listings.select(F.col("id").cast("long").alias("id"), F.lit(side).alias("side"), *words, F.lower("title").alias("lowered"))


def _blocks(lines: DataFrame, blocks: int) -> DataFrame:
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = lines.withColumns({"block": block, "blocks": F.lit(blocks)})
    return dealt.groupBy("block", "blocks").applyInArrow(_made, _POSTINGS)


def _blocks_for(listings: DataFrame) -> int:
    return max(1, -(-listings.count() // BLOCK_LISTINGS))


def _one_by_one(rows: DataFrame) -> DataFrame:
    """(kind, term, id, spots) of rows of blocks; a term that went has null ``spots``."""

    def opened(batches):
        for batch in batches:
            lists = batch.column(2)
            owner = pc.list_parent_indices(lists)
            sizes = pc.list_flatten(batch.column(3)).to_numpy(zero_copy_only=False)
            places = pc.list_flatten(batch.column(4)).to_numpy(zero_copy_only=False)
            spots = pa.StructArray.from_arrays(
                [pa.array(places % 8, pa.int32()), pa.array(places // 8, pa.int32())], names=["field", "place"]
            )
            offsets = pa.array(np.r_[0, np.cumsum(np.maximum(sizes, 0))], pa.int32(), mask=np.r_[sizes < 0, False])
            columns = [batch.column(0).take(owner), batch.column(1).take(owner), pc.list_flatten(lists)]
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(offsets, spots)], names=["kind", "term", "id", "spots"])

    chosen = rows.select("kind", "term", "ids", "sizes", "places")
    return chosen.mapInArrow(opened, f"kind string, term string, id long, spots array<{_SPOT}>")


def postings(listings: DataFrame) -> DataFrame:
    """(kind, term, id, spots) of every listing; one row per term and listing, ids must be distinct and not null."""
    return _one_by_one(_blocks(_lines(listings, 1), _blocks_for(listings)))


# --- storing ----------------------------------------------------------------


def _stored(rows: DataFrame, path: str, segment: int, buckets: int) -> None:
    """One segment, replaced if it was begun before; a bucket of many rows is divided over files."""
    placed = rows.withColumn("bucket", bucket_of(F.col("term"), buckets)).hint("rebalance", "bucket")
    laid = placed.sortWithinPartitions("bucket", "kind", "term", "block")
    writer = laid.write.mode("overwrite").option("parquet.writer.version", "PARQUET_2_0")
    writer.partitionBy("bucket").parquet(f"{path}/segment={segment}")


def write_index(listings: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The index of all listings as segment 0 of a new folder."""
    _stored(_blocks(_lines(listings, 1), _blocks_for(listings)), path, 0, buckets)


def add_changes(before: DataFrame, after: DataFrame, path: str, segment: int, buckets: int = BUCKETS) -> None:
    """Appends a segment (1 and up, in the order of the changes) for listings that were inserted, altered or removed.

    ``before`` lacks listings that are new, ``after`` those that are gone; others may be in both.  Stored are the postings
    that differ.
    """
    if segment < 1:
        raise ValueError("segment 0 is the index as it was written")
    known = read_index(before.sparkSession, path).select("blocks").first()  # the same in every segment
    lines = _lines(before, 0).unionByName(_lines(after, 1))
    _stored(_blocks(lines, known.blocks if known else _blocks_for(after)), path, segment, buckets)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return prepare(spark).read.schema(POSTING).parquet(path)


def _merged(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The newest posting of each term and listing of a block, without those that went."""
    block, blocks = (k.as_py() for k in key)
    parts = []
    for kind in (WORD, GRAM):
        some = rows.filter(pc.equal(rows.column("kind"), kind)).combine_chunks()
        coded = some.column("term").combine_chunks().dictionary_encode()
        lists = some.column("ids").combine_chunks()
        owner = pc.list_parent_indices(lists).to_numpy()
        ids, listing = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
        sizes = pc.list_flatten(some.column("sizes").combine_chunks()).to_numpy().astype(np.int64)
        places = pc.list_flatten(some.column("places").combine_chunks()).to_numpy()
        held = np.maximum(sizes, 0)
        begins = np.cumsum(held) - held
        segment = some.column("segment").to_numpy().astype(np.int64)
        keys = coded.indices.to_numpy().astype(np.int64)[owner] * max(len(ids), 1) + listing
        order = np.lexsort((segment[owner], keys)) if len(np.unique(segment)) > 1 else np.argsort(keys, kind="stable")
        starts = _runs(keys[order])
        newest = order[np.r_[starts[1:], len(order)] - 1] if len(order) else order
        newest = newest[sizes[newest] >= 0]
        term = keys[newest] // max(len(ids), 1)
        taken = places[_spans(begins[newest], held[newest])]
        parts.append(_block_rows(kind, coded.dictionary, term, ids[listing[newest]], sizes[newest], taken, block, blocks))
    return pa.concat_tables(parts)


def merged(stored: DataFrame) -> DataFrame:
    """Rows of blocks with the newest posting of each term and listing; each block is merged by itself."""
    return stored.drop("bucket").groupBy("block", "blocks").applyInArrow(_merged, _POSTINGS)


def compacted(stored: DataFrame) -> DataFrame:
    """The whole index as one segment's postings; equal to ``postings`` of the listings as they are now."""
    return _one_by_one(merged(stored))


def write_compacted(stored: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """The index in one segment, in a new folder; it keeps its number of blocks."""
    _stored(merged(stored), path, 0, buckets)


def of_terms(stored: DataFrame, kind: str, terms: Iterable[str], buckets: int = BUCKETS) -> DataFrame:
    """The newest postings of some terms; only their buckets' files are read."""
    asked = sorted(set(terms))
    places = [bucket_of(F.lit(term), buckets) for term in asked]
    return compacted(stored.filter((F.col("kind") == kind) & F.col("term").isin(asked) & F.col("bucket").isin(places)))


# --- searching ------------------------------------------------------------


def answers(text: str) -> bool:
    """Whether the index can answer: each alternative names a wanted word (excluded ones alone match nearly all rows)."""
    groups = alternatives(text)
    return bool(groups) and all(any(not t.negated for t in group) for group in groups)


def _starts(spots: Column, phrase: str, in_field: bool) -> Column:
    """The places where a phrase starts, from the map of each word's places."""
    words = phrase.split(" ")

    def of(word: str) -> Column:
        return F.coalesce(F.try_element_at(spots, F.lit(word)), F.array().cast("array<struct<field:int,place:int>>"))

    def follows(start: Column, k: int) -> Column:
        def there(spot: Column) -> Column:
            here = spot["place"] == start["place"] + k
            return here & (spot["field"] == start["field"]) if in_field else here

        return F.exists(of(words[k]), there)

    if len(words) == 1:
        return of(phrase)
    return F.filter(of(words[0]), lambda s: reduce(lambda a, b: a & b, [follows(s, k) for k in range(1, len(words))]))


def _counted(starts: Column, phrase: str) -> Column:
    """Occurrences that do not overlap, from the left."""
    words = phrase.split(" ")
    if not any(words[k:] == words[:-k] for k in range(1, len(words))):
        return F.size(starts)
    none = F.struct(F.lit(-1).alias("free"), F.lit(0).alias("n"))
    counted = F.aggregate(
        starts,
        none,
        lambda seen, s: F.when(
            s["place"] >= seen["free"], F.struct((s["place"] + len(words)).alias("free"), (seen["n"] + 1).alias("n"))
        ).otherwise(seen),
    )
    return counted["n"]


def _holds(spots: Column, term: Term) -> Column:
    found = F.size(_starts(spots, term.phrase, in_field=False)) > 0
    return ~found if term.negated else found


def _rank(spots: Column, groups: list[list[Term]]) -> Column:
    """``textsearch.rank`` from places, added up in the same order."""
    wanted = list(dict.fromkeys(t.phrase for group in groups for t in group if not t.negated))

    def of_field(phrase: str, number: int) -> Column:
        return F.filter(_starts(spots, phrase, in_field=True), lambda s: s["field"] == number)

    total = F.lit(0.0)
    for number, (_, weight) in enumerate(WEIGHTED_FIELDS):
        for phrase in wanted:
            total = total + _counted(of_field(phrase, number), phrase).cast("double") * F.lit(weight)
    return total


def word_hits(stored: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """(id, matches, rank) of every listing with a word of the text, as ``textsearch.matches`` and ``rank`` give them."""
    groups = alternatives(text)
    terms = {word for group in groups for t in group for word in t.phrase.split(" ")}
    entry = F.struct("term", "spots")
    places = of_terms(stored, WORD, terms, buckets).groupBy("id").agg(F.map_from_entries(F.collect_list(entry)).alias("spots"))
    spots = F.col("spots")
    held = [reduce(lambda a, b: a & b, [_holds(spots, t) for t in group]) for group in groups]
    return places.select("id", reduce(lambda a, b: a | b, held).alias("matches"), _rank(spots, groups).alias("rank"))


def _grams_of(text: str) -> set[str]:
    """Grams that every title holding the text must have; wildcards, escapes and letters beyond ASCII give none."""
    pieces = [run for part in re.split(r"[%_\\]", text) for run in re.findall(_PIECE, part)]
    return {piece[k : k + 3].lower() for piece in pieces for k in range(len(piece) - 2)}


def indexed_text(listings: DataFrame, stored: DataFrame, text: str, buckets: int = BUCKETS) -> DataFrame:
    """The listings that ``search.text_predicate`` keeps, with their text rank, found through the index.

    Postings are read for the words asked for and, for the match inside a title, for the title grams of the text; the
    titles of what these leave are then compared.  A text whose index cannot help (see ``answers``) is compared row by row.
    """
    in_title = F.coalesce(F.col("title").ilike(title_pattern(text)), F.lit(False))
    if not answers(text):
        kept = listings.filter(textsearch.matches(text, textsearch.listing_line()) | in_title)
        return kept.withColumn(RANK, textsearch.rank(text))
    hits = word_hits(stored, text, buckets)
    grams = _grams_of(text)
    if grams:
        some = of_terms(stored, GRAM, grams, buckets).groupBy("id").agg(F.count("term").alias("n"))
        titled = some.filter(F.col("n") == len(grams)).select("id", F.lit(True).alias("titled"))
        found = hits.join(titled, "id", "full").filter(F.col("matches") | F.col("titled"))
        rows = listings.join(found, "id")
    else:
        rows = listings.join(hits, "id", "left")
    kept = rows.filter(F.coalesce("matches", F.lit(False)) | in_title)
    return kept.withColumn(RANK, F.coalesce("rank", F.lit(0.0))).select(*listings.columns, RANK)


def indexed_filters(listings: DataFrame, stored: DataFrame, query: SearchQuery, now: Column, buckets: int = BUCKETS) -> DataFrame:
    """``search.apply_filters`` with the text answered from the index, and the text rank."""
    rest = replace(query, text=None)
    return indexed_text(apply_filters(listings, rest, now), stored, query.words, buckets)


def indexed_page(listings: DataFrame, stored: DataFrame, query: SearchQuery, now: Column, buckets: int = BUCKETS) -> DataFrame:
    """``search.search_page`` with the text answered from the index."""
    rows = query.page.rows
    ordered = indexed_filters(listings, stored, query, now, buckets).orderBy(*sort_order(query, now))
    return ordered.offset(rows.start).limit(len(rows)).drop(RANK)
