"""Duplicates and re-auctions: which listings are one asset, and which are one event.

The job keeps its work near the size of its answer:

* listings that agree in every compared attribute are folded into one *profile*
  with a member count before anything is shuffled by key, so a large group of
  copies costs one comparison, and its inner pairs are counted, not produced;
* profiles meet only on shared blocking keys, and a pair sharing several keys is
  kept at the first of them, so no distinct step over pairs is needed;
* a key with many profiles is laid out over a triangle of cells, each cell one
  bounded piece of work;
* pairs are met and scored in Arrow batches (``pair_blocks``), and only what is
  asked for leaves the task.  ``candidate_pairs`` and ``scored_pairs`` give the
  same pairs by Spark's own join, where columns of both sides are wanted.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal as D
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.money import price_change
from lotwise.operators import pair_blocks
from lotwise.operators.ordered import hot_keys, with_previous
from lotwise.session import saved

# Thresholds of the verdict and weights of the asset's attributes.
DUPLICATE_FROM = 0.85
REVIEW_FROM = 0.65
REAUCTION_GAP_DAYS = 25
WEIGHTS = {"address": 0.40, "area": 0.20, "locality": 0.15, "city": 0.15, "pincode": 0.10}
SAME_PRICE_BONUS = 0.10
NEAR_IDENTICAL_ADDRESS = 0.8
#: By how much the bound of a pair's score may be off; far above the rounding of its few additions.
ROUNDING = 1e-9

# Address words that carry no signal.
STOP_WORDS = (
    "no", "plot", "flat", "house", "property", "near", "opp", "opposite", "road", "street",
    "nagar", "colony", "society", "village", "taluka", "district", "dist", "the", "at", "in",
    "and", "of", "part", "block", "ward", "survey", "old", "new",
)

KEY_KINDS = ("asset", "geo", "pin", "pinprice", "addr")
KEY = ("asset_class", "key")
#: Profiles of one key handled by one join task on each side.
CELL_ROWS = 4_000

COMPARED = (
    "asset_class", "asset_key", "state", "city", "pincode", "area_sqft", "reserve_price",
    "auction_start_at", "address_words", "has_locality", "locality_words",
)
#: The same with words joined by blanks, which are as equal as the words are: narrower where rows are shuffled.
TEXTS = {"address_words": "address", "locality_words": "locality"}
COMPARED_TEXTS = tuple(TEXTS.get(name, name) for name in COMPARED)
CELL = (*KEY, "cell_row", "cell_column")
RULES = pair_blocks.Rules(WEIGHTS, SAME_PRICE_BONUS, REVIEW_FROM, DUPLICATE_FROM, NEAR_IDENTICAL_ADDRESS, REAUCTION_GAP_DAYS)


def address_words(text: Column) -> Column:
    """Distinct words of an address in order, stop words removed; empty array for nothing."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " ")
    # The set difference drops stop words, blanks and repeats in one pass.
    return F.array_sort(F.array_except(F.split(plain, " "), F.array(F.lit(""), *[F.lit(word) for word in STOP_WORDS])))


def normalise_address(text: Column) -> Column:
    return F.array_join(address_words(text), " ")


def token_similarity(left: Column, right: Column) -> Column:
    """Jaccard overlap of two sets of words, 0 when either is empty."""
    shared = F.size(F.array_intersect(left, right)).cast("double")
    either = F.size(left) + F.size(right) - shared
    return F.when((F.size(left) == 0) | (F.size(right) == 0), 0.0).otherwise(shared / either)


def _given(name: str) -> Column:
    """Present in the sense of the comparison rules: blank text and zero count as missing."""
    zero = F.lit("") if name not in ("area_sqft", "reserve_price") else F.lit(0)
    return F.col(name).isNotNull() & (F.col(name) != zero)


def _hundreds(name: str, width: int) -> Column:
    return (F.col(name) / F.lit(width)).cast("long")


def _bucket(name: str, width: int) -> Column:
    return _hundreds(name, width).cast("string")


def blocking_keys(words: Column) -> list[Column]:
    """One nullable key per kind, in the order of KEY_KINDS; a missing state is spelt ``None``."""
    colon = F.lit(":")
    lakh = _bucket("reserve_price", 100_000)
    return [
        F.when(_given("asset_key"), F.concat(F.lit("asset:"), F.col("asset_key"))),
        F.when(
            _given("city") & _given("reserve_price"),
            F.concat(F.lit("geo:"), F.coalesce("state", F.lit("None")), colon, F.col("city"), colon, lakh),
        ),
        F.when(
            _given("pincode") & _given("area_sqft"),
            F.concat(F.lit("pin:"), F.col("pincode"), colon, _bucket("area_sqft", 100)),
        ),
        F.when(
            _given("pincode") & _given("reserve_price"),
            F.concat(F.lit("pinprice:"), F.col("pincode"), colon, lakh),
        ),
        F.when(F.size(words) >= 3, F.concat(F.lit("addr:"), F.array_join(F.slice(words, 1, 4), "|"))),
    ]


def features(listings: DataFrame) -> DataFrame:
    """Per listing: id and the attributes that decide a verdict."""
    blank_as_null = [F.nullif(F.col(c), F.lit("")).alias(c) for c in ("asset_key", "city", "pincode")]
    return listings.select(
        "id", "asset_class", "state", "area_sqft", "reserve_price", "auction_start_at", *blank_as_null,
        address_words(F.col("address")).alias("address_words"),
        F.coalesce(F.col("locality") != "", F.lit(False)).alias("has_locality"),
        address_words(F.col("locality")).alias("locality_words"),
    )


def _with_keys(rows: DataFrame) -> DataFrame:
    keys = blocking_keys(F.col("address_words"))
    return rows.withColumns({f"k{i}": key for i, key in enumerate(keys)})


def texts(listings: DataFrame) -> DataFrame:
    """``features`` with the words of each set joined by blanks."""
    return features(listings).select(
        "id", *[F.array_join(c, " ").alias(TEXTS[c]) if c in TEXTS else F.col(c) for c in COMPARED]
    )


def folds(listings: DataFrame, first_ids: Column | None = None) -> DataFrame:
    """Listings folded by equal attributes: profile_id (least id), members, members among the first ids; words as texts."""
    within = F.lit(True) if first_ids is None else F.col("id") <= first_ids
    return texts(listings).groupBy(*COMPARED_TEXTS).agg(
        F.min("id").alias("profile_id"), F.count(F.lit(1)).alias("members"), F.count_if(within).alias("leading")
    )


def _words_of(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def profiles(listings: DataFrame, first_ids: Column | None = None) -> DataFrame:
    """``folds`` with the words as arrays and the blocking keys."""
    back = [_words_of(F.col(TEXTS[c])).alias(c) if c in TEXTS else F.col(c) for c in COMPARED]
    return _with_keys(folds(listings, first_ids).select(*back, "profile_id", "members", "leading"))


def _word_marks(words: Column) -> Column:
    """64 bits, one set per word by its hash."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda bits, word: bits.bitwiseOR(_bit(F.pmod(F.hash(word), F.lit(64)))))


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def with_marks(rows: DataFrame) -> DataFrame:
    """Adds the numbers by which ``may_match`` judges a pair without looking at words; rows that have them keep them."""
    marks = {
        "address_marks": _word_marks(F.col("address_words")),
        "address_count": F.size("address_words"),
        "locality_marks": F.when(F.col("has_locality"), _word_marks(F.col("locality_words"))),
        "locality_count": F.size("locality_words"),
        "city_mark": F.when(F.col("city").isNotNull(), F.hash(F.lower("city"))),
        "area": F.nullif(F.col("area_sqft"), F.lit(0)).cast("double"),
    }
    if "address_marks" in rows.columns:
        lacking = F.col("address_marks").isNull()
        marks = {name: F.when(lacking, mark).otherwise(F.col(name)) for name, mark in marks.items()}
    return rows.withColumns(marks)


def profile_members(listings: DataFrame, folded: DataFrame) -> DataFrame:
    """(id, profile_id) of every listing, to widen profile pairs where single listings are wanted.

    Joined on one hash of the compared attributes.  Where no two profiles share a hash it names the profile, and nothing
    else is shuffled; else the attributes are held against each other too.
    """
    hashed = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in COMPARED_TEXTS]).alias("_hash")
    rows, known = texts(listings).select("*", hashed), _narrow(folded).select("*", hashed)
    met = F.col("a._hash") == F.col("b._hash")
    if known.groupBy("_hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).isEmpty():
        rows, known = rows.select("id", "_hash"), known.select("profile_id", "_hash")
    else:
        met = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in COMPARED_TEXTS], met)
    return rows.alias("a").join(known.alias("b"), met).select("a.id", "b.profile_id")


def _narrow(folded: DataFrame) -> DataFrame:
    """``folds`` of ``profiles``, or of rows that are folds already; other columns are kept."""
    if "address" in folded.columns:
        return folded
    return folded.withColumns({text: F.array_join(words, " ") for words, text in TEXTS.items()})


# --- scoring --------------------------------------------------------------


def _both(a: str, b: str, name: str) -> Column:
    return F.col(f"{a}.{name}").isNotNull() & F.col(f"{b}.{name}").isNotNull()


def _with_exact_sums(rows: DataFrame, sums: dict[str, list[Column]]) -> DataFrame:
    """Add each sum, carrying the rounding error of every step so scores on a threshold fall on the right side.

    Steps are columns of their own: plain arithmetic stays in generated code, and no step is worked out twice.
    """
    terms = {f"_{name}_{i}": term for name, parts in sums.items() for i, term in enumerate(parts)}
    rows = rows.withColumns(terms).withColumns({f"_{name}_s0": F.col(f"_{name}_0") for name in sums})
    steps = range(1, max(map(len, sums.values())))
    for i in steps:
        rows = rows.withColumns({f"_{name}_s{i}": F.col(f"_{name}_s{i - 1}") + F.col(f"_{name}_{i}") for name in sums})

    def lost(name: str, i: int) -> Column:
        before, term, whole = F.col(f"_{name}_s{i - 1}"), F.col(f"_{name}_{i}"), F.col(f"_{name}_s{i}")
        return F.when(F.abs(before) >= F.abs(term), (before - whole) + term).otherwise((term - whole) + before)

    return rows.withColumns(
        {name: F.col(f"_{name}_s{steps[-1]}") + reduce(lambda x, y: x + y, [lost(name, i) for i in steps]) for name in sums}
    )


def with_similarity(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Add ``score`` and ``reasons``: how likely the rows aliased ``a`` and ``b`` are one asset.

    Price and date are left out on purpose: they differ between rounds of one asset.
    An equal price only adds.  No address overlap drops the address from the mean.
    The set overlaps are worked out once per pair.
    """

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    area_a, area_b = col(a, "area_sqft").cast("double"), col(b, "area_sqft").cast("double")
    nearness = F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(area_a - area_b) / F.greatest(area_a, area_b) * 5)
    same_city = F.when(F.lower(col(a, "city")) == F.lower(col(b, "city")), 1.0).otherwise(0.0)
    same_pin = F.when(col(a, "pincode") == col(b, "pincode"), 1.0).otherwise(0.0)
    both_localities = col(a, "has_locality") & col(b, "has_locality")
    overlap = F.struct(
        token_similarity(col(a, "address_words"), col(b, "address_words")).alias("_overlap"),
        F.when(both_localities, token_similarity(col(a, "locality_words"), col(b, "locality_words"))).alias("_locality"),
    )
    # A one-row inline keeps the overlaps from being copied into every later use of them:
    # a filter on the score would otherwise be pushed down with the whole formula unfolded.
    overlaps = pairs.select("*", F.inline(F.array(overlap)))
    parts = {
        "address": F.when(F.col("_overlap") > 0, F.col("_overlap")),
        "area": F.when((area_a != 0) & (area_b != 0), nearness),
        "locality": F.col("_locality"),
        "city": F.when(_both(a, b, "city"), same_city),
        "pincode": F.when(_both(a, b, "pincode"), same_pin),
    }
    measured = overlaps.withColumns({f"_{name}_part": part for name, part in parts.items()})
    named = [(F.col(f"_{name}_part"), WEIGHTS[name]) for name in parts]
    measured = _with_exact_sums(
        measured,
        {
            "_gained": [F.coalesce(part * F.lit(weight), F.lit(0.0)) for part, weight in named],
            "_weighed": [F.when(part.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0)) for part, weight in named],
        },
    )
    price_a, price_b = col(a, "reserve_price"), col(b, "reserve_price")
    averaged = measured.withColumns(
        {
            "_mean": F.col("_gained") / F.nullif(F.col("_weighed"), F.lit(0.0)),
            "_same_price": F.coalesce((price_a != 0) & (price_a == price_b), F.lit(False)),
            "_same_asset": F.coalesce(col(a, "asset_key") == col(b, "asset_key"), F.lit(False)),
        }
    )
    mean = F.col("_mean")
    lifted = F.col("_same_price") & mean.isNotNull()
    score = (
        F.when(F.col("_same_asset"), 1.0)
        .when(lifted, F.least(F.lit(1.0), mean + F.lit(SAME_PRICE_BONUS)))
        .otherwise(F.coalesce(mean, F.lit(0.0)))
    )
    reasons = _reasons(F.col("_same_asset"), F.col("_overlap") > NEAR_IDENTICAL_ADDRESS, lifted)
    # The same kind of inline keeps a filter on the score behind the steps above.
    told = F.struct(score.alias("score"), reasons.alias("reasons"))
    return averaged.select("*", F.inline(F.array(told)))


def _reasons(same_asset: Column, near_address: Column, lifted: Column) -> Column:
    told = [F.when(near_address, "near-identical address"), F.when(lifted, "identical reserve price")]
    return F.when(same_asset, F.array(F.lit("identical asset identifier"))).otherwise(F.array_compact(F.array(*told)))


def starts_differ(a: str, b: str) -> Column:
    """Both auction starts are known and not equal."""
    start_a, start_b = F.col(f"{a}.auction_start_at"), F.col(f"{b}.auction_start_at")
    return F.coalesce(start_a != start_b, F.lit(False))


def _a_is_earlier(a: str, b: str, id_name: str) -> Column:
    """By start when both are known (equal starts: smaller id), else by id."""
    by_id = F.col(f"{a}.{id_name}") <= F.col(f"{b}.{id_name}")
    by_start = F.col(f"{a}.auction_start_at") < F.col(f"{b}.auction_start_at")
    return F.when(starts_differ(a, b), by_start).otherwise(by_id)


def verdict(score: Column, a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """(relationship, extra reason) from the score and the gap between the two auctions."""
    start_a, start_b = F.col(f"{a}.auction_start_at"), F.col(f"{b}.auction_start_at")
    price_a, price_b = F.col(f"{a}.reserve_price"), F.col(f"{b}.reserve_price")
    a_first = start_a <= start_b
    gap = F.make_dt_interval(F.lit(REAUCTION_GAP_DAYS))
    later_round = start_a.isNotNull() & start_b.isNotNull() & (
        F.greatest(start_a, start_b) - F.least(start_a, start_b) >= gap
    )
    relationship = (
        F.when(score < REVIEW_FROM, "distinct")
        .when(later_round, "reauction")
        .when(score >= DUPLICATE_FROM, "duplicate")
        .otherwise("review")
    )
    before, after = F.when(a_first, price_a).otherwise(price_b), F.when(a_first, price_b).otherwise(price_a)
    return relationship, _later_round(relationship, before, after)


def _later_round(relationship: Column, before: Column, after: Column) -> Column:
    """What a re-auction's reserve price tells; null for other relationships."""
    cut = F.bround((F.lit(1) - after / F.nullif(before, F.lit(0).cast("decimal(18,2)"))) * 100, 0).cast("int")
    cheaper = F.coalesce((before != 0) & (after != 0) & (after < before), F.lit(False))
    return F.when(
        relationship == "reauction",
        F.when(
            cheaper, F.concat(F.lit("re-auction "), cut.cast("string"), F.lit("% below previous reserve"))
        ).otherwise("later auction round"),
    )


def may_match(a: str = "a", b: str = "b") -> Column:
    """False only for pairs whose score is below REVIEW_FROM for certain; rows come from ``with_marks``.

    A mean reaches a threshold where its parts' weighted distances from it add to 0 or more.  Words that set a bit which
    the other side has not set are not shared, so counts and bits bound an overlap from above.  An address without
    overlap is left out of the mean and adds 0.  Every term stands once: the whole is one condition inside the join.
    """

    def col(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    def own(name: str, x: str, y: str) -> Column:
        bits = col(x, f"{name}_marks").bitwiseAND(F.bitwise_not(col(y, f"{name}_marks")))
        return col(x, f"{name}_count") - F.bit_count(bits)

    def overlap(name: str) -> Column:
        both = col(a, f"{name}_count") + col(b, f"{name}_count")
        shared = F.least(own(name, a, b), own(name, b, a))
        return both.cast("double") / F.greatest(both - shared, F.lit(1)).cast("double") - F.lit(1.0)

    def distance(name: str, value: Column) -> Column:
        return (value - F.lit(REVIEW_FROM)) * F.lit(WEIGHTS[name])

    def where_known(name: str, column: str, value: Column) -> Column:
        return F.when(_both(a, b, column), distance(name, value)).otherwise(F.lit(0.0))

    def equal(name: str) -> Column:
        return F.when(col(a, name) == col(b, name), 1.0).otherwise(0.0)

    gap = F.abs(col(a, "area") - col(b, "area")) / F.greatest(col(a, "area"), col(b, "area"))
    total = (
        F.greatest(F.lit(0.0), distance("address", overlap("address")))
        + where_known("area", "area", F.greatest(F.lit(0.0), F.lit(1.0) - gap * 5))
        + where_known("locality", "locality_marks", F.greatest(F.lit(0.0), overlap("locality")))
        + where_known("city", "city_mark", equal("city_mark"))
        + where_known("pincode", "pincode", equal("pincode"))
    )
    # All weights add to 1, so an equal price lifts the sum by its bonus at most.
    same_price = col(a, "reserve_price") == col(b, "reserve_price")
    least = F.when(same_price, -SAME_PRICE_BONUS - ROUNDING).otherwise(-ROUNDING)
    return (total >= least) | F.coalesce(col(a, "asset_key") == col(b, "asset_key"), F.lit(False))


# --- pairs ----------------------------------------------------------------


def _busy(folded: DataFrame, cell_rows: int) -> DataFrame:
    """Keys to be cut and their ``_rows``, written first: where Spark knows the list's size it need not shuffle the rows."""
    kinds = F.array(*[F.col(f"k{i}") for i in range(len(KEY_KINDS))])
    return saved(hot_keys(folded.select("asset_class", F.explode(F.array_compact(kinds)).alias("key")), KEY, cell_rows))


def _spread(folded: DataFrame, cell_rows: int, busy: DataFrame | None = None) -> DataFrame:
    """One row per (profile, key) with the number of slices its key is cut into."""
    joined = keyed(folded).join(_busy(folded, cell_rows) if busy is None else busy, list(KEY), "left")
    slices = F.coalesce(F.ceil(F.col("_rows") / cell_rows).cast("int"), F.lit(1))
    return (
        joined.withColumn("slices", slices)
        .withColumn("slice", F.pmod(F.xxhash64("profile_id"), F.col("slices")).cast("int"))
        .drop("_rows")
    )


def keyed(folded: DataFrame) -> DataFrame:
    """One row per (profile, key), with the kind of the key; of the other keys only those of earlier kinds are carried."""
    kinds = F.array(*[F.col(f"k{i}") for i in range(len(KEY_KINDS))])
    rows = folded.select("*", F.posexplode(kinds).alias("kind", "key")).filter(F.col("key").isNotNull())
    return rows.withColumns({f"k{i}": F.when(F.col("kind") > i, F.col(f"k{i}")) for i in range(len(KEY_KINDS))})


def earlier_kind() -> Column:
    """Rows ``a`` and ``b`` share a key of an earlier kind too, and meet there."""
    return reduce(
        lambda x, y: x | y,
        [
            (F.col("a.kind") > i) & F.coalesce(F.col(f"a.k{i}") == F.col(f"b.k{i}"), F.lit(False))
            for i in range(len(KEY_KINDS) - 1)
        ],
    )


def leading_pairs(folded: DataFrame) -> DataFrame:
    """The candidate pairs that have a member among the first ids: profiles holding one (``a``) meet all others.

    No pair of two other profiles is worked out, so the work grows with the first ids times the size of their keys.
    The small side is written first, so Spark knows its size and need not shuffle the large one.
    """
    rows = keyed(with_marks(folded))
    a, b = saved(rows.filter(F.col("leading") > 0)).alias("a"), rows.alias("b")
    ids = F.col("a.profile_id"), F.col("b.profile_id")
    once = (F.col("b.leading") == 0) | (ids[0] < ids[1]) | ((ids[0] == ids[1]) & (F.col("a.members") > 1))
    same = (F.col("a.asset_class") == F.col("b.asset_class")) & (F.col("a.key") == F.col("b.key"))
    return b.join(a, same & once & ~earlier_kind())


def candidate_pairs(folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Profile pairs (aliases ``a``, ``b``) sharing a key, each once; a profile meets itself if it has copies.

    Where no key is busy the rows are shuffled once: both sides ask for the same columns, so they share the shuffle.
    Save ``folded`` if it is costly: the busy keys are worked out from it first.

    The triangle of cells: with s slices a row takes the left part of its slice's row and the
    right part of its slice's column, s + 1 cells in all, and every pair meets in exactly one.
    """
    ids = F.col("a.profile_id"), F.col("b.profile_id")
    busy, marked = _busy(folded, cell_rows), with_marks(folded)
    if busy.isEmpty():
        rows = keyed(marked)
        # Written profiles look small: a key row each, five a profile, is more than a broadcast should hold.
        a, b = rows.alias("a"), rows.alias("b").hint("merge")
        same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEY, "kind")]
        once = (ids[0] < ids[1]) | ((ids[0] == ids[1]) & (F.least("a.members", "b.members") > 1))
        return a.join(b, reduce(lambda x, y: x & y, same) & once & ~earlier_kind())
    rows = _spread(marked, cell_rows, busy)
    left = rows.withColumn("cell_row", F.col("slice")).withColumn(
        "cell_column", F.explode(F.sequence(F.col("slice"), F.col("slices") - 1))
    )
    right = rows.withColumn("cell_column", F.col("slice")).withColumn(
        "cell_row", F.explode(F.sequence(F.lit(0), F.col("slice")))
    )
    a, b = left.alias("a"), right.alias("b")
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*KEY, "cell_row", "cell_column")]
    once = (
        (F.col("a.cell_row") != F.col("a.cell_column"))
        | (ids[0] < ids[1])
        | ((ids[0] == ids[1]) & (F.col("a.members") > 1))
    )
    return a.join(b, reduce(lambda x, y: x & y, met) & once & ~earlier_kind())


def block_columns(columns: list[str]) -> list[Column]:
    """What ``pair_blocks`` reads of key rows (``folds`` or ``profiles`` with ``kind`` and ``key``).

    Keys of earlier kinds are told by their parts: a place or pincode and a whole number, the last part of the key.
    """
    words = {text: F.col(text) if text in columns else F.array_join(name, " ").alias(text) for name, text in TEXTS.items()}
    price = F.nullif(F.col("reserve_price"), F.lit(0))
    return [
        *KEY, F.col("kind"), F.col("profile_id"), F.col("members"),
        (F.col("leading") if "leading" in columns else F.lit(0).cast("long")).alias("leading"),
        "asset_key", "pincode",
        F.when(F.col("city").isNotNull(), F.concat(F.coalesce("state", F.lit("None")), F.lit(":"), F.col("city"))).alias("place"),
        F.when(_given("reserve_price"), _hundreds("reserve_price", 100_000)).alias("lakh"),
        F.when(_given("area_sqft"), _hundreds("area_sqft", 100)).alias("hundreds"),
        F.unix_micros("auction_start_at").alias("start"),
        words["address"], words["locality"], "has_locality", F.lower("city").alias("city"),
        F.nullif(F.col("area_sqft"), F.lit(0)).cast("double").alias("area"), price.alias("price"),
    ]


#: What callers that ask for no score, or for no order either, need not shuffle.
SCORED_BY = ("address", "locality", "has_locality", "city", "area", "price")
ORDERED_BY = ("start",)


def _key_rows(folded: DataFrame) -> DataFrame:
    """One row per (profile, key) that can meet another, as ``pair_blocks`` reads it."""
    rows = _narrow(folded).filter(F.col("asset_class").isNotNull() & F.col("profile_id").isNotNull())
    keys = F.array(*blocking_keys(_words_of(F.col("address"))))
    spread = rows.select(*[c for c in rows.columns if c not in ("kind", "key")], F.posexplode(keys).alias("kind", "key"))
    return spread.filter(F.col("key").isNotNull()).select(*block_columns(spread.columns))


def _busy_of(rows: DataFrame, cell_rows: int) -> DataFrame | None:
    """The keys to be cut, written; None where there are none.  Hashes are counted first: mostly they answer alone."""
    hashed = F.xxhash64(*KEY).alias("_hash")
    sizes = saved(hot_keys(rows.select(hashed), ["_hash"], cell_rows).select("_hash"))
    if sizes.isEmpty():
        return None
    return saved(hot_keys(rows.select(*KEY, hashed).join(sizes, "_hash", "left_semi"), KEY, cell_rows))


def in_blocks(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """A function of ``pair_blocks`` over key rows with their cells and sides."""
    return rows.repartition(*CELL).sortWithinPartitions(*CELL, "side", "profile_id").mapInArrow(run, schema)


def _pairs_in_blocks(folded: DataFrame, run: Callable, schema: str, cell_rows: int, without: tuple[str, ...] = ()) -> DataFrame:
    """The candidate pairs of ``folds`` or ``profiles``, each once, through a function of ``pair_blocks``.

    With s slices a row of a busy key goes to s cells: as left row to those of its slice's row of the triangle, as
    right row to those of its column; on the diagonal it meets its own slice.
    """
    rows = _key_rows(folded).drop(*without)
    busy = _busy_of(rows, cell_rows)
    zero = F.lit(0).alias
    if busy is None:
        return in_blocks(rows.select("*", zero("cell_row"), zero("cell_column"), zero("side")), run, schema)
    joined = rows.join(busy, list(KEY), "left").withColumn("_slices", F.coalesce(F.ceil(F.col("_rows") / cell_rows).cast("int"), F.lit(1)))
    placed = joined.withColumn("_slice", F.pmod(F.xxhash64("profile_id"), F.col("_slices")).cast("int"))
    own, other = F.col("_slice"), F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))
    met = placed.select("*", other.alias("_other"))
    cells = met.withColumns(
        {
            "cell_row": F.least(own, F.col("_other")),
            "cell_column": F.greatest(own, F.col("_other")),
            "side": F.when(own == F.col("_other"), 0).when(own < F.col("_other"), 1).otherwise(2),
        }
    )
    return in_blocks(cells.drop("_rows", "_slices", "_slice", "_other"), run, schema)


def pair_ids(folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(low_id, high_id, pairs): the candidate pairs and the listing pairs they stand for."""
    schema = "low_id long, high_id long, pairs long"
    return _pairs_in_blocks(folded, pair_blocks.candidates(), schema, cell_rows, SCORED_BY + ORDERED_BY)


def pair_order(folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``time_order`` of the candidate pairs."""
    schema = "low_id long, high_id long, by_start boolean, earlier_id long, pairs long"
    return _pairs_in_blocks(folded, pair_blocks.ordered(), schema, cell_rows, SCORED_BY)


def pair_scores(folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(low_id, high_id, score to six digits, pairs) of the candidate pairs."""
    schema = "low_id long, high_id long, score double, pairs long"
    return _pairs_in_blocks(folded, pair_blocks.similarities(RULES), schema, cell_rows)


def matched_pairs(folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``scored_pairs`` of the pairs that are not distinct."""
    price = folded.schema["reserve_price"].dataType.simpleString()
    schema = (
        "earlier_id long, later_id long, earlier_members long, later_members long, by_start boolean, pairs long, "
        "leading_pairs long, score double, same_asset boolean, near_address boolean, lifted boolean, relationship string, "
        f"before {price}, after {price}"
    )
    found = _pairs_in_blocks(folded, pair_blocks.matches(RULES), schema, cell_rows)
    reasons = _reasons(F.col("same_asset"), F.col("near_address"), F.col("lifted"))
    extra = _later_round(F.col("relationship"), F.col("before"), F.col("after"))
    told = found.withColumn("reasons", reasons).select("*", _all_reasons(extra).alias("_told"))
    return told.withColumn("reasons", F.col("_told")).drop("same_asset", "near_address", "lifted", "before", "after", "_told")


def pair_tally(folded: DataFrame, cell_rows: int = CELL_ROWS, distinct: bool = False) -> DataFrame:
    """(relationship, pairs, leading_pairs) by task, to be summed; the candidate pairs that are distinct too if asked."""
    schema = "relationship string, pairs long, leading_pairs long"
    return _pairs_in_blocks(folded, pair_blocks.tallies(RULES, distinct), schema, cell_rows)


def _pair_counts() -> tuple[Column, Column]:
    """(listing pairs a profile pair stands for, those with a member among the first ids)."""

    def inner(n: Column) -> Column:
        return (n * (n - 1) / 2).cast("long")

    n_a, n_b = F.col("a.members"), F.col("b.members")
    l_a, l_b = F.col("a.leading"), F.col("b.leading")
    same = F.col("a.profile_id") == F.col("b.profile_id")
    every = F.when(same, inner(n_a)).otherwise(n_a * n_b)
    none_leading = F.when(same, inner(n_a - l_a)).otherwise((n_a - l_a) * (n_b - l_b))
    return every, every - none_leading


def time_order(met: DataFrame) -> DataFrame:
    """Candidate pairs by id, whether their starts give the order and, if so, the earlier profile; listing pairs."""
    every, _ = _pair_counts()
    ids, by_start = (F.col("a.profile_id"), F.col("b.profile_id")), starts_differ("a", "b")
    earlier = F.when(F.col("a.auction_start_at") < F.col("b.auction_start_at"), ids[0]).otherwise(ids[1])
    return met.select(
        F.least(*ids).alias("low_id"), F.greatest(*ids).alias("high_id"), by_start.alias("by_start"),
        F.when(by_start, earlier).alias("earlier_id"), every.alias("pairs"),
    )


def scored_pairs(folded: DataFrame, cell_rows: int = CELL_ROWS, keep_distinct: bool = False) -> DataFrame:
    """Verdict per profile pair: earlier and later profile and their members, whether their starts give the order
    (else each listing pair goes by its own ids), listing pairs, relationship, score, reasons."""
    return _scored(candidate_pairs(folded, cell_rows), keep_distinct)


def _scored(met: DataFrame, keep_distinct: bool = False) -> DataFrame:
    every, leading = _pair_counts()
    pairs = with_similarity(met if keep_distinct else met.filter(may_match()))
    if not keep_distinct:
        pairs = pairs.filter(F.col("score") >= REVIEW_FROM)
    relationship, extra = verdict(F.col("score"))
    first = _a_is_earlier("a", "b", "profile_id")
    return pairs.select(
        F.when(first, F.col("a.profile_id")).otherwise(F.col("b.profile_id")).alias("earlier_id"),
        F.when(first, F.col("b.profile_id")).otherwise(F.col("a.profile_id")).alias("later_id"),
        F.when(first, F.col("a.members")).otherwise(F.col("b.members")).alias("earlier_members"),
        F.when(first, F.col("b.members")).otherwise(F.col("a.members")).alias("later_members"),
        starts_differ("a", "b").alias("by_start"),
        every.alias("pairs"),
        leading.alias("leading_pairs"),
        relationship.alias("relationship"),
        "score",
        _all_reasons(extra),
    )


def _all_reasons(extra: Column) -> Column:
    told = F.col("reasons")
    return F.when(extra.isNotNull(), F.array_append(told, extra)).otherwise(told).alias("reasons")


def find_for(listings: DataFrame, listing_id: int) -> DataFrame:
    """Ranked matches of one listing that are not distinct.

    The one listing is a single row by construction and is the only side broadcast;
    the table is scanned once, without spreading keys.
    """
    one = _with_keys(features(listings.filter(F.col("id") == listing_id))).limit(1)
    a, b = F.broadcast(one).alias("a"), _with_keys(features(listings)).alias("b")
    shares = reduce(
        lambda x, y: x | y, [F.col(f"a.k{i}") == F.col(f"b.k{i}") for i in range(len(KEY_KINDS))]
    )
    met = (F.col("a.asset_class") == F.col("b.asset_class")) & (F.col("a.id") != F.col("b.id")) & shares
    relationship, extra = verdict(F.col("score"))
    return (
        with_similarity(b.join(a, met))
        .filter(F.col("score") >= REVIEW_FROM)
        .select(F.col("b.id").alias("other_id"), relationship.alias("relationship"), "score", _all_reasons(extra))
        .orderBy(F.col("score").desc(), F.col("other_id"))
    )


def scan(listings: DataFrame, limit: int | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Tally of relationships over all pairs, or over pairs touching the first ``limit`` ids.

    Reports only; nothing is merged.  ``compared`` counts matched pairs.
    """
    if limit:
        bound = listings.select("id").orderBy("id").limit(limit).agg(F.max("id")).scalar()
        found = _scored(leading_pairs(saved(profiles(listings, bound))))
    else:
        found = pair_tally(saved(folds(listings)), cell_rows)
    n = F.col("leading_pairs")

    def of(name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("relationship") == name, n)), F.lit(0)).alias(name)

    return found.agg(
        of("duplicate"), of("reauction"), of("review"), F.coalesce(F.sum(n), F.lit(0)).alias("compared")
    )


def tally_of_all(folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``tally`` over all candidate pairs, distinct ones too; those that cannot match are counted without a score."""
    return tally(pair_tally(folded, cell_rows, distinct=True))


def tally(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("relationship").agg(F.sum("pairs").alias("pairs"))


def rank_matches(pairs: DataFrame) -> DataFrame:
    """Profile matches seen from each side, with the members of the other; a profile of copies meets itself once."""

    def side(own: str, other: str) -> Column:
        return F.struct(
            F.col(f"{own}_id").alias("id"), F.col(f"{own}_members").alias("members"),
            F.col(f"{other}_id").alias("other_id"), F.col(f"{other}_members").alias("other_members"),
        )

    both = F.array(side("earlier", "later"), side("later", "earlier"))
    itself = F.col("earlier_id") == F.col("later_id")
    seen = F.explode(F.when(itself, F.slice(both, 1, 1)).otherwise(both)).alias("m")
    return pairs.select(seen, "relationship", "score").select("m.*", "relationship", "score")


#: Scores of matches lie from 0.5 to 1, where doubles are whole multiples of 2**-53; a packed match has the score's
#: multiple, then 20 digits for the other id counted down, then one for the relationship.
SCORE_UNITS, BELOW_SCORE, LARGEST_ID = 2.0**53, D(10) ** 21, D(2**63 - 1)
RELATIONSHIPS = ("duplicate", "reauction", "review")


def _packed(score: Column, other_id: Column, relationship: Column) -> Column:
    """A match as one decimal whose order is score, then smaller id.

    A number of fixed width is kept up to date in place by a hash aggregate; a struct would have all matches sorted.
    """
    units = (score * F.lit(SCORE_UNITS)).cast("long").cast("decimal(16,0)")
    down = F.lit(LARGEST_ID).cast("decimal(19,0)") - other_id.cast("decimal(19,0)")
    code = F.array_position(F.array(*[F.lit(name) for name in RELATIONSHIPS]), relationship).cast("decimal(1,0)")
    whole = units.cast("decimal(38,0)") * F.lit(BELOW_SCORE).cast("decimal(22,0)")
    return (whole + down * F.lit(10).cast("decimal(2,0)") + code).cast("decimal(38,0)")


def _unpacked(packed: Column) -> Column:
    """struct(score, minus_id, relationship) of a packed match; null for none."""
    text = F.lpad(packed.cast("string"), 38, "0")
    other_id = F.lit(LARGEST_ID).cast("decimal(20,0)") - F.substring(text, 18, 20).cast("decimal(20,0)")
    told = F.struct(
        (F.substring(text, 1, 17).cast("long") / F.lit(SCORE_UNITS)).alias("score"),
        (-other_id.cast("long")).alias("minus_id"),
        F.element_at(F.array(*[F.lit(name) for name in RELATIONSHIPS]), F.substring(text, 38, 1).cast("int")).alias("relationship"),
    )
    return F.when(packed.isNotNull(), told)


def best_match(listings: DataFrame, folded: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per listing with a match: the highest scored other listing, smaller id on ties, and the number of matches."""
    number = F.when(F.col("id") == F.col("other_id"), F.col("members") - 1).otherwise(F.col("other_members"))
    return _best_of(profile_members(listings, folded), rank_matches(pairs).withColumn("matches", number))


def best_match_in_blocks(listings: DataFrame, folded: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``best_match`` where a task sends the best match of a profile, not all of them."""
    schema = "id long, other_id long, score double, relationship string, matches long"
    seen = _pairs_in_blocks(folded, pair_blocks.best(RULES), schema, cell_rows)
    return _best_of(saved(profile_members(listings, folded)), seen)


def _best_of(members: DataFrame, seen: DataFrame) -> DataFrame:
    """The best of the matches seen from each profile (or of the best ones of its keys), for its listings.

    Worked out per profile, where one combined aggregate suffices, and widened to listings at the end.  The best of
    another profile is its smallest id, which names it; among copies it is the smallest id that is not the
    listing's own.
    """
    fellow = F.col("id") == F.col("other_id")
    found = _packed(F.col("score"), F.col("other_id"), F.col("relationship"))
    ranked = seen.groupBy(F.col("id").alias("profile_id")).agg(
        F.max(F.when(~fellow, found)).alias("outside"),
        F.max(F.when(fellow, found)).alias("inside"),
        F.sum("matches").alias("matches"),
    ).withColumns({"outside": _unpacked(F.col("outside")), "inside": _unpacked(F.col("inside"))})
    second = members.filter(F.col("id") != F.col("profile_id")).groupBy("profile_id").agg(F.min("id").alias("second_id"))
    rows = members.join(ranked.join(second, "profile_id", "left"), "profile_id")
    nearest = F.when(F.col("id") == F.col("profile_id"), F.col("second_id")).otherwise(F.col("profile_id"))
    copy = F.when(
        F.col("inside").isNotNull(),
        F.struct(F.col("inside.score").alias("score"), (-nearest).alias("minus_id"), F.col("inside.relationship").alias("relationship")),
    )
    return rows.withColumn("best", F.greatest("outside", copy)).select(
        "id", (-F.col("best.minus_id")).alias("other_id"), "best.relationship", "best.score", "matches"
    )


def price_steps(listings: DataFrame, segment: Column | None = None) -> DataFrame:
    """Reserve price of each dated round of an asset against the round before."""
    rounds = listings.filter(_given("asset_key") & F.col("auction_start_at").isNotNull()).select(
        "asset_key", "id", "auction_start_at", "reserve_price"
    )
    linked = with_previous(
        rounds, ["asset_key"], ("auction_start_at", "id"),
        F.year("auction_start_at") if segment is None else segment, F.struct("id", "reserve_price"),
    )
    return linked.filter(F.col("previous").isNotNull()).select(
        "asset_key", "id", F.col("previous.id").alias("previous_id"),
        price_change(F.col("previous.reserve_price"), F.col("reserve_price")).alias("change"),
    )
