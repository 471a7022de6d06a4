"""Linkage against brute force, with copies, missing values and keys cut into cells."""

import itertools
import random
from datetime import datetime, timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from lotwise.operators import linkage
from lotwise.plans import linkage_queries
from lotwise.schemas import LISTING
from lotwise.session import saved

BASE = datetime(2026, 3, 1, 10)
SF = "/root/testdata/sf0.001"


def listing(number, **changed):
    row = {f.name: None for f in LISTING.fields}
    row |= {
        "id": number, "source_id": "s", "external_id": str(number), "asset_class": "property", "is_published": True,
        "status": "upcoming", "address": "Flat 302, Sunrise Apartments, Andheri West, Mumbai", "locality": "Andheri West",
        "city": "Mumbai", "state": "Maharashtra", "pincode": "400053", "area_sqft": D("850.00"),
        "reserve_price": D("5000000.00"), "auction_start_at": BASE,
    }
    return row | changed


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[f.name] for f in LISTING.fields) for r in rows], LISTING)


def words(value):
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in (value or "").lower()).split()
    return set(kept) - set(linkage.STOP_WORDS)


def keys(r):
    found = {("asset", r["asset_key"])} if r["asset_key"] else set()
    lakh = int(r["reserve_price"] / 100000) if r["reserve_price"] else None
    if r["city"] and lakh is not None:
        found.add(("geo", r["state"], r["city"], lakh))
    if r["pincode"] and r["area_sqft"]:
        found.add(("pin", r["pincode"], int(r["area_sqft"] / 100)))
    if r["pincode"] and lakh is not None:
        found.add(("pinprice", r["pincode"], lakh))
    if len(words(r["address"])) >= 3:
        found.add(("addr", *sorted(words(r["address"]))[:4]))
    return found


def expected(a, b):
    if a["asset_key"] and a["asset_key"] == b["asset_key"]:
        score = 1.0
    else:
        jaccard = lambda x, y: len(x & y) / len(x | y) if x and y else 0.0
        parts = []
        if near := jaccard(words(a["address"]), words(b["address"])):
            parts.append((0.40, near))
        if a["area_sqft"] and b["area_sqft"]:
            gap = abs(a["area_sqft"] - b["area_sqft"]) / max(a["area_sqft"], b["area_sqft"])
            parts.append((0.20, max(0.0, 1 - float(gap) * 5)))
        if a["locality"] and b["locality"]:
            parts.append((0.15, jaccard(words(a["locality"]), words(b["locality"]))))
        if a["city"] and b["city"]:
            parts.append((0.15, float(a["city"].lower() == b["city"].lower())))
        if a["pincode"] and b["pincode"]:
            parts.append((0.10, float(a["pincode"] == b["pincode"])))
        if not parts:
            return "distinct"
        score = sum(w * v for w, v in parts) / sum(w for w, _ in parts)
        if a["reserve_price"] and a["reserve_price"] == b["reserve_price"]:
            score = min(1.0, score + 0.10)
    if score < 0.65:
        return "distinct"
    both = a["auction_start_at"] and b["auction_start_at"]
    if both and abs(a["auction_start_at"] - b["auction_start_at"]) >= timedelta(days=25):
        return "reauction"
    return "duplicate" if score >= 0.85 else "review"


def brute_force(rows, first=None):
    counts = {"duplicate": 0, "reauction": 0, "review": 0, "compared": 0}
    leading = {r["id"] for r in sorted(rows, key=lambda r: r["id"])[:first]}
    for a, b in itertools.combinations(rows, 2):
        if a["asset_class"] != b["asset_class"] or not keys(a) & keys(b) or not leading & {a["id"], b["id"]}:
            continue
        found = expected(a, b)
        if found != "distinct":
            counts[found] += 1
            counts["compared"] += 1
    return counts


@pytest.mark.parametrize(
    ("changed", "relationship", "reason"),
    [
        ({"source_id": "t", "address": "302 Sunrise Apartments Andheri West Mumbai"}, "duplicate", "near-identical address"),
        ({"auction_start_at": BASE + timedelta(days=90), "reserve_price": D("3300000.00")}, "reauction", "34% below"),
        ({"auction_start_at": BASE + timedelta(days=60)}, "reauction", "later auction round"),
        ({"auction_start_at": BASE + timedelta(days=2)}, "duplicate", "identical reserve price"),
        ({"asset_class": "vehicle"}, None, None),
    ],
)
def test_verdicts(spark, changed, relationship, reason):
    found = linkage.find_for(frame(spark, [listing(1), listing(2, **changed)]), 1).collect()
    assert [r.relationship for r in found] == ([relationship] if relationship else [])
    assert not found or reason in "; ".join(found[0].reasons)


def random_rows(count, seed):
    pick = random.Random(seed)
    rows = []
    for number in range(count):
        if rows and pick.random() < 0.3:  # an exact copy under another id
            rows.append({**pick.choice(rows), "id": number, "external_id": str(number)})
            continue
        rows.append(
            listing(
                number,
                asset_class=pick.choice(["property", "property", "vehicle"]),
                address=pick.choice([None, "", "Plot No 5", "Flat 1 Sunrise Heights Andheri", "Shop 9 Galaxy Mall Vashi Sector 3", "Flat 1 Sunrise Heights Wing B"]),
                locality=pick.choice([None, "Andheri West", "Old Road", "Vashi"]),
                city=pick.choice([None, "Mumbai", "MUMBAI", "Pune"]),
                state=pick.choice([None, "Maharashtra"]),
                pincode=pick.choice([None, "400053", "400054"]),
                area_sqft=pick.choice([None, D("0.00"), D("850.00"), D("870.00"), D("890.00")]),
                reserve_price=pick.choice([None, D("5000000.00"), D("5050000.00"), D("3300000.00")]),
                auction_start_at=pick.choice([None, BASE, BASE + timedelta(days=24), BASE + timedelta(days=90)]),
                asset_key=pick.choice([None, None, None, "", "K1"]),
            )
        )
    return rows


@pytest.mark.parametrize("cell_rows", [3, 4000])
def test_scan_equals_brute_force_with_copies_and_cut_keys(spark, cell_rows):
    rows = random_rows(160, seed=cell_rows)
    data = frame(spark, rows)
    assert linkage.scan(data, cell_rows=cell_rows).first().asDict() == brute_force(rows)
    assert linkage.scan(data, limit=25, cell_rows=cell_rows).first().asDict() == brute_force(rows, 25)


def test_copies_cost_one_profile(spark):
    rows = [listing(n) for n in range(60)]
    data = frame(spark, rows)
    folded = linkage.profiles(data)
    assert folded.count() == 1
    pairs = linkage.scored_pairs(folded).collect()
    assert [(p.earlier_id, p.later_id, p.pairs, p.relationship) for p in pairs] == [(0, 0, 60 * 59 // 2, "duplicate")]
    members = linkage.profile_members(data, folded)
    assert members.count() == 60 and members.filter("profile_id <> 0").count() == 0


def test_price_steps_over_a_busy_asset(spark):
    rows = [listing(n, asset_key="K", auction_start_at=BASE + timedelta(days=40 * n), reserve_price=D(1000 - n * 10)) for n in range(30)]
    steps = {r.id: r.change for r in linkage.price_steps(frame(spark, rows)).collect()}
    assert len(steps) == 29 and steps[1] == D("-0.0100")
    assert linkage.price_steps(frame(spark, rows)).agg(F.sum("previous_id")).first()[0] == sum(range(29))


def test_a_key_is_split_by_its_own_size_alone(spark):
    rows = [listing(n, address=f"Lot {n}", locality=None, city=None, area_sqft=None, reserve_price=D(5_000_000 + n)) for n in range(31)]
    rows += [listing(1000 + n, pincode=str(600_000 + n), reserve_price=D(100_000 * n), locality=None, city=None) for n in range(300)]
    spread = linkage._spread(linkage.profiles(frame(spark, rows)), cell_rows=30)
    slices = {r.key: r.slices for r in spread.select("key", "slices").distinct().collect()}
    assert slices["pinprice:400053:50"] == 2 and all(n == 1 for k, n in slices.items() if k.startswith("pinprice:6"))


def test_best_match_equals_find_for_on_copies(spark):
    rows = random_rows(60, seed=9)
    rows += [dict(r, id=r["id"] + 1000) for r in rows[:30]] + [dict(r, id=r["id"] + 2000) for r in rows[:10]]
    data = frame(spark, rows)
    folded = linkage.profiles(data)
    best = {r.id: r for r in linkage.best_match(data, folded, linkage.scored_pairs(folded, cell_rows=7)).collect()}
    for number in (rows[0]["id"], rows[3]["id"] + 1000, rows[5]["id"] + 2000, rows[40]["id"], rows[55]["id"]):
        matches = linkage.find_for(data, number).collect()
        assert (number in best) == bool(matches)
        if matches:
            found = best[number]
            assert (found.other_id, found.relationship, found.matches) == (matches[0].other_id, matches[0].relationship, len(matches))


def test_first_ids_meet_the_rest_without_other_pairs(spark):
    rows = frame(spark, [listing(n, address=f"Flat {n % 7}, Tower {n % 3}, Sunrise Road, Andheri") for n in range(1, 61)])
    folded = linkage.profiles(rows, F.lit(4))
    pairs = linkage.leading_pairs(folded)
    every, touching = linkage._pair_counts()
    wanted = linkage.candidate_pairs(folded).agg(F.sum(touching)).first()[0]
    assert pairs.agg(F.sum(touching)).first()[0] == wanted > 0
    assert pairs.filter((F.col("a.leading") == 0) & (F.col("b.leading") == 0)).isEmpty()


def test_packed_matches_order_by_score_then_smaller_id(spark):
    scores, ids = (0.65, 0.65 + 2**-53, 0.8999999999999999, 1.0), (-(2**63) + 1, -5, 0, 7, 2**63 - 1)
    found = [(s, i, r) for s in scores for i in ids for r in linkage.RELATIONSHIPS]
    rows = spark.createDataFrame(found, "score double, other_id long, relationship string")
    packed = rows.withColumn("p", linkage._packed(F.col("score"), F.col("other_id"), F.col("relationship")))
    back = packed.withColumn("u", linkage._unpacked(F.col("p"))).collect()
    assert [(r.u.score, -r.u.minus_id, r.u.relationship) for r in back] == found
    best = {i: max((r for r in back if r.other_id in (i, 7)), key=lambda r: r.p) for i in ids}
    assert all((r.score, r.other_id) == (1.0, min(i, 7)) for i, r in best.items())


def test_best_matches_are_found_without_sorting_all_matches(spark):
    rows = frame(spark, [listing(n, address=f"Flat {n % 7}, Tower {n % 3}, Sunrise Road, Andheri") for n in range(1, 30)])
    folded = linkage.profiles(rows)
    plan = linkage.best_match(rows, folded, linkage.scored_pairs(folded))._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def plan(rows):
    rows.collect()
    return rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("cell_rows", [3, 4000])
def test_only_distinct_pairs_are_left_without_a_score(spark, cell_rows):
    rows = random_rows(150, seed=21) + [
        listing(1000 + n, address=a, locality=c, pincode=p, area_sqft=D(s), reserve_price=D(5_000_000 + n % 3 * 10))
        for n, (a, c, p, s) in enumerate(itertools.product(["Lot 1 A", "Lot 1 A B C", None], ["x", "x y z", None], ["1", "2"], ["850", "-850", "990"]))
    ]
    folded = linkage.profiles(frame(spark, rows)).cache()
    met = linkage.with_similarity(linkage.candidate_pairs(folded, cell_rows)).withColumn("may", linkage.may_match())
    seen = {(r.may, r.near): r.n for r in met.groupBy("may", (F.col("score") >= 0.65).alias("near")).agg(F.count("*").alias("n")).collect()}
    assert (False, True) not in seen and seen[True, True] > 0 and seen[False, False] > seen[True, False]
    wanted = linkage.tally(linkage.scored_pairs(folded, cell_rows, keep_distinct=True))
    assert sorted(linkage.tally_of_all(folded, cell_rows).collect()) == sorted(wanted.collect())


def test_time_order_works_out_no_score(spark):
    ordered = linkage_queries.time_order(spark, SF)
    assert "array_intersect" not in plan(ordered)


def test_both_sides_of_the_pairs_share_a_shuffle(spark):
    folded = saved(linkage.profiles(frame(spark, random_rows(100, seed=5))))
    for pairs in (linkage.time_order(linkage.candidate_pairs(folded)), linkage.scored_pairs(folded), linkage.scored_pairs(folded, keep_distinct=True)):
        assert "ReusedExchange" in plan(pairs)
