"""Keys too large for one task give the same pairs as the sequential choice."""

import datetime as dt
import random

import pytest

from paisaflow.operators import components, folding, hot_nearest, hot_pairing, keys, slabs
from paisaflow.operators.fuzzy import fuzzy_match
from paisaflow.operators.keys import find_hot_keys, with_order_key
from paisaflow.operators.nearest import nearest_pairs
from paisaflow.schemas import FUZZY_TOLERANCE
from tests.helpers import at, bank, fuzzy_cost, gap, greedy, ledger, txns

SPREAD = [round(50 * 1.06 ** i, 2) for i in range(90)]
COPIES = [499.0, 499.5, 1200.0]
LATTICE = [float(a) for a in range(90, 102)]


def crowd(rng, key, n_ledger, n_bank, amounts, days, step_minutes):
    """Rows of a key with amounts and times drawn from small sets, so copies and ties occur."""
    start = at("2025-06-01T00:00:00")

    def when():
        return start + dt.timedelta(
            minutes=rng.randrange(0, days * 1440 // step_minutes) * step_minutes
        )

    name = key or "blank"
    numbers = lambda n: rng.sample(range(1000), n)
    ls = [
        ledger(source_id=f"L_{name}_{i:03d}", order_id=key, amount=rng.choice(amounts), fee=0.0,
               raw_tax_on_fee=0.0, created_at=when()) for i in numbers(n_ledger)
    ]
    bs = [
        bank(source_id=f"B_{name}_{i:03d}", order_id=key, amount=rng.choice(amounts),
             created_at=when()) for i in numbers(n_bank)
    ]
    return ls, bs


def many_keys(seed, sizes):
    rng = random.Random(seed)
    ls, bs = [], []
    for i in range(sizes):
        amounts, days, step = rng.choice([
            (SPREAD, 20, 7), (COPIES, 3, 1440), (LATTICE, 2, 1440), (SPREAD, 1, 60),
            (LATTICE, 1, 360),
        ])
        l, b = crowd(rng, f"o{i}", rng.randint(1, 14), rng.randint(1, 14), amounts, days, step)
        ls += l
        bs += b
    return ls, bs


def keyed(spark, ls, bs):
    return with_order_key(txns(spark, *ls)), with_order_key(txns(spark, *bs))


def pairs_of(found):
    got = [(r.l_id, r.b_id) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(params=["folded", "in rounds"])
def fold_rows(request, monkeypatch):
    """Keys folded as they are, and keys that no task may take whole."""
    if request.param == "in rounds":
        monkeypatch.setattr(folding, "FOLD_ROWS", 6)
    return request.param


def test_band_pairs_equal_sequential_choice(spark, fold_rows):
    ls, bs = many_keys(1, 120)
    found = hot_pairing.pair_in_bands(*keyed(spark, ls, bs), FUZZY_TOLERANCE)
    assert pairs_of(found) == greedy(ls, bs, fuzzy_cost)


def test_nearest_pairs_equal_sequential_choice(spark, fold_rows):
    ls, bs = many_keys(2, 250)
    assert pairs_of(hot_nearest.pair_nearest(*keyed(spark, ls, bs))) == greedy(ls, bs, gap)


def test_one_crowded_key_in_bands(spark, monkeypatch):
    """Few pairs per class allowed: several radii are needed."""
    monkeypatch.setattr(hot_pairing, "PAIRS_PER_CLASS", 0.02)
    ls, bs = crowd(random.Random(3), "", 150, 140, SPREAD, 10, 7)
    found = hot_pairing.pair_in_bands(*keyed(spark, ls, bs), FUZZY_TOLERANCE)
    assert pairs_of(found) == greedy(ls, bs, fuzzy_cost)


def test_nearest_pairs_far_apart(spark):
    """All ledger amounts lie below all bank amounts: every row must still be paired."""
    ls = [ledger(source_id=f"L{i:03d}", amount=100.0 + i, fee=0.0, raw_tax_on_fee=0.0)
          for i in range(60)]
    bs = [bank(source_id=f"B{i:03d}", amount=90_000.0 + 3 * i) for i in range(70)]
    assert pairs_of(hot_nearest.pair_nearest(*keyed(spark, ls, bs))) == greedy(ls, bs, gap)


def test_hot_and_small_keys_together(spark):
    rng = random.Random(5)
    ls, bs = crowd(rng, "", 90, 80, SPREAD, 10, 11)
    for key in ("order_a", "order_b"):
        l, b = crowd(rng, key, 12, 9, SPREAD[:20], 10, 11)
        ls, bs = ls + l, bs + b
    l, b = txns(spark, *ls), txns(spark, *bs)
    hot = find_hot_keys(l, b, pair_limit=3000)
    assert [r.order_key for r in hot.collect()] == [""]
    split = fuzzy_match(l, b, hot)
    got = {(r.ledger_row_id, r.bank_row_id) for r in split.matches.collect()}
    want = greedy(ls, bs, fuzzy_cost)
    assert got == want
    l_left = [x for x in ls if x["source_id"] not in {p[0] for p in want}]
    b_left = [x for x in bs if x["source_id"] not in {p[1] for p in want}]
    rest = nearest_pairs(split.ledger_rest, split.bank_rest, hot)
    assert {(r.l_id, r.b_id) for r in rest.collect()} == greedy(l_left, b_left, gap)


def with_gaps(rng, rows, *names):
    return [{**r, **{n: None for n in names if rng.random() < 0.25}} for r in rows]


def test_unknown_amounts_and_times_pair_with_nothing_either_way(spark):
    """Rows without amount stay open; both ways of pairing leave the same rows."""
    rng = random.Random(11)
    ls, bs = many_keys(6, 60)
    ls, bs = with_gaps(rng, ls, "amount"), with_gaps(rng, bs, "amount")
    keep = lambda r: r["amount"] is not None
    known = list(filter(keep, ls)), list(filter(keep, bs))
    want = greedy(*known, gap)
    assert pairs_of(hot_nearest.pair_nearest(*keyed(spark, ls, bs))) == want
    assert pairs_of(nearest_pairs(txns(spark, *ls), txns(spark, *bs), None)) == want
    ls, bs = with_gaps(rng, ls, "created_at"), with_gaps(rng, bs, "created_at")
    timed = lambda r: keep(r) and r["created_at"] is not None
    want = greedy(list(filter(timed, ls)), list(filter(timed, bs)), fuzzy_cost)
    assert pairs_of(hot_pairing.pair_in_bands(*keyed(spark, ls, bs), FUZZY_TOLERANCE)) == want
    split = fuzzy_match(txns(spark, *ls), txns(spark, *bs), None)
    assert {(r.ledger_row_id, r.bank_row_id) for r in split.matches.collect()} == want


def test_hot_keys_are_found_by_default(spark, monkeypatch):
    monkeypatch.setattr(keys.find_hot_keys, "__defaults__", (3000,))
    ls, bs = crowd(random.Random(9), None, 70, 60, SPREAD, 10, 11)
    l, b = txns(spark, *ls), txns(spark, *bs)
    split = fuzzy_match(l, b)
    want = greedy(ls, bs, fuzzy_cost)
    assert {(r.ledger_row_id, r.bank_row_id) for r in split.matches.collect()} == want
    assert pairs_of(nearest_pairs(l, b)) == greedy(ls, bs, gap)


def test_no_hot_keys(spark):
    l, b = txns(spark, ledger()), txns(spark, bank())
    assert find_hot_keys(l, b) is None


def test_connected_parts(spark):
    rng = random.Random(4)
    chain = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(300)]
    web = [(f"w{rng.randrange(60):02d}", f"w{rng.randrange(60):02d}") for _ in range(40)]
    got = {r.node: r.part for r in components.connected(spark.createDataFrame(chain + web, "a string, b string")).collect()}
    assert {got[f"n{i:04d}"] for i in range(301)} == {"n0000"}
    for a, b in web:
        assert got[a] == got[b] <= min(a, b)
    assert components.connected(spark.createDataFrame([], "a string, b string")).isEmpty()


def tied(n, step=1.0, growth=0.0):
    """Ledger and bank amounts in turn, each as far from the last as the one before, or a little farther."""
    v, ls, bs = 1000.0, [], []
    for i in range(n):
        ls.append(ledger(source_id=f"L{i:05d}", order_id="", amount=v, fee=0.0, raw_tax_on_fee=0.0))
        bs.append(bank(source_id=f"B{i:05d}", order_id="", amount=v + step))
        v += 2 * step
        step += growth
    return ls, bs


@pytest.mark.parametrize("growth", [0.0, 1 / 64])
@pytest.mark.parametrize("limit", [2, 200_000])
def test_rounds_do_not_grow_with_tied_rows(spark, monkeypatch, growth, limit):
    """24 and 240 tied rows a side, folded and taken in rounds by the rule for paths."""
    monkeypatch.setattr(folding, "FOLD_ROWS", limit)
    rounds = []
    plain = hot_nearest._settled
    monkeypatch.setattr(hot_nearest, "_settled", lambda pairs: rounds.append(1) or plain(pairs))
    seen = []
    for n in (24, 240):
        rounds.clear()
        ls, bs = tied(n, growth=growth)
        assert pairs_of(hot_nearest.pair_nearest(*keyed(spark, ls, bs))) == greedy(ls, bs, gap)
        seen.append(len(rounds))
    assert seen[0] == seen[1] <= 2


def test_rounds_in_bands_do_not_grow_with_tied_rows(spark, monkeypatch):
    rounds = []
    plain = hot_pairing._folded
    monkeypatch.setattr(hot_pairing, "_folded", lambda *a: rounds.append(1) or plain(*a))
    for n in (24, 240):
        rounds.clear()
        ls, bs = tied(n)
        found = hot_pairing.pair_in_bands(*keyed(spark, ls, bs), FUZZY_TOLERANCE)
        assert pairs_of(found) == greedy(ls, bs, fuzzy_cost)
        assert len(rounds) <= 11  # radii


def test_segments_of_the_axis(spark, monkeypatch):
    """A key too large for one task, in clusters that each fit: folded by segments."""
    monkeypatch.setattr(folding, "FOLD_ROWS", 40)
    rng = random.Random(12)
    start = [100.0, 5_000.0, 90_000.0, 90_500.0]
    amount = lambda: rng.choice(start) + rng.randrange(30) / 4
    ls = [ledger(source_id=f"L{i:03d}", order_id="", amount=amount(), fee=0.0, raw_tax_on_fee=0.0) for i in range(70)]
    bs = [bank(source_id=f"B{i:03d}", order_id="", amount=amount()) for i in range(60)]
    assert pairs_of(hot_nearest.pair_nearest(*keyed(spark, ls, bs))) == greedy(ls, bs, gap)


@pytest.mark.parametrize("pair, cost", [
    (lambda l, b: hot_pairing.pair_in_bands(l, b, FUZZY_TOLERANCE), fuzzy_cost), (hot_nearest.pair_nearest, gap),
])
def test_small_parts_are_folded_in_buckets(spark, monkeypatch, pair, cost):
    """Calls of Python follow the rows, not the number of parts; no part is split."""
    monkeypatch.setattr(folding, "BUCKET_ROWS", 400)
    calls = []
    plain = folding.in_buckets

    def seen(table, by, rows):
        dealt = plain(table, by, rows)
        places = dealt.select(*by, "bucket").distinct().collect()
        calls.append((len({tuple(r[:-1]) for r in places}), len(places), len({r.bucket for r in places}), rows))
        return dealt

    monkeypatch.setattr(folding, "in_buckets", seen)
    ls, bs = many_keys(21, 60)
    assert pairs_of(pair(*keyed(spark, ls, bs))) == greedy(ls, bs, cost)
    assert max(parts for parts, *_ in calls) > 30
    for parts, places, buckets, rows in calls:
        assert places == parts and buckets <= max(1, -(-rows // 400))


@pytest.mark.parametrize("size", [30, 80])
def test_slabs_equal_sequential_choice(spark, monkeypatch, size):
    """Margins narrower than a row reaches and several passes; rows come twice; one key is too dense for slabs."""
    monkeypatch.setattr(slabs, "LEAST_ROWS", 60)
    monkeypatch.setattr(slabs, "SLAB_ROWS", size)
    passes, plain = [], slabs._placed
    monkeypatch.setattr(slabs, "_placed", lambda *a: passes.append(1) or plain(*a))
    rng = random.Random(31)
    ls, bs = crowd(rng, "", 150, 140, SPREAD, 60, 7)
    ls, bs = ls + ls[:9], bs + bs[:5]
    for name, amounts, days, step in (("copies", COPIES, 60, 1440), ("dense", LATTICE, 2, 1440), ("long", SPREAD, 400, 60)):
        l, b = crowd(rng, name, 60, 50, amounts, days, step)
        ls, bs = ls + l, bs + b
    found = hot_pairing.pair_in_bands(*keyed(spark, ls, bs), FUZZY_TOLERANCE).collect()
    own = lambda rows: [{**r, "source_id": f"{r['source_id']}#{i:04d}"} for i, r in enumerate(rows)]
    want = greedy(own(ls), own(bs), fuzzy_cost)
    assert sorted((r.l_id, r.b_id) for r in found) == sorted((l.split("#")[0], b.split("#")[0]) for l, b in want)
    assert len(passes) > 1


def test_sparse_key_is_settled_by_slabs_alone(spark, monkeypatch):
    """No radius over the whole key is looked at, so jobs do not grow with its rows."""
    monkeypatch.setattr(slabs, "LEAST_ROWS", 60)
    monkeypatch.setattr(slabs, "SLAB_ROWS", 100)
    radii, plain = [], hot_pairing._pick_radius
    monkeypatch.setattr(hot_pairing, "_pick_radius", lambda *a: radii.append(1) or plain(*a))
    ls, bs = crowd(random.Random(32), "", 160, 150, SPREAD, 90, 7)
    found = hot_pairing.pair_in_bands(*keyed(spark, ls, bs), FUZZY_TOLERANCE)
    assert pairs_of(found) == greedy(ls, bs, fuzzy_cost)
    assert not radii
