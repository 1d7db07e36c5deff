import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import registry
from paisaflow.operators import adjudicate, pairing
from paisaflow.operators.exact import exact_match
from paisaflow.operators.fuzzy import fuzzy_match
from paisaflow.operators.nearest import nearest_pairs
from paisaflow.plans.reconcile import reconcile
from paisaflow.schemas import RESOLUTIONS
from tests.helpers import at, bank, fuzzy_cost, gap, greedy, ledger, txns


def sizes(split):
    return split.matches.count(), split.ledger_rest.count(), split.bank_rest.count()


@pytest.mark.parametrize("l_rows, b_rows, want", [
    ([ledger()], [bank()], (1, 0, 0)),
    ([ledger()], [bank(amount=926.4)], (0, 1, 1)),
    ([ledger(created_at=at("2025-06-01T00:00:00"))],
     [bank(created_at=at("2025-06-01T10:00:00"))], (0, 1, 1)),
    ([ledger(), ledger(source_id="LEDG00002")], [bank()], (0, 2, 1)),
    ([ledger()], [bank(order_id="order_2")], (0, 1, 1)),
    ([ledger(refund_amount=200.0)], [bank(amount=776.4)], (1, 0, 0)),
    ([ledger(order_id=None)], [bank(order_id="")], (1, 0, 0)),
])
def test_exact(spark, l_rows, b_rows, want):
    assert sizes(exact_match(txns(spark, *l_rows), txns(spark, *b_rows))) == want


def test_exact_row(spark):
    row = exact_match(txns(spark, ledger()), txns(spark, bank())).matches.first()
    assert (row.ledger_row_id, row.bank_row_id, row.order_id, row.tier) == (
        "LEDG00001", "BANK00001", "order_1", "exact"
    )
    assert row.amount_diff == pytest.approx(0.0, abs=1e-9)
    assert row.timestamp_diff_hours == 2.0


def fuzzy_rows(*amounts):
    when = at("2025-06-01T10:00:00")
    l = [ledger(raw_tax_on_fee=0.0)]
    b = [bank(source_id=f"BANK0000{i}", amount=a, created_at=when)
         for i, a in enumerate(amounts, 1)]
    return l, b


@pytest.mark.parametrize("amounts, want", [
    ([955.0], (1, 0, 0)), ([780.0], (0, 1, 1)), ([500.0, 979.0], (1, 0, 1)),
])
def test_fuzzy(spark, amounts, want):
    l, b = fuzzy_rows(*amounts)
    split = fuzzy_match(txns(spark, *l), txns(spark, *b))
    assert sizes(split) == want
    if len(amounts) == 2:
        assert split.matches.first().bank_row_id == "BANK00002"
        assert split.bank_rest.first().source_id == "BANK00001"


def test_fuzzy_other_order(spark):
    l, b = fuzzy_rows(980.0)
    b[0]["order_id"] = "order_2"
    assert sizes(fuzzy_match(txns(spark, *l), txns(spark, *b))) == (0, 1, 1)


def test_small_groups_equal_sequential_choice(spark):
    rng = random.Random(11)
    start = at("2025-06-01T00:00:00")
    ls, bs = [], []
    for g in range(60):
        for side, rows in (("L", ls), ("B", bs)):
            for i in range(rng.randint(0, 5)):
                make = ledger if side == "L" else bank
                rows.append(make(
                    source_id=f"{side}{g:03d}{i}", order_id=f"order_{g}",
                    amount=rng.choice([1000.0, 1010.0, 990.0, 1080.0, 400.0]),
                    created_at=start + dt.timedelta(hours=rng.randrange(0, 120, 12)),
                ))
    l, b = txns(spark, *ls), txns(spark, *bs)
    for parts in (1, 5):
        split = fuzzy_match(l.repartition(parts), b.repartition(parts))
        got = {(r.ledger_row_id, r.bank_row_id) for r in split.matches.collect()}
        assert got == greedy(ls, bs, fuzzy_cost)
        pairs = {(r.l_id, r.b_id) for r in nearest_pairs(l, b).collect()}
        assert pairs == greedy(ls, bs, gap)


def test_adjudication(spark):
    l = txns(
        spark, ledger(source_id="L1"), ledger(source_id="L2", order_id="order_2"),
        ledger(source_id="L3", order_id="order_3"), ledger(source_id="L4", order_id=""),
    )
    b = txns(
        spark, bank(source_id="B1", amount=10.0), bank(source_id="B2", order_id="order_2"),
        bank(source_id="B5", order_id="order_5"),
    )
    items = adjudicate.open_items(l, b)
    said = spark.createDataFrame([
        ("L1", "matched", "B1", "fits"), ("L2", "matched", "B9", "wrong id"),
        ("L3", "missing_counterpart", None, None), ("B5", "matched", "B5", "no candidate"),
    ], RESOLUTIONS)
    matches, exceptions = adjudicate.resolve(items, said)
    m = matches.collect()
    assert [(r.ledger_row_id, r.bank_row_id, r.tier, r.explanation) for r in m] == [
        ("L1", "B1", "llm", "fits")
    ]
    got = {r.row_id: (r.side, r.order_id, r.reason) for r in exceptions.collect()}
    assert got == {
        "L2": ("ledger", "order_2", "matched"),
        "L3": ("ledger", "order_3", "missing_counterpart"),
        "L4": ("ledger", None, "unexplained"), "B5": ("bank", "order_5", "matched"),
    }
    both = adjudicate.refused_candidates(items, exceptions).collect()
    assert [(r.row_id, r.side) for r in both] == [("B2", "bank")]


def test_answers_in_batches(spark):
    items = spark.range(37).select(F.col("id").cast("string").alias("row_id")).coalesce(1)

    def answer(batch):
        out = batch.copy()
        out["n"] = len(batch)
        return out

    rows = adjudicate.answer_in_batches(items, answer, "row_id string, n long", 12).collect()
    assert sorted(r.n for r in rows) == [1] + [12] * 36


def test_item_texts(spark):
    l, b = txns(spark, ledger()), txns(spark, bank(amount=10.0))
    row = adjudicate.item_texts(adjudicate.open_items(l, b), l, b).first()
    assert row.record.row_id == "LEDG00001" and row.candidate.amount == 10.0


def test_every_row_in_at_most_one_match(spark, sf_dir):
    import registry

    w = registry.workspace(spark, sf_dir)
    done = reconcile(w.ledger_txns.repartition(3), w.bank_txns.repartition(7), w.resolutions)
    matches = done.matches
    for side, rows in (("ledger", w.ledger), ("bank", w.bank)):
        ids = matches.select(f"{side}_row_id")
        assert ids.count() == ids.distinct().count()
        assert ids.join(rows, ids[0] == rows.row_id, "left_anti").isEmpty()
    assert matches.exceptAll(w.matches).isEmpty() and w.matches.exceptAll(matches).isEmpty()
    open_rows = done.open_items.select("row_id").union(
        done.open_items.select("candidate_id").dropna()
    ).union(matches.filter("tier <> 'llm'").select("ledger_row_id")).union(
        matches.filter("tier <> 'llm'").select("bank_row_id")
    )
    assert matches.filter("tier = 'llm'").count() > 0
    assert open_rows.count() == w.ledger.count() + w.bank.count()


def test_matching_stores_no_base_and_judges_once(spark, sf_dir):
    w = registry.Workspace(spark, sf_dir)
    judged = []
    kept = adjudicate.resolve(w.items, w.resolutions, keep=lambda df: judged.append(df) or df)
    assert kept.matches.count() == w.tier3.matches.count()
    assert kept.exceptions.count() == w.tier3.exceptions.count()
    assert len(judged) == 1
    assert "base" not in vars(w)


def test_greedy_choice_with_copies_and_open_edges(spark):
    edges = [
        ("one", 1.0, "L1", "B1"), ("copies", 1.0, "L1", "B1"), ("copies", 1.0, "L1", "B1"),
        ("two", 1.0, "L1", "B1"), ("two", 2.0, "L1", "B2"), ("two", 3.0, "L2", "B1"), ("two", 4.0, "L2", "B2"),
        *[("three", float(abs(3 * i - 2 * j)), f"L{i}", f"B{j}") for i in range(3) for j in range(3)],
        ("unknown", 1.0, None, "B1"), ("unknown", 2.0, None, "B2"), ("unknown", 3.0, "L1", "B2"),
    ]
    df = spark.createDataFrame(
        [(*e, 0.0, 0.0) for e in edges],
        "order_key string, cost double, l_id string, b_id string, diff double, hours double",
    )
    got = sorted(map(str, ((r.order_key, r.l_id, r.b_id) for r in pairing.take_greedily(df).collect())))
    want = []
    for key in {e[0] for e in edges}:
        taken = []
        for _, _, l, b in sorted((e for e in edges if e[0] == key), key=lambda e: (e[1], e[2] or "", e[3])):
            if not any((l is not None and l == x) or b == y for x, y in taken):
                taken.append((l, b))
        want += [str((key, *t)) for t in taken]
    assert got == sorted(want)
