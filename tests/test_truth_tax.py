import pytest
from pyspark.sql import functions as F

from paisaflow.operators import scoring, tax, truth
from paisaflow.schemas import MATCHES, EXCEPTIONS, TAX_ANSWERS


@pytest.mark.parametrize("l, b, want", [
    ("missing", "exact", "no_counterpart"), ("exact", "missing", "no_counterpart"),
    ("partial_settlement", "exact", "ambiguous"), ("exact", "exact", "must_match"),
    ("late_settlement_window", "exact", "must_match"),
    ("missing", "partial_settlement", "no_counterpart"),
])
def test_verdict(spark, l, b, want):
    df = spark.createDataFrame([(l, b)], "l string, b string")
    assert df.select(truth.verdict(F.col("l"), F.col("b"))).first()[0] == want


def test_score(spark):
    base = spark.createDataFrame(
        [(f"T{i}", f"order_{i}") for i in range(1, 6)], "txn_id string, order_id string"
    )
    l = spark.createDataFrame(
        [("T1", "exact", "L1"), ("T2", "duplicate", "L2a"), ("T2", "duplicate", "L2b"),
         ("T3", "partial_settlement", "L3"), ("T5", "exact", "L5")],
        "txn_id string, kind string, row_id string",
    )
    b = spark.createDataFrame(
        [("T1", "exact", "B1"), ("T2", "duplicate", "B2a"), ("T2", "duplicate", "B2b"),
         ("T3", "exact", "B3"), ("T4", "exact", "B4"), ("T5", "exact", "B5")],
        "txn_id string, kind string, row_id string",
    )
    t = truth.build_ground_truth(base, l, b)
    rows = truth.truth_rows(l, b)
    owner = truth.row_owner(rows)
    pairs = [("L2a", "B2a"), ("L2b", "B2b"), ("L3", "B3"), ("L1", "B4")]
    matches = spark.createDataFrame(
        [(x, y, "o", "exact", 0.0, 0.0, None) for x, y in pairs], MATCHES
    )
    exceptions = spark.createDataFrame([("L5", "ledger", "o", "unexplained", "e")], EXCEPTIONS)
    s = scoring.score(matches, exceptions, t, owner).first()
    assert (s.total_ground_truth_txns, s.should_fully_reconcile, s.reported_matches) == (5, 3, 4)
    assert (s.true_positives, s.false_positives, s.false_negatives) == (2, 1, 2)
    assert (s.ambiguous_resolved, s.exception_count) == (1, 1)
    assert (s.precision, s.recall, s.match_rate) == (0.6667, 0.3333, 0.8)
    missed = scoring.false_negatives(matches, t, owner).collect()
    assert sorted(r.txn_id for r in missed) == ["T1", "T5"]
    nested = truth.nest_row_ids(t, rows)
    got = {r.txn_id: (r.ledger_row_ids, r.bank_row_ids) for r in nested.collect()}
    assert got["T2"] == (["L2a", "L2b"], ["B2a", "B2b"]) and got["T4"] == ([], ["B4"])


def test_transaction_with_very_many_rows(spark):
    """No row loses its owner, however many a transaction has on a side."""
    base = spark.createDataFrame([("T1", "order_1")], "txn_id string, order_id string")
    kinds = "txn_id string, kind string, row_id string"
    l = spark.range(1001).selectExpr("'T1' as txn_id", "'duplicate' as kind", "concat('L', id) as row_id")
    b = spark.createDataFrame([("T1", "exact", "B1")], kinds)
    rows = truth.truth_rows(l, b)
    assert truth.row_owner(rows).filter("txn_id = 'T1'").count() == 1002
    nested = truth.nest_row_ids(truth.build_ground_truth(base, l, b), rows).first()
    assert len(nested.ledger_row_ids) == 1001 and nested.bank_row_ids == ["B1"]


TAX = "txn_id string, had_refund boolean, gst_on_fee_flag boolean, fee_amount string," \
      " tax_on_fee double, fee_amount_pending boolean"


@pytest.mark.parametrize("row, want", [
    (("t", True, False, "0", 0.0, False), "refund_credit_note"),
    (("t", False, False, "20.0", 0.0, False), "exempt"),
    (("t", False, True, "20.0", 0.0, False), "gst_on_fee"),
    (("t", False, True, "0", 0.0, False), "taxable_sale"),
    (("t", False, True, "20", 0.0, True), None), (("t", None, True, "20", 0.0, False), None),
    (("t", False, None, "20", 0.0, False), None), (("t", False, True, None, 0.0, False), None),
    (("t", False, True, "pending", 0.0, False), None),
])
def test_rules(spark, row, want):
    rows = tax.classify_by_rules(spark.createDataFrame([row], TAX)).collect()
    assert [r.category for r in rows] == ([want] if want else [])
    assert all(r.reasoning and r.method == "rule" for r in rows)


def test_fee_in_reasoning(spark):
    row = tax.classify_by_rules(
        spark.createDataFrame([("t", False, True, "20.5", 0.0, False)], TAX)
    ).first()
    assert row.reasoning == (
        "Nonzero gateway fee (20.5) with GST applicable — classified as GST-on-fee."
    )


def test_fallback(spark):
    txns = spark.createDataFrame(
        [("a", False, True, "5.0", 1.0, True), ("b", None, True, "7.0", 1.0, False),
         ("c", False, True, "7.0", 1.0, True), ("d", False, True, "7.0", 1.0, False)], TAX
    )
    items = {r.txn_id: r.fee_amount for r in tax.fallback_items(txns).collect()}
    assert items == {"a": None, "b": "7.0", "c": None}
    answers = spark.createDataFrame([("a", "exempt", "why"), ("b", "other", "x")], TAX_ANSWERS)
    done = tax.classify(txns, answers)
    got = {r.txn_id: (r.category, r.method) for r in done.classifications.collect()}
    assert got == {
        "a": ("exempt", "llm"), "b": ("unresolved", "llm"), "c": ("unresolved", "llm"),
        "d": ("gst_on_fee", "rule"),
    }
    assert {r.txn_id for r in done.unresolved.collect()} == {"b", "c"}
