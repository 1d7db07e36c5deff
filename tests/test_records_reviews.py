import pytest
from pyspark.sql import functions as F

from paisaflow.functions import money, text
from paisaflow.operators import records, reviews, similarity
from paisaflow.plans import ask
from paisaflow.schemas import EXCEPTIONS, REVIEW_LOG
from paisaflow.sources import tables
from tests.helpers import at

RECORD = (
    "txn_id string, order_id string, txn_amount double, payment_method string,"
    " created_at timestamp_ntz, settled_at timestamp_ntz, status string, had_refund boolean,"
    " refund_amount double, had_dispute_flag boolean, reconciliation_status string,"
    " reconciliation_tier string, tax_category string, tax_reasoning string,"
    " days_to_settle int, fee_amount double, tax_on_fee double,"
    " reconciliation_reasons array<struct<reason:string,explanation:string,rows:bigint>>"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([
        ("TXN001", "order_1", 500.0, "card", at("2025-06-01T10:00"), at("2025-06-02T10:00"),
         "settled", False, 0.0, False, "matched", "exact", "gst_on_fee", "fee", 1, 10.0, 1.8,
         None),
        ("TXN002", "order_2", 700.0, "wallet", at("2025-06-02T10:00"), at("2025-06-04T00:00"),
         "settled", None, 0.0, True, "exception", None, "exempt", "none", 2, 10.5, 0.0,
         [("unexplained", "why", 2)]),
        ("TXN003", "order_3", 900.0, "upi", at("2025-06-03T10:00"), None, "refunded", True,
         300.0, False, "no_settlement_data", None, None, None, None, 0.0, 0.0, None),
    ], RECORD)


def ids(result):
    return [r.txn_id for r in result.rows.collect()]


def test_payment_search(rows):
    found = records.search_payments(rows, payment_method="wallet", had_dispute_flag=True)
    assert ids(found) == ["TXN002"] and found.totals.first()[0] == 1
    assert ids(records.search_payments(rows, had_refund=False)) == ["TXN001", "TXN002"]
    assert ids(records.search_payments(rows, limit=2)) == ["TXN001", "TXN002"]
    assert records.search_payments(rows, limit=2).totals.first()[0] == 3


def test_settlement_search(rows):
    assert ids(records.search_settlements(rows)) == ["TXN001", "TXN002"]
    late = records.search_settlements(rows, settled_after="2025-06-03")
    assert ids(late) == ["TXN002"]
    t = late.totals.first()
    assert (t.total_matched, t.total_settlement_amount) == (1, 700.0)
    # a bare date ends before its own midnight, a full time is included
    assert ids(records.search_settlements(rows, settled_before="2025-06-04")) == ["TXN001"]
    assert ids(records.search_settlements(rows, settled_before="2025-06-04T00:00:00")) == [
        "TXN001", "TXN002"
    ]


def test_invoice_search(rows):
    assert ids(records.search_invoices(rows, category="exempt")) == ["TXN002"]
    assert ids(records.search_invoices(rows, limit=0)) == ["TXN001", "TXN002"]


def test_relation(rows):
    r = records.find_relation(rows, txn_id="TXN003").first()
    assert r.transaction.order_id == "order_3" and r.refund.amount == 300.0 and r.dispute is None
    r = records.find_relation(rows, order_id="order_2").first()
    assert r.reconciliation.exception_reasons[0].rows == 2 and r.dispute
    assert records.find_relation(rows, order_id="order_9").isEmpty()
    with pytest.raises(ValueError):
        records.find_relation(rows)


def test_audit(rows):
    r = records.audit_report(rows.filter("txn_id <> 'TXN003'")).first()
    assert (r.total_transactions, r.reconciled, r.exceptions, r.match_rate_pct) == (2, 1, 1, 50.0)
    empty = records.audit_report(rows.limit(0)).first()
    assert (empty.total_transactions, empty.match_rate_pct, empty.total_refund_amount) == (0, 0, 0)


def test_record_sentence(rows):
    got = {r.txn_id: r.text for r in similarity.index_texts(rows).collect()}
    assert got["TXN002"] == (
        "Transaction TXN002 for order order_2. Amount ₹700.0 via wallet. Reconciliation status:"
        " exception. Exception: unexplained — why. Exception: unexplained — why. Tax category:"
        " exempt. This transaction had a dispute. Settled in 2 day(s), status settled."
    )
    assert "Refunded amount: ₹300.0. Settled in None day(s), status refunded." in got["TXN003"]


def test_last_match_wins(spark):
    m = spark.createDataFrame(
        [("o1", "exact", "L9"), ("o1", "fuzzy", "L1"), ("", "fuzzy", "L2"), ("o2", "llm", "L3")],
        "order_id string, tier string, ledger_row_id string",
    )
    got = {r.order_id: r.matched_tier for r in records.last_match_per_order(m).collect()}
    assert got == {"o1": "fuzzy", "o2": "llm"}


def test_incremental_index(spark, rows):
    texts = similarity.index_texts(rows)
    embed = similarity.tfidf_embedder(similarity.tfidf_model(texts))
    index = similarity.extend_index(rows.filter("txn_id = 'TXN001'"), None, embed)
    more = similarity.extend_index(rows, index, embed)
    assert {r.txn_id for r in more.collect()} == {"TXN002", "TXN003"}
    whole = index.unionByName(more)
    assert similarity.changed_in_index(texts, whole).isEmpty()
    changed = rows.withColumn("status", F.lit("late")).filter("txn_id = 'TXN001'")
    assert similarity.changed_in_index(similarity.index_texts(changed), whole).count() == 1

    def embed_question(q):
        asked = spark.createDataFrame([(q,)], "text string")
        return list(embed(asked).first()["embedding"])

    context = ask.retrieve("Is my cash position fine after order_3?", rows, whole, embed_question)
    assert [r.txn_id for r in context.records.collect()] == ["TXN003"]
    assert context.forecast is None and context.cash_position.count() == 1
    context = ask.retrieve("wallet dispute", rows, whole, embed_question, max_records=2)
    assert context.records.first().txn_id == "TXN002" and context.cash_position is None
    assert context.stats.first().total_transactions == 3


def test_review_log(spark):
    log = [
        ("L1", "ledger", "o", "approved_match", None, "n", "r", at("2025-01-01T00:00"), 1),
        ("L1", "ledger", "o", "written_off", None, "n2", "r", at("2025-01-02T00:00"), 2),
        ("L2", "ledger", "o", "written_off", None, "n", "r", at("2025-01-01T00:00"), 3),
        ("L2", "ledger", None, reviews.REOPENED, None, None, None, at("2025-01-03T00:00"), 4),
        ("L1", "bank", "o", "approved_match", None, "n", "r", at("2025-01-01T00:00"), 5),
    ]
    df = spark.createDataFrame(log, REVIEW_LOG)
    got = {(r.row_id, r.side): r.decision for r in reviews.latest_decisions(df).collect()}
    assert got == {("L1", "ledger"): "written_off", ("L1", "bank"): "approved_match"}
    exceptions = spark.createDataFrame(
        [("L1", "ledger"), ("L2", "ledger"), ("L3", "ledger")], "row_id string, side string"
    )
    c = reviews.review_counts(exceptions, df).first()
    assert (c.total, c.pending, c.resolved) == (3, 2, 1)


def test_decision_validation(spark):
    df = spark.createDataFrame([
        ("a", "approved_match", None), ("b", "guess", None), ("c", "manually_paired", ""),
        ("d", "manually_paired", "B1"), ("e", None, None),
    ], "row_id string, decision string, paired_row_id string")
    good, bad = reviews.validate_decisions(df)
    assert {r.row_id for r in good.collect()} == {"a", "d"}
    errors = {r.row_id: r.error for r in bad.collect()}
    assert set(errors) == {"b", "c", "e"} and "paired_row_id is required" in errors["c"]


def test_decisions_survive_a_refresh(spark, tmp_path):
    store = tables.Store(spark, str(tmp_path / "store"))
    store.init()
    ask_ = lambda decision: reviews.decide(spark.createDataFrame(
        [("L1", "ledger", decision)], "row_id string, side string, decision string"
    ).withColumn("paired_row_id", F.lit(None).cast("string")))[0]
    store.append("reconciliation_reviews", ask_("approved_match"))
    store.append("reconciliation_reviews", ask_("written_off"))
    exceptions = spark.createDataFrame([("L1", "ledger", "o", "r", "e")], EXCEPTIONS)
    store.replace("reconciliation_exceptions", exceptions)
    log = store.load("reconciliation_reviews")
    assert [r.decision for r in reviews.latest_decisions(log).collect()] == ["written_off"]
    assert reviews.review_counts(store.load("reconciliation_exceptions"), log).first().resolved == 1
    store.append("reconciliation_reviews", reviews.reopen(log.select("row_id", "side").distinct()))
    assert reviews.latest_decisions(store.load("reconciliation_reviews")).isEmpty()


def one(spark, value, kind, expression):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


@pytest.mark.parametrize("value, full, short", [
    (1337548.0, "₹13,37,548.00", "₹13.38L"), (999.5, "₹999.50", "₹1000"),
    (12345.0, "₹12,345.00", "₹12.3k"), (12_500_000.0, "₹1,25,00,000.00", "₹1.25Cr"),
    (-1500.0, "₹-1,500.00", "-₹1.5k"), (100000.0, "₹1,00,000.00", "₹1.00L"),
])
def test_rupee_texts(spark, value, full, short):
    assert one(spark, value, "double", money.inr_full) == full
    assert one(spark, value, "double", money.inr_short) == short


def test_small_texts(spark):
    assert one(spark, 0.8523, "double", money.percent_text) == "85.2%"
    assert one(spark, 0.24, "double", money.signed_percent_text) == "+24.0%"
    assert one(spark, 1.26, "double", money.hours_text) == "1.3h"
    assert one(spark, 9e-13, "double", money.drift_text) == "₹0.00"
    assert one(spark, -2.5, "double", money.drift_text) == "-₹2.50"
    assert one(spark, 1234567, "long", money.count_text) == "12,34,567"


@pytest.mark.parametrize("answer, want", [
    ('```json\n{"a": 1}\n```', '{"a": 1}'), ('sure: {"a": [1, 2,],} done', '{"a": [1, 2]}'),
    ("{'a' : 1}", '{"a": 1}'), ("[1, 2", None), ("“x”", '"x"'), ("no", None),
])
def test_json_cleanup(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "v string")
    assert text.with_clean_json(df, "v").first()["json"] == want


def test_questions(spark):
    q = "See order_A1_b, TXN0042 and XTXN5; Upcoming CashFlow?"
    assert one(spark, q, "string", text.ids_in) == ["order_A1_b", "TXN0042"]
    assert one(spark, q, "string", text.is_forward_looking)
    assert one(spark, q, "string", text.is_cash_question)


@pytest.mark.parametrize("kind", ["float", "double", "int"])
def test_score_of_few_entries_equals_the_whole_product(spark, kind):
    from paisaflow.functions.vectors import dot

    inf, nan = float("inf"), float("nan")
    odd = [
        [0.1, 0.2, 0.3, 0.7], [-0.0, 0.0, -0.0, 1e-300], [1e38, -3.3, 1e-40, 2.0], [0.1, None, 0.3, 0.7], [0.1, 0.2, 0.3, None],
        [0.1, inf, 0.3, 0.7], [0.1, -inf, 0.3, 0.7], [0.1, nan, 0.3, 0.7], [inf, 0.2, 0.3, -inf], [0.1, 0.2, 0.3],
        [0.1, 0.2, 0.3, 0.7, 0.9], [], None, [None] * 4,
    ]
    if kind == "int":
        odd = [[1, 2, 3, 4], [1, None, 3, 4], [], None]
    rows = spark.createDataFrame(list(enumerate(odd)), f"txn_id long, embedding array<{kind}>")
    for query in ([0.3, 0.0, 0.0, -1.7], [0.0] * 4, [0.1, 0.2, 0.3, 0.4], [0.0, nan, 0.0, 0.0], [inf, 0.0, 0.0, 0.0], []):
        whole = dot(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
        found = rows.select(similarity.score(rows, query).alias("got"), whole.alias("want")).collect()
        assert [repr(r.got) for r in found] == [repr(r.want) for r in found], query
    ranked = similarity.top_k(rows, [0.3, 0.0, 0.0, -1.7], 20).count()
    assert ranked == len(odd)


def test_score_of_few_entries_reads_no_other(spark):
    rows = spark.createDataFrame([(1, [0.6, 0.8])], "txn_id long, embedding array<float>")
    plan = lambda q: rows.select(similarity.score(rows, q))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan([0.5, 0.0]).upper()
    assert "CASE WHEN" not in plan([0.5] * 65).upper()
