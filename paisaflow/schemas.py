"""Declared schemas and the fixed business values every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


STR, DBL, INT, LNG, BOOL = (
    T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType(),
)
TS = T.TimestampNTZType()

# --- stored tables -----------------------------------------------------------

BASE_TRANSACTIONS = _struct(
    ("txn_id", STR), ("source", STR), ("gateway_payment_id", STR), ("order_id", STR),
    ("txn_amount", DBL), ("payment_method", STR), ("created_at", TS), ("day_of_week", INT),
    ("is_weekend_or_holiday", BOOL), ("merchant_category", STR), ("had_dispute_flag", BOOL),
    ("had_refund", BOOL), ("refund_amount", DBL), ("gst_on_fee_flag", BOOL),
    ("fee_amount", DBL), ("fee_amount_pending", BOOL), ("tax_on_fee", DBL), ("fee_pct", DBL),
    ("days_to_settle", INT), ("deduction_pct", DBL), ("settled_at", TS), ("status", STR),
    ("true_tax_category", STR),
)

LEDGER_ROWS = _struct(
    ("row_id", STR), ("txn_id_hint", STR), ("order_id", STR), ("amount", DBL),
    ("timestamp", TS), ("payment_method", STR), ("status", STR), ("fee_amount", DBL),
    ("tax_on_fee", DBL), ("refund_amount", DBL), ("narration", STR),
)

BANK_ROWS = _struct(
    ("row_id", STR), ("txn_id_hint", STR), ("order_id", STR), ("amount", DBL),
    ("timestamp", TS), ("utr_reference", STR), ("type", STR), ("narration", STR),
)

GROUND_TRUTH = _struct(
    ("txn_id", STR), ("order_id", STR), ("ledger_row_ids", T.ArrayType(STR)),
    ("bank_row_ids", T.ArrayType(STR)), ("ledger_mismatch", STR), ("bank_mismatch", STR),
    ("should_fully_reconcile", BOOL), ("reconcile_verdict", STR),
)

GROUND_TRUTH_ROWS = _struct(("txn_id", STR), ("side", STR), ("kind", STR), ("row_id", STR))

MATCHES = _struct(
    ("ledger_row_id", STR), ("bank_row_id", STR), ("order_id", STR), ("tier", STR),
    ("amount_diff", DBL), ("timestamp_diff_hours", DBL), ("explanation", STR),
)

EXCEPTIONS = _struct(
    ("row_id", STR), ("side", STR), ("order_id", STR), ("reason", STR), ("explanation", STR),
)

REVIEW_LOG = _struct(
    ("row_id", STR), ("side", STR), ("order_id", STR), ("decision", STR),
    ("paired_row_id", STR), ("note", STR), ("reviewer", STR), ("decided_at", TS),
    ("seq", LNG),
)

TAX_CLASSIFICATIONS = _struct(
    ("txn_id", STR), ("category", STR), ("method", STR), ("reasoning", STR),
)

FORECASTER_METRICS = _struct(
    ("label", STR), ("target", STR), ("n_train", LNG), ("n_test", LNG), ("mae", DBL),
    ("mape_pct", DBL), ("chosen_model", STR), ("curvature_detected", BOOL),
)

RECORD_EMBEDDINGS = _struct(
    ("txn_id", STR), ("text", STR), ("embedding", T.ArrayType(T.FloatType())),
)

TABLES: dict[str, T.StructType] = {
    "base_transactions": BASE_TRANSACTIONS,
    "ledger_rows": LEDGER_ROWS,
    "bank_rows": BANK_ROWS,
    "ground_truth": GROUND_TRUTH,
    "ground_truth_rows": GROUND_TRUTH_ROWS,
    "reconciliation_matches": MATCHES,
    "reconciliation_exceptions": EXCEPTIONS,
    "reconciliation_reviews": REVIEW_LOG,
    "tax_classifications": TAX_CLASSIFICATIONS,
    "forecaster_metrics": FORECASTER_METRICS,
    "record_embeddings": RECORD_EMBEDDINGS,
}

# --- in-flight rows ----------------------------------------------------------

TXN = _struct(
    ("source", STR), ("source_id", STR), ("order_id", STR), ("amount", DBL),
    ("currency", STR), ("method", STR), ("status", STR), ("fee", DBL), ("tax_on_fee", DBL),
    ("settled_at", TS), ("created_at", TS), ("narration", STR), ("raw_tax_on_fee", DBL),
    ("refund_amount", DBL), ("utr_reference", STR),
)

RESOLUTIONS = _struct(
    ("row_id", STR), ("resolution", STR), ("matched_row_id", STR), ("explanation", STR),
)

TAX_ANSWERS = _struct(("txn_id", STR), ("category", STR), ("reasoning", STR))


@dataclass(frozen=True)
class Tolerance:
    """Amount and time band of one matching tier."""

    amount_abs: float
    amount_pct: float
    hours: float


# The bands, labels and texts below are part of the expected results.
EXACT_TOLERANCE = Tolerance(amount_abs=5.0, amount_pct=0.015, hours=6)
FUZZY_TOLERANCE = Tolerance(amount_abs=30.0, amount_pct=0.08, hours=96)
TIER_TOLERANCES = {"exact": EXACT_TOLERANCE, "fuzzy": FUZZY_TOLERANCE}
TIER_ORDER = ("exact", "fuzzy", "llm")

HOLIDAYS = (
    "2025-01-26", "2025-03-14", "2025-04-18", "2025-05-01",
    "2025-08-15", "2025-10-02", "2025-10-21", "2025-12-25",
)

TAX_CATEGORIES = ("refund_credit_note", "exempt", "gst_on_fee", "taxable_sale")
REVIEW_DECISIONS = ("approved_match", "written_off", "manually_paired")

DEFAULT_EXCEPTION_REASON = "unexplained"
DEFAULT_EXCEPTION_EXPLANATION = (
    "No confident resolution from automated matching or LLM reasoning."
)
DEFAULT_TAX_REASONING = "LLM did not return a usable classification."

FORWARD_LOOKING_KEYWORDS = (
    "forecast", "upcoming", "next week", "next 7", "expect", "will i",
    "going to", "future", "projection", "cash flow", "cashflow",
)
CASH_POSITION_KEYWORDS = (
    "cash position", "current cash", "projected cash", "net cash",
    "how much cash", "cash flow", "cashflow",
)
ID_PATTERN = r"\b(?:order_[A-Za-z0-9_]+|TXN\d+)\b"
DEFAULT_CURRENT_CASH = 1_000_000.0
