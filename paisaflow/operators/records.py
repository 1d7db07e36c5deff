"""The settlement record: one row per transaction with everything known about it."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions.frames import one_row
from paisaflow.functions.money import money_sum
from paisaflow.schemas import TIER_ORDER


class SearchResult(NamedTuple):
    totals: DataFrame
    rows: DataFrame


def last_match_per_order(matches: DataFrame) -> DataFrame:
    """The tier of an order's last match; later tiers, then higher ledger ids, win."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIER_ORDER]), F.col("tier"))
    return matches.filter(F.coalesce("order_id", F.lit("")) != "").groupBy("order_id").agg(
        F.max(F.struct(rank.alias("rank"), "ledger_row_id", "tier")).alias("m")
    ).select("order_id", F.col("m.tier").alias("matched_tier"))


def reasons_per_order(exceptions: DataFrame) -> DataFrame:
    """An order's exception reasons with row counts. Equal reasons combine before the shuffle,
    so an order with very many exception rows stays small. Blank orders, which may be very
    many rows, belong to no record."""
    named = exceptions.filter(F.coalesce("order_id", F.lit("")) != "")
    counted = named.groupBy("order_id", "reason", "explanation").agg(
        F.count("*").alias("rows")
    )
    return counted.groupBy("order_id").agg(
        F.array_sort(F.collect_list(F.struct("reason", "explanation", "rows"))).alias("reasons")
    )


def settlement_records(
    base: DataFrame, matches: DataFrame, exceptions: DataFrame, tax: DataFrame
) -> DataFrame:
    joined = (
        base.join(last_match_per_order(matches), "order_id", "left")
        .join(reasons_per_order(exceptions), "order_id", "left")
        .join(
            tax.select(
                "txn_id", F.col("category").alias("tax_category"),
                F.col("reasoning").alias("tax_reasoning"),
            ), "txn_id", "left",
        )
    )
    matched = F.col("matched_tier").isNotNull()
    return joined.select(
        *base.columns,
        F.when(matched, "matched").when(F.col("reasons").isNotNull(), "exception")
        .otherwise("no_settlement_data").alias("reconciliation_status"),
        F.col("matched_tier").alias("reconciliation_tier"),
        F.when(~matched, F.col("reasons")).alias("reconciliation_reasons"),
        "tax_category", "tax_reasoning",
    )


# --- searches ----------------------------------------------------------------


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    """The first rows by transaction id; no limit and zero both mean ten."""
    return rows.orderBy("txn_id").limit(limit or 10)


def _equal(rows: DataFrame, **wanted: str | None) -> DataFrame:
    for column, value in wanted.items():
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows


def search_payments(
    records: DataFrame,
    order_id: str | None = None,
    txn_id: str | None = None,
    payment_method: str | None = None,
    had_refund: bool | None = None,
    had_dispute_flag: bool | None = None,
    limit: int | None = None,
) -> SearchResult:
    rows = _equal(records, order_id=order_id, txn_id=txn_id, payment_method=payment_method)
    for column, flag in (("had_refund", had_refund), ("had_dispute_flag", had_dispute_flag)):
        if flag is not None:
            rows = rows.filter(F.coalesce(column, F.lit(False)) == flag)
    columns = (
        "txn_id", "order_id", "txn_amount", "payment_method", "created_at", "status",
        "had_refund", "refund_amount", "had_dispute_flag", "reconciliation_status",
    )
    return SearchResult(
        rows.agg(F.count("*").alias("total_matched")), _first(rows.select(*columns), limit)
    )


def search_settlements(
    records: DataFrame,
    order_id: str | None = None,
    txn_id: str | None = None,
    settled_after: str | None = None,
    settled_before: str | None = None,
    limit: int | None = None,
) -> SearchResult:
    """Bounds compare as ISO text does: a bare ``settled_before`` date ends at its midnight."""
    rows = records.filter((F.col("status") == "settled") & F.col("settled_at").isNotNull())
    rows = _equal(rows, order_id=order_id, txn_id=txn_id)
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    if settled_after:
        rows = rows.filter(F.col("settled_at") >= at(settled_after))
    if settled_before:
        bare = re.fullmatch(r"\d{4}-\d{2}-\d{2}", settled_before)
        end = at(settled_before)
        rows = rows.filter(F.col("settled_at") < end if bare else F.col("settled_at") <= end)
    columns = (
        "txn_id", "order_id", "txn_amount", "settled_at", "days_to_settle", "fee_amount",
        "tax_on_fee",
    )
    totals = rows.agg(
        F.count("*").alias("total_matched"),
        F.coalesce(money_sum(F.col("txn_amount")), F.lit(0.0)).alias("total_settlement_amount"),
    )
    return SearchResult(totals, _first(rows.select(*columns), limit))


def search_invoices(
    records: DataFrame,
    txn_id: str | None = None,
    category: str | None = None,
    limit: int | None = None,
) -> SearchResult:
    rows = records.filter(F.coalesce("tax_category", F.lit("")) != "")
    rows = _equal(rows, txn_id=txn_id, tax_category=category)
    columns = ("txn_id", "order_id", "txn_amount", "tax_category", "tax_reasoning")
    return SearchResult(
        rows.agg(F.count("*").alias("total_matched")), _first(rows.select(*columns), limit)
    )


def find_relation(
    records: DataFrame, order_id: str | None = None, txn_id: str | None = None
) -> DataFrame:
    """The first record with either id as one nested answer; no row means not found."""
    if not order_id and not txn_id:
        raise ValueError("Neither an order nor a transaction is named.")
    wanted = F.lit(False)
    if order_id:
        wanted = wanted | (F.col("order_id") == order_id)
    if txn_id:
        wanted = wanted | (F.col("txn_id") == txn_id)
    return records.filter(wanted).orderBy("txn_id").limit(1).select(
        F.struct(
            "txn_id", "order_id", "txn_amount", "payment_method", "created_at", "status"
        ).alias("transaction"),
        F.struct(
            F.col("reconciliation_status").alias("status"),
            F.col("reconciliation_tier").alias("tier"),
            F.col("reconciliation_reasons").alias("exception_reasons"),
        ).alias("reconciliation"),
        F.struct(
            F.col("tax_category").alias("category"), F.col("tax_reasoning").alias("reasoning")
        ).alias("tax_classification"),
        F.when(F.col("had_refund"), F.struct(F.col("refund_amount").alias("amount")))
        .alias("refund"),
        F.when(F.col("had_dispute_flag"), F.lit(True)).alias("dispute"),
    )


# --- reports -----------------------------------------------------------------


def _totals() -> list[Column]:
    status = F.col("reconciliation_status")
    matched = F.count_if(status == "matched")
    return [
        F.count("*").alias("total_transactions"), matched.alias("reconciled"),
        F.count_if(status == "exception").alias("exceptions"),
        F.count_if(F.coalesce("had_dispute_flag", F.lit(False))).alias("disputed_count"),
        F.count_if(F.coalesce("had_refund", F.lit(False))).alias("refunded_count"),
        F.coalesce(money_sum(F.col("refund_amount")), F.lit(0.0)).alias("total_refund_amount"),
    ]


def aggregate_stats(records: DataFrame) -> DataFrame:
    return records.agg(*_totals())


def breakdowns(records: DataFrame) -> DataFrame:
    """Counts by tax category and by payment method, in one pass over the records."""
    keyed = records.select(
        F.coalesce("tax_category", F.lit("unclassified")).alias("tax_category"),
        F.coalesce("payment_method", F.lit("unknown")).alias("payment_method"),
    )
    keyed = keyed.groupBy("tax_category", "payment_method").agg(F.count("*").alias("n"))
    by = lambda c: keyed.groupBy(F.lit(c).alias("breakdown"), F.col(c).alias("value")).agg(
        F.sum("n").alias("txns")
    )
    return by("tax_category").unionByName(by("payment_method"))


def audit_report(
    records: DataFrame,
    reconciliation_summary: DataFrame | None = None,
    tax_summary: DataFrame | None = None,
    cash_position: DataFrame | None = None,
) -> DataFrame:
    """One row over all records; given one-row summaries are passed through beside it."""
    totals = records.agg(*_totals()).withColumn(
        "match_rate_pct",
        F.when(F.col("total_transactions") == 0, F.lit(0.0)).otherwise(
            F.round(100 * F.col("reconciled") / F.col("total_transactions"), 2)
        ),
    )
    parts = [totals]
    for name, frame in (
        ("validated", reconciliation_summary), ("tax", tax_summary), ("cash", cash_position)
    ):
        if frame is not None:
            parts.append(frame.select(*[F.col(c).alias(f"{name}_{c}") for c in frame.columns]))
    return one_row(*parts)
