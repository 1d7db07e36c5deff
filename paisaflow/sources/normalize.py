"""Stored rows and gateway rows to the common in-flight shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions import times
from paisaflow.functions.money import zero_if_null
from paisaflow.schemas import TXN


def _conform(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Select the in-flight columns in order, typed nulls where a source has none."""
    return df.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TXN.fields
    ])


def ledger_to_txn(rows: DataFrame) -> DataFrame:
    """Ledger rows. The tax stays in the raw column only; the common field is null."""
    c = F.col
    return _conform(rows, {
        "source": F.lit("internal_ledger"), "source_id": c("row_id"), "order_id": c("order_id"),
        "amount": c("amount"), "currency": F.lit("INR"), "method": c("payment_method"),
        "status": c("status"), "fee": c("fee_amount"), "created_at": c("timestamp"),
        "narration": c("narration"), "raw_tax_on_fee": c("tax_on_fee"),
        "refund_amount": c("refund_amount"),
    })


def bank_to_txn(rows: DataFrame) -> DataFrame:
    c = F.col
    return _conform(rows, {
        "source": F.lit("bank_statement"), "source_id": c("row_id"), "order_id": c("order_id"),
        "amount": c("amount"), "currency": F.lit("INR"), "status": F.lit("credited"),
        "settled_at": c("timestamp"), "created_at": c("timestamp"),
        "narration": c("narration"), "utr_reference": c("utr_reference"),
    })


def _transaction(
    txns: DataFrame, prefix: str, refund: Column, tax: Column, pending: Column
) -> DataFrame:
    return txns.select(
        F.concat(F.lit(prefix), "source_id").alias("txn_id"), "order_id",
        F.col("amount").alias("txn_amount"),
        F.coalesce("method", F.lit("unknown")).alias("payment_method"), "created_at",
        F.weekday("created_at").alias("day_of_week"),
        times.is_weekend(F.col("created_at")).alias("is_weekend_or_holiday"),
        F.lit("unknown").alias("merchant_category"), F.lit(False).alias("had_dispute_flag"),
        (refund > 0).alias("had_refund"), refund.alias("refund_amount"),
        (tax > 0).alias("gst_on_fee_flag"), zero_if_null(F.col("fee")).alias("fee_amount"),
        pending.alias("fee_amount_pending"), tax.alias("tax_on_fee"),
        F.lit(None).cast("int").alias("days_to_settle"), "status",
    )


def ledger_txn_to_transaction(txns: DataFrame, prefix: str = "") -> DataFrame:
    """A ledger row as a transaction; what an export cannot know gets an inert default."""
    return _transaction(
        txns, prefix, zero_if_null(F.col("refund_amount")),
        zero_if_null(F.col("raw_tax_on_fee")), F.lit(False),
    )


def gateway_txn_to_transaction(txns: DataFrame, prefix: str = "") -> DataFrame:
    """A gateway payment as a transaction; here a missing fee really is pending."""
    return _transaction(
        txns.filter(F.col("created_at").isNotNull()), prefix,
        zero_if_null(F.col("refund_amount")), zero_if_null(F.col("tax_on_fee")),
        F.col("fee").isNull(),
    )


def date_range(*txns: DataFrame) -> DataFrame:
    """First and last day over all given frames; nulls when they are empty."""
    days = None
    for t in txns:
        part = t.select(F.to_date("created_at").alias("d"))
        days = part if days is None else days.unionByName(part)
    return days.agg(F.min("d").alias("start_date"), F.max("d").alias("end_date"))
