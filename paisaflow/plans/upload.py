"""An uploaded ledger and bank export, or a gateway dump, taken through every stage."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from paisaflow.functions.frames import one_row
from paisaflow.operators.tax import classify, tax_totals
from paisaflow.plans.cash import cashflow_forecast
from paisaflow.plans.forecast import predict_transactions, to_features
from paisaflow.plans.reconcile import Reconciliation, reconcile
from paisaflow.sources.normalize import (
    date_range, gateway_txn_to_transaction, ledger_txn_to_transaction,
)


class Models(NamedTuple):
    days: PipelineModel
    fee: PipelineModel
    refund: PipelineModel
    deduction_error: float


class UploadResult(NamedTuple):
    summary: DataFrame
    records: DataFrame
    classifications: DataFrame
    exceptions: DataFrame | None
    forecast: DataFrame | None


def flag_matched(records: DataFrame, ledger: DataFrame, matches: DataFrame, prefix: str) -> DataFrame:
    """Each record ``matched`` when its ledger row is in a match, else ``exception``."""
    hit = matches.select(
        F.concat(F.lit(prefix), "ledger_row_id").alias("txn_id"), F.lit(True).alias("hit")
    ).distinct()
    return records.join(hit, "txn_id", "left").withColumn(
        "reconciliation_status", F.when(F.col("hit"), "matched").otherwise("exception")
    ).drop("hit")


def upload_summary(ledger: DataFrame, bank: DataFrame, outcome: Reconciliation) -> DataFrame:
    tier = F.col("tier")
    summary = one_row(
        ledger.agg(F.count("*").alias("total_ledger_rows")),
        bank.agg(F.count("*").alias("total_bank_rows")),
        outcome.matches.agg(
            F.count("*").alias("matched"), F.count_if(tier == "exact").alias("exact"),
            F.count_if(tier == "fuzzy").alias("fuzzy"), F.count_if(tier == "llm").alias("llm"),
        ),
        outcome.exceptions.agg(F.count("*").alias("exception_count")),
        date_range(ledger, bank),
    )
    return summary.withColumn(
        "matched_share", F.try_divide(F.col("matched"), F.col("total_ledger_rows"))
    )


def _forecast(records: DataFrame, models: Models | None) -> DataFrame | None:
    if models is None or records.isEmpty():
        return None
    predicted = predict_transactions(
        to_features(records), models.days, models.fee, models.refund
    )
    return cashflow_forecast(predicted, models.deduction_error)


def run_upload(
    ledger: DataFrame, bank: DataFrame, models: Models | None = None, prefix: str = "",
    resolutions: DataFrame | None = None,
) -> UploadResult:
    """``ledger`` and ``bank`` are parsed in-flight rows."""
    outcome = reconcile(ledger, bank, resolutions)
    records = flag_matched(
        ledger_txn_to_transaction(ledger, prefix), ledger, outcome.matches, prefix
    )
    tax = classify(records).classifications
    summary = one_row(upload_summary(ledger, bank, outcome), tax_totals(tax))
    return UploadResult(summary, records, tax, outcome.exceptions, _forecast(records, models))


def run_gateway(
    txns: DataFrame, models: Models | None = None, prefix: str = ""
) -> UploadResult:
    """A gateway is its own record: nothing to reconcile against."""
    records = gateway_txn_to_transaction(txns, prefix).withColumn(
        "reconciliation_status", F.lit("not_applicable")
    )
    tax = classify(records).classifications
    summary = one_row(
        records.agg(F.count("*").alias("transactions_fetched")),
        date_range(txns.filter(F.col("created_at").isNotNull())), tax_totals(tax),
    )
    return UploadResult(summary, records, tax, None, _forecast(records, models))
