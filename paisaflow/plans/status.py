"""Row counts and gates of every stage as one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.functions.frames import one_row


def stage_status(
    base: DataFrame, ledger: DataFrame, bank: DataFrame, matches: DataFrame,
    exceptions: DataFrame, classifications: DataFrame, metrics: DataFrame | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """``metrics`` and ``index`` may be missing: those stages are then pending."""
    def rows(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    parts = [
        rows(base, "total_transactions"), rows(ledger, "ledger_rows"), rows(bank, "bank_rows"),
        rows(matches, "matches"), rows(exceptions, "exceptions"),
        classifications.agg(
            F.count("*").alias("classified"),
            F.count_if(F.col("method") == "rule").alias("resolved_by_rules"),
            F.count_if(F.col("method") == "llm").alias("resolved_by_llm"),
        ),
    ]
    if metrics is not None:
        needed = ("model_a", "model_b_fee", "model_b_refund")
        parts.append(metrics.agg(
            F.count_distinct(F.when(F.col("label").isin(*needed), F.col("label")))
            .alias("core_models")
        ))
    if index is not None:
        parts.append(rows(index, "indexed_records"))
    counts = one_row(*parts)
    for name in ("core_models", "indexed_records"):
        if name not in counts.columns:
            counts = counts.withColumn(name, F.lit(0).cast("bigint"))

    def gate(passed, name: str):
        return F.when(passed, "passed").otherwise("pending").alias(name)

    return counts.select(
        "*", gate(F.col("total_transactions") > 0, "ingest_gate"),
        gate(F.col("matches") + F.col("exceptions") > 0, "reconcile_gate"),
        gate(F.col("classified") > 0, "classify_gate"),
        gate(F.col("core_models") == 3, "forecast_gate"),
        gate(F.col("indexed_records") > 0, "qa_gate"),
    )
