"""Held-out truth: which rows belong to which transaction and what a matcher should do.

Rows are stored long: one ``(txn_id, side, kind, row_id)`` row per export row. Owners come from
there; ``nest_row_ids`` is a view of it with the row ids of a transaction in arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Kinds that decide the verdict.
NO_COUNTERPART_KINDS = ("missing",)
AMBIGUOUS_KINDS = ("partial_settlement",)


def verdict(ledger_kind: Column, bank_kind: Column) -> Column:
    either = lambda kinds: ledger_kind.isin(*kinds) | bank_kind.isin(*kinds)
    return (
        F.when(either(NO_COUNTERPART_KINDS), "no_counterpart")
        .when(either(AMBIGUOUS_KINDS), "ambiguous")
        .otherwise("must_match")
    )


def build_ground_truth(
    base: DataFrame, ledger_kinds: DataFrame, bank_kinds: DataFrame
) -> DataFrame:
    """One truth row per transaction from the long mismatch rows of both sides."""

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("txn_id").agg(
            F.min("kind").alias(f"{name}_kind"), F.count("*").alias(f"n_{name}")
        )

    joined = (
        base.select("txn_id", "order_id")
        .join(side(ledger_kinds, "ledger"), "txn_id", "left")
        .join(side(bank_kinds, "bank"), "txn_id", "left")
    )
    kinds = joined.select(
        "txn_id", "order_id",
        F.coalesce("n_ledger", F.lit(0)).alias("ledger_row_count"),
        F.coalesce("n_bank", F.lit(0)).alias("bank_row_count"),
        F.coalesce("ledger_kind", F.lit("missing")).alias("ledger_mismatch"),
        F.coalesce("bank_kind", F.lit("missing")).alias("bank_mismatch"),
    )
    decided = verdict(F.col("ledger_mismatch"), F.col("bank_mismatch"))
    return kinds.select(
        "*", (decided == "must_match").alias("should_fully_reconcile"),
        decided.alias("reconcile_verdict"),
    )


def truth_rows(ledger_kinds: DataFrame, bank_kinds: DataFrame) -> DataFrame:
    """The stored rows of both sides."""
    side = lambda rows, name: rows.select("txn_id", F.lit(name).alias("side"), "kind", "row_id")
    return side(ledger_kinds, "ledger").unionByName(side(bank_kinds, "bank"))


def row_owner(rows: DataFrame) -> DataFrame:
    """``(row_id, txn_id)`` for every stored row."""
    return rows.select("row_id", "txn_id")


def nest_row_ids(truth: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per transaction with the ids of all its stored rows, for readers of one
    transaction; nothing in the library reads it back."""

    def arrays(name: str) -> DataFrame:
        return rows.filter(F.col("side") == name).groupBy("txn_id").agg(
            F.array_sort(F.collect_list("row_id")).alias(f"{name}_row_ids")
        )

    def or_empty(name: str) -> Column:
        none = F.array().cast("array<string>")
        return F.coalesce(f"{name}_row_ids", none).alias(f"{name}_row_ids")

    return (
        truth.join(arrays("ledger"), "txn_id", "left")
        .join(arrays("bank"), "txn_id", "left")
        .select(
            "txn_id", "order_id", or_empty("ledger"), or_empty("bank"), "ledger_mismatch",
            "bank_mismatch", "should_fully_reconcile", "reconcile_verdict",
        )
    )


def mismatch_combinations(truth: DataFrame) -> DataFrame:
    return (
        truth.groupBy("ledger_mismatch", "bank_mismatch").agg(F.count("*").alias("txns"))
        .orderBy(F.desc("txns"), "ledger_mismatch", "bank_mismatch")
    )


def verdict_breakdown(truth: DataFrame) -> DataFrame:
    return truth.groupBy(
        F.coalesce("reconcile_verdict", F.lit("must_match")).alias("reconcile_verdict")
    ).agg(F.count("*").alias("txns"))


def ingest_summary(truth: DataFrame) -> DataFrame:
    return truth.agg(
        F.count("*").alias("truth_txns"),
        F.count_if("should_fully_reconcile").alias("reconcilable_txns"),
    )
