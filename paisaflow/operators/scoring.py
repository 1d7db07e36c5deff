"""Matches scored against held-out truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions.frames import one_row


def judge_pairs(matches: DataFrame, owner: DataFrame) -> DataFrame:
    """Matches with the transaction both rows belong to, null when they do not agree."""
    side = lambda name: owner.select(
        F.col("row_id").alias(f"{name}_row_id"), F.col("txn_id").alias(f"{name}_txn")
    )
    joined = matches.join(side("ledger"), "ledger_row_id", "left").join(
        side("bank"), "bank_row_id", "left"
    )
    agreed = F.when(F.col("ledger_txn") == F.col("bank_txn"), F.col("ledger_txn"))
    return joined.select(*matches.columns, agreed.alias("txn_id"))


def found_txns(judged: DataFrame) -> DataFrame:
    return judged.filter(F.col("txn_id").isNotNull()).select("txn_id").distinct()


def _share(part: str, *whole: str) -> Column:
    total = sum((F.col(w) for w in whole[1:]), F.col(whole[0]))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(F.col(part) / total, 4))


def score(
    matches: DataFrame, exceptions: DataFrame, truth: DataFrame, owner: DataFrame
) -> DataFrame:
    """One row of figures. Recall counts only what should reconcile; right pairs elsewhere
    are reported as ``ambiguous_resolved``."""
    judged = judge_pairs(matches, owner)
    hits = found_txns(judged).withColumn("found", F.lit(True))
    should, found = F.col("should_fully_reconcile"), F.coalesce("found", F.lit(False))
    over_truth = truth.select("txn_id", "should_fully_reconcile").join(hits, "txn_id", "left").agg(
        F.count("*").alias("total_ground_truth_txns"),
        F.count_if(should).alias("should_fully_reconcile"),
        F.count_if(found).alias("true_positives"),
        F.count_if(found & should).alias("recall_true_positives"),
        F.count_if(~found & should).alias("false_negatives"),
    )
    over_matches = judged.agg(
        F.count("*").alias("reported_matches"),
        F.count_if(F.col("txn_id").isNull()).alias("false_positives"),
    )
    over_exceptions = exceptions.agg(F.count("*").alias("exception_count"))
    figures = one_row(over_truth, over_matches, over_exceptions)
    return figures.select(
        "total_ground_truth_txns", "should_fully_reconcile", "reported_matches",
        "true_positives", "false_positives", "false_negatives",
        (F.col("true_positives") - F.col("recall_true_positives")).alias("ambiguous_resolved"),
        _share("true_positives", "true_positives", "false_positives").alias("precision"),
        _share("recall_true_positives", "should_fully_reconcile").alias("recall"),
        _share("reported_matches", "total_ground_truth_txns").alias("match_rate"),
        "exception_count",
    )


def false_negatives(matches: DataFrame, truth: DataFrame, owner: DataFrame) -> DataFrame:
    """Transactions that should reconcile and were not found."""
    should = truth.filter("should_fully_reconcile").select("txn_id")
    return should.join(found_txns(judge_pairs(matches, owner)), "txn_id", "left_anti")


def first_unresolved(missed: DataFrame, limit: int = 15) -> DataFrame:
    return missed.orderBy("txn_id").limit(limit)


def official_report(score_row: DataFrame) -> DataFrame:
    return score_row.select(
        F.round(F.col("match_rate") * 100, 2).alias("match_rate_pct"), "precision", "recall",
        "reported_matches", F.col("exception_count").alias("exception_rows_needing_review"),
    )


def unmatchable_count(score_row: DataFrame) -> DataFrame:
    """Transactions no engine should match."""
    return score_row.select(
        (F.col("total_ground_truth_txns") - F.col("should_fully_reconcile")).alias("unmatchable")
    )
