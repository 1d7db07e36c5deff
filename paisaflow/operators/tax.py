"""Tax classification: rules first, external answers for what the rules decline."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions.text import float_text
from paisaflow.schemas import DEFAULT_TAX_REASONING, TAX_ANSWERS, TAX_CATEGORIES


class TaxResult(NamedTuple):
    classifications: DataFrame
    unresolved: DataFrame


def _fee() -> Column:
    """The fee as a number; text that is no number counts as missing."""
    return F.col("fee_amount").try_cast("double")


def rules() -> Column:
    """``struct(category, method, reasoning)``, null where the rules decline."""

    def verdict(category: str, reasoning: Column) -> Column:
        return F.struct(
            F.lit(category).alias("category"), F.lit("rule").alias("method"),
            reasoning.alias("reasoning"),
        )

    fee = _fee()
    declined = (
        F.coalesce("fee_amount_pending", F.lit(False)) | F.col("had_refund").isNull()
        | F.col("gst_on_fee_flag").isNull() | fee.isNull()
    )
    # Categories in priority order with their reasoning texts.
    return (
        F.when(declined, F.lit(None))
        .when(F.col("had_refund"), verdict("refund_credit_note", F.lit(
            "had_refund=True — refunded amount requires a credit-note adjustment."
        )))
        .when(~F.col("gst_on_fee_flag"), verdict("exempt", F.lit(
            "gst_on_fee_flag=False — this transaction's fee arrangement is GST-exempt."
        )))
        .when(fee > 0, verdict("gst_on_fee", F.concat(
            F.lit("Nonzero gateway fee ("), float_text(fee),
            F.lit(") with GST applicable — classified as GST-on-fee."),
        )))
        .otherwise(verdict("taxable_sale", F.lit(
            "No refund, no fee, GST-on-fee not applicable — standard taxable sale."
        )))
    )


def classify_by_rules(txns: DataFrame) -> DataFrame:
    return (
        txns.select("txn_id", rules().alias("r")).filter(F.col("r").isNotNull())
        .select("txn_id", "r.*")
    )


def fallback_items(txns: DataFrame) -> DataFrame:
    """What the rules decline, with a pending fee and its tax hidden."""
    pending = F.coalesce("fee_amount_pending", F.lit(False))
    return txns.filter(rules().isNull()).withColumns({
        "fee_amount": F.when(~pending, F.col("fee_amount")),
        "tax_on_fee": F.when(~pending, F.col("tax_on_fee")),
    })


def classify_by_answers(items: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """External answers ``txn_id, category, reasoning``; an unknown category is unresolved."""
    if answers is None:
        answers = items.sparkSession.createDataFrame([], TAX_ANSWERS)
    joined = items.select("txn_id").join(
        answers.select("txn_id", "category", "reasoning"), "txn_id", "left"
    )
    known = F.col("category").isin(*TAX_CATEGORIES)
    return joined.select(
        "txn_id",
        F.when(known, F.col("category")).otherwise("unresolved").alias("category"),
        F.lit("llm").alias("method"),
        F.coalesce("reasoning", F.lit(DEFAULT_TAX_REASONING)).alias("reasoning"),
    )


def classify(txns: DataFrame, answers: DataFrame | None = None) -> TaxResult:
    by_answer = classify_by_answers(fallback_items(txns), answers)
    return TaxResult(
        classify_by_rules(txns).unionByName(by_answer),
        by_answer.filter(F.col("category") == "unresolved"),
    )


def tax_summary(classifications: DataFrame) -> DataFrame:
    return classifications.groupBy("category").agg(
        F.count("*").alias("txns"),
        F.count_if(F.col("method") == "rule").alias("by_rules"),
        F.count_if(F.col("method") == "llm").alias("by_answers"),
    )


def tax_totals(classifications: DataFrame) -> DataFrame:
    return classifications.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("method") == "rule").alias("resolved_by_rules"),
        F.count_if(F.col("method") == "llm").alias("resolved_by_llm"),
        F.count_if(F.col("category") == "unresolved").alias("unresolved"),
    )


def tax_accuracy(classifications: DataFrame, base: DataFrame) -> DataFrame:
    joined = classifications.join(base.select("txn_id", "true_tax_category"), "txn_id", "left")
    right = F.count_if(F.col("category") == F.col("true_tax_category"))
    return joined.agg(
        right.alias("correct"), F.count("*").alias("total"),
        (right / F.count("*")).alias("accuracy"),
    )


def list_classifications(
    classifications: DataFrame, category: str | None = None, limit: int = 50
) -> tuple[DataFrame, DataFrame]:
    """(total before the limit, first rows by transaction id)."""
    rows = classifications
    if category:
        rows = rows.filter(F.col("category") == category)
    return rows.agg(F.count("*").alias("total")), rows.orderBy("txn_id").limit(limit)
