"""Next-day baselines, the cash position and the zero-filled cash-flow forecast."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions.frames import one_row
from paisaflow.functions.money import money_sum, net_settlement
from paisaflow.functions.times import plus_days
from paisaflow.schemas import DEFAULT_CURRENT_CASH

NAIVE = "naive_previous_day"


def _latest_day(df: DataFrame, day: Column, amount: Column, note: str) -> DataFrame:
    """One row: the total of the latest day as tomorrow's value."""
    per_day = df.filter(day.isNotNull()).groupBy(day.alias("day")).agg(
        money_sum(amount).alias("total")
    )
    last = per_day.agg(F.max("day").alias("day"), F.max_by("total", "day").alias("total"))
    return last.select(
        F.coalesce("total", F.lit(0.0)).alias("value"), F.lit(NAIVE).alias("method"),
        F.date_add("day", 1).alias("forecast_date"), F.col("day").alias("based_on_date"),
        F.when(F.col("day").isNull(), note).alias("note"),
    )


def next_day_refunds(base: DataFrame) -> DataFrame:
    return _latest_day(
        base, F.to_date("created_at"), F.coalesce("refund_amount", F.lit(0.0)),
        "No transaction history available.",
    )


def next_day_settlement(base: DataFrame) -> DataFrame:
    return _latest_day(
        base.filter(F.col("status") == "settled"), F.to_date("settled_at"), net_settlement(),
        "No settled transaction history available.",
    )


def cash_position(base: DataFrame, current_cash: float = DEFAULT_CURRENT_CASH) -> DataFrame:
    """projected cash = current cash + expected settlement - expected refunds."""
    def part(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.col("value").alias(f"expected_{name}"), F.col("method").alias(f"{name}_method"),
            F.col("based_on_date").alias(f"{name}_based_on"),
            F.col("forecast_date").alias(f"{name}_date"),
        )

    both = one_row(
        part(next_day_settlement(base), "settlement"), part(next_day_refunds(base), "refunds")
    )
    paise = lambda c: c.cast("decimal(18,2)")
    flow = paise(F.col("expected_settlement")) - paise(F.col("expected_refunds"))
    cash = paise(F.lit(float(current_cash)))
    return both.select(
        cash.cast("double").alias("current_cash"), "expected_settlement", "expected_refunds",
        flow.cast("double").alias("expected_net_cash_flow"),
        (cash + flow).cast("double").alias("projected_cash"),
        F.coalesce("settlement_date", "refunds_date").alias("forecast_date"),
        "settlement_method", "settlement_based_on", "refunds_method", "refunds_based_on",
    )


def default_reference_date(base: DataFrame) -> dt.date:
    """The day after the last transaction."""
    return base.agg(F.date_add(F.max(F.to_date("created_at")), 1).alias("d")).first()["d"]


def cashflow_forecast(
    predicted: DataFrame,
    deduction_error: float = 0.0,
    reference_date: dt.date | str | None = None,
    horizon_days: int = 7,
) -> DataFrame:
    """Expected net inflow per day with its band, every day of the horizon present.

    ``predicted`` has created_at, txn_amount, predicted_days_to_settle and
    predicted_deduction_pct. The band moves the deduction by ``deduction_error``.
    """
    if reference_date is None:
        reference_date = default_reference_date(predicted)
    first = F.to_date(F.lit(str(reference_date)))
    amount, cut = F.col("txn_amount"), F.col("predicted_deduction_pct")
    error, one, zero = F.lit(float(deduction_error)), F.lit(1.0), F.lit(0.0)
    settle = F.to_date(plus_days(F.col("created_at"), F.col("predicted_days_to_settle")))
    landing = predicted.select(
        settle.alias("date"), (amount * (one - cut)).alias("net"),
        (amount * (one - F.least(one, cut + error))).alias("low"),
        (amount * (one - F.greatest(zero, cut - error))).alias("high"),
    ).filter((F.col("date") >= first) & (F.col("date") < F.date_add(first, horizon_days)))
    fine = lambda c: F.sum(F.col(c).cast("decimal(28,8)"))
    sums = landing.groupBy("date").agg(
        fine("net").alias("net"), fine("low").alias("low"), fine("high").alias("high")
    )
    days = predicted.sparkSession.range(horizon_days).select(
        F.date_add(first, F.col("id").cast("int")).alias("date")
    )
    filled = lambda c: F.round(F.coalesce(c, F.lit(0)), 2).cast("double")
    return days.join(sums, "date", "left").select(
        "date", filled("net").alias("expected_amount"), filled("low").alias("lower_bound"),
        filled("high").alias("upper_bound"),
    ).orderBy("date")


def window_total(forecast: DataFrame) -> DataFrame:
    return forecast.agg(money_sum(F.col("expected_amount")).alias("window_expected"))
