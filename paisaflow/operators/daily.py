"""Daily totals and the lag, rolling and next-day columns built on them.

Totals come from a distributed aggregation; the windows then run over one row per observed
day, a few thousand rows for decades of data. Gaps are not filled: lags count observed days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paisaflow.functions.money import exact, net_settlement
from paisaflow.functions.times import is_weekend

DAY = Window.orderBy


def _daily(df: DataFrame, day: Column, total: Column, count: Column, names: tuple[str, str]):
    return df.filter(day.isNotNull()).groupBy(day.alias("date")).agg(
        F.sum(exact(total)).cast("double").alias(names[0]),
        count.cast("bigint").alias(names[1]),
    )


def daily_gmv(base: DataFrame) -> DataFrame:
    amount = F.col("txn_amount")
    return _daily(
        base, F.to_date("created_at"), amount, F.count(amount), ("total_gmv", "txn_count")
    )


def daily_refunds(base: DataFrame) -> DataFrame:
    return _daily(
        base, F.to_date("created_at"), F.col("refund_amount"),
        F.sum(F.col("had_refund").cast("int")), ("total_refunds", "refund_count"),
    )


def daily_settlement_gross(base: DataFrame) -> DataFrame:
    amount = F.col("txn_amount")
    return _daily(
        base, F.to_date("settled_at"), amount, F.count(amount),
        ("total_settlement", "settlement_count"),
    )


def daily_settlement_net(base: DataFrame) -> DataFrame:
    """Settled rows only, net of refund, fee and tax."""
    net = net_settlement()
    return _daily(
        base.filter(F.col("status") == "settled"), F.to_date("settled_at"), net, F.count(net),
        ("total_settlement", "settlement_count"),
    )


def _rolling_mean(c: Column, rows: int) -> Column:
    """Mean of the ``rows`` days before the current one; null until all exist."""
    w = Window.orderBy("date").rowsBetween(-rows, -1)
    return F.when(
        F.count(c).over(w) == rows, F.sum(exact(c)).over(w).cast("double") / F.lit(rows)
    )


def with_history(daily: DataFrame, total: str, count: str, prefix: str, count_prefix: str,
                 target: str) -> DataFrame:
    """Seven columns that end the day before, and the next day's total as target."""
    w = Window.orderBy("date")
    t, n = F.col(total), F.col(count)
    return daily.withColumns({
        f"{prefix}_lag_1": F.lag(t, 1).over(w),
        f"{prefix}_lag_7": F.lag(t, 7).over(w),
        f"{prefix}_rolling_7": _rolling_mean(t, 7),
        f"{prefix}_rolling_30": _rolling_mean(t, 30),
        f"{count_prefix}_lag_1": F.lag(n, 1).over(w),
        f"{count_prefix}_lag_7": F.lag(n, 7).over(w),
        f"{count_prefix}_rolling_7": _rolling_mean(n, 7),
        target: F.lead(t, 1).over(w),
    })


def gmv_features(base: DataFrame) -> DataFrame:
    daily = with_history(
        daily_gmv(base), "total_gmv", "txn_count", "gmv", "txn_count", "target_gmv"
    )
    return daily.withColumn("is_weekend", is_weekend(F.col("date")).cast("int"))


def refund_features(base: DataFrame) -> DataFrame:
    return with_history(
        daily_refunds(base), "total_refunds", "refund_count", "refund", "refund_count",
        "target_refund",
    )


def settlement_features(base: DataFrame) -> DataFrame:
    return with_history(
        daily_settlement_net(base), "total_settlement", "settlement_count", "settlement",
        "settlement_count", "target_settlement",
    )


def with_calendar(daily: DataFrame) -> DataFrame:
    """Day of month, month and one 0/1 column per day of week, Monday first."""
    day = F.weekday("date")
    return daily.withColumns({
        "day_of_month": F.dayofmonth("date"), "month": F.month("date"),
        **{f"dow_{d}": (day == d).cast("int") for d in range(7)},
    })


def chronological_split(features: DataFrame, columns: list[str], share: float = 0.8) -> DataFrame:
    """Complete rows in date order, the first ``floor(n * share)`` marked as training."""
    complete = features.dropna(subset=columns)
    numbered = complete.withColumns({
        "position": F.row_number().over(Window.orderBy("date")),
        "n": F.count("*").over(Window.partitionBy()),
    })
    return numbered.withColumn(
        "is_train", F.col("position") <= F.floor(F.col("n") * F.lit(share))
    ).drop("n")


def latest_complete(features: DataFrame, columns: list[str]) -> DataFrame:
    """The last day that has all features."""
    return features.dropna(subset=columns).orderBy(F.desc("date")).limit(1)


def naive_error(split: DataFrame, today: str, target: str) -> DataFrame:
    """Held-out error of "tomorrow equals today"."""
    held_out = split.filter(~F.col("is_train"))
    gap = F.abs(exact(F.col(target)) - exact(F.col(today)))
    return held_out.agg(
        F.count("*").alias("n_test"),
        (F.sum(gap).cast("double") / F.count("*")).alias("naive_mae"),
    )
