"""The daily total as a running query, for callers whose transactions arrive as a stream.

The batch form (``operators.daily.daily_gmv``) is the reference; this one gives the same rows
once a day is closed by the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.functions.money import exact


def daily_gmv_stream(transactions: DataFrame, late_by: str = "1 day") -> DataFrame:
    """``date, total_gmv, txn_count`` per event day; rows later than ``late_by`` are left out.

    State is one row per open day: a day's rows combine in every task before the shuffle.
    """
    at = F.col("created_at").cast("timestamp")  # watermarks need an instant; session in UTC
    timed = transactions.select(at.alias("at"), "txn_amount").withWatermark("at", late_by)
    daily = timed.groupBy(F.window("at", "1 day").alias("w")).agg(
        F.sum(exact(F.col("txn_amount"))).cast("double").alias("total_gmv"),
        F.count("txn_amount").alias("txn_count"),
    )
    return daily.select(F.to_date("w.start").alias("date"), "total_gmv", "txn_count")
