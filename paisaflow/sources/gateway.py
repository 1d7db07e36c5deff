"""Dumps of a payment gateway's orders, payments and settlements to in-flight rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from paisaflow.schemas import TXN
from paisaflow.sources.tables import JsonRows, read_json

_L, _S = T.LongType(), T.StringType()
ORDERS = T.StructType([T.StructField("id", _S), T.StructField("created_at", _L)])
PAYMENTS = T.StructType([
    T.StructField("id", _S), T.StructField("order_id", _S), T.StructField("amount", _L),
    T.StructField("currency", _S), T.StructField("method", _S), T.StructField("status", _S),
    T.StructField("fee", _L), T.StructField("tax", _L), T.StructField("amount_refunded", _L),
    T.StructField("settlement_id", _S), T.StructField("created_at", _L),
    T.StructField("description", _S),
])
SETTLEMENTS = T.StructType([T.StructField("id", _S), T.StructField("created_at", _L)])


def read_dump(spark: SparkSession, path: str, schema: T.StructType) -> JsonRows:
    """One object per line; objects that do not fit the schema are told apart."""
    return read_json(spark, path, schema, array_file=False)


def from_epoch(seconds: Column) -> Column:
    """Epoch seconds to UTC wall-clock time, whatever the session time zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    zero = F.lit(0)
    return start + F.make_dt_interval(zero, zero, zero, seconds.cast("decimal(18,6)"))


def gateway_txns(orders: DataFrame, payments: DataFrame, settlements: DataFrame) -> DataFrame:
    """Payments of the given orders, with the time of their settlement if swept already.

    Payments without a settlement id skip the settlement join, so they do not all meet in
    the null key's task.
    """
    known = payments.join(
        orders.select(F.col("id").alias("order_id")), "order_id", "left_semi"
    )
    swept = known.filter(F.col("settlement_id").isNotNull()).join(
        settlements.select(
            F.col("id").alias("settlement_id"), F.col("created_at").alias("settled")
        ), "settlement_id", "left",
    )
    open_ = known.filter(F.col("settlement_id").isNull())
    rows = swept.unionByName(open_, allowMissingColumns=True)
    rupees = lambda c: F.col(c) / F.lit(100.0)
    columns = {
        "source": F.lit("gateway"), "source_id": F.col("id"), "order_id": F.col("order_id"),
        "amount": rupees("amount"), "currency": F.coalesce("currency", F.lit("INR")),
        "method": F.col("method"), "status": F.coalesce("status", F.lit("unknown")),
        "fee": rupees("fee"), "tax_on_fee": rupees("tax"),
        "settled_at": from_epoch(F.col("settled")),
        "created_at": from_epoch(F.col("created_at")), "narration": F.col("description"),
        "raw_tax_on_fee": rupees("tax"), "refund_amount": rupees("amount_refunded"),
    }
    return rows.select(*[
        columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TXN.fields
    ])


def calibration_rows(txns: DataFrame) -> DataFrame:
    """Five columns of dated payments, kept apart from scored data."""
    return txns.filter(F.col("created_at").isNotNull()).select(
        "source_id", "order_id", "amount", "method", "created_at"
    )
