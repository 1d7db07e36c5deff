"""Order keys: the group key of matching, and the search for keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.session import cut

# Stands for "look for the hot keys of these rows", the default of the operators.
FIND = "find"

# A key with at most this many same-key pairs is matched by one task in memory.
SMALL_GROUP_PAIRS = 10_000


def with_order_key(df: DataFrame) -> DataFrame:
    """Null and blank order ids share one key."""
    return df.withColumn("order_key", F.coalesce("order_id", F.lit("")))


def group_sizes(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Rows per key and side. Only keys are read, and counts combine before the shuffle."""
    key = F.coalesce("order_id", F.lit("")).alias("order_key")
    both = ledger.select(key, F.lit(1).alias("l"), F.lit(0).alias("b")).unionByName(
        bank.select(key, F.lit(0).alias("l"), F.lit(1).alias("b"))
    )
    return both.groupBy("order_key").agg(
        F.sum("l").alias("n_ledger"), F.sum("b").alias("n_bank")
    )


def find_hot_keys(
    ledger: DataFrame, bank: DataFrame, pair_limit: int = SMALL_GROUP_PAIRS
) -> DataFrame | None:
    """Keys whose same-key pairs exceed ``pair_limit``, or None when there are none."""
    pairs = F.col("n_ledger").cast("double") * F.col("n_bank")
    hot = cut(group_sizes(ledger, bank).filter(pairs > pair_limit).select("order_key"))
    return None if hot.isEmpty() else hot


def hot_keys_of(
    ledger: DataFrame, bank: DataFrame, hot_keys: DataFrame | str | None
) -> DataFrame | None:
    """``hot_keys`` as given, or found. None says that the caller knows there are none."""
    return find_hot_keys(ledger, bank) if isinstance(hot_keys, str) else hot_keys


def split_hot(df: DataFrame, hot_keys: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """``df`` with keys, as (rows of small groups, rows of hot groups)."""
    keyed = with_order_key(df)
    if hot_keys is None:
        return keyed, None
    return (
        keyed.join(hot_keys, "order_key", "left_anti"),
        keyed.join(hot_keys, "order_key", "left_semi"),
    )
