"""Tier 1: the only ledger row and the only bank row of an order agree within a tight band."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.functions import times
from paisaflow.functions.money import band, expected_net
from paisaflow.operators.keys import with_order_key
from paisaflow.schemas import EXACT_TOLERANCE, Tolerance


BLANK_PARTS = 64


class MatchSplit(NamedTuple):
    matches: DataFrame
    ledger_rest: DataFrame
    bank_rest: DataFrame


def match_columns(tier: str, order_id: Column, explanation: Column | None = None) -> list[Column]:
    """The match row from ``l_id, b_id, diff, hours``."""
    none = F.lit(None).cast("string")
    return [
        F.col("l_id").alias("ledger_row_id"), F.col("b_id").alias("bank_row_id"),
        order_id.alias("order_id"), F.lit(tier).alias("tier"),
        F.col("diff").alias("amount_diff"), F.col("hours").alias("timestamp_diff_hours"),
        (none if explanation is None else explanation).alias("explanation"),
    ]


def single_pairs(ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Orders with exactly one row on each side, as one row with both.

    One aggregation over both sides: rows combine before the shuffle, so an order with very
    many rows sends one row per task instead of all of them.
    """
    l = with_order_key(ledger).select("order_key", F.struct(
        F.col("source_id").alias("id"), "amount", expected_net().alias("net"), "created_at",
    ).alias("l"))
    b = with_order_key(bank).select("order_key", F.struct(
        F.col("source_id").alias("id"), "amount", "created_at",
    ).alias("b"))
    groups = l.unionByName(b, allowMissingColumns=True).groupBy("order_key").agg(
        F.count("l").alias("n_ledger"), F.count("b").alias("n_bank"),
        F.max("l").alias("l"), F.max("b").alias("b"),
    )
    return groups.filter((F.col("n_ledger") == 1) & (F.col("n_bank") == 1)).select(
        "order_key", F.col("l.id").alias("l_id"), F.col("b.id").alias("b_id"),
        F.col("l.amount").alias("l_amount"),
        F.abs(F.col("b.amount") - F.col("l.net")).alias("diff"),
        times.hours_between(F.col("b.created_at"), F.col("l.created_at")).alias("hours"),
    )


def exact_match(
    ledger: DataFrame,
    bank: DataFrame,
    tolerance: Tolerance = EXACT_TOLERANCE,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> MatchSplit:
    """``keep`` (e.g. ``session.cut``) is applied to the matches, which three results share."""
    within = (
        F.col("diff") <= band(F.col("l_amount"), tolerance.amount_abs, tolerance.amount_pct)
    ) & (F.col("hours") <= tolerance.hours)
    found = single_pairs(ledger, bank).filter(within).drop("l_amount")
    if keep is not None:
        found = keep(found)
    # a matched order had one row on each side, so the rest is every row of any other order;
    # rows without an order, which may be very many, are spread over the tasks
    spread = F.when(F.col("order_key") == "", F.pmod(F.xxhash64("source_id"), F.lit(BLANK_PARTS))).otherwise(0)
    parts = F.when(F.col("order_key") == "", F.sequence(F.lit(0), F.lit(BLANK_PARTS - 1))).otherwise(F.array(F.lit(0)))
    keys = found.select("order_key", F.explode(parts.cast("array<long>")).alias("_part"))
    rest = lambda df: with_order_key(df).withColumn("_part", spread.cast("long")).join(
        keys, ["order_key", "_part"], "left_anti"
    ).drop("order_key", "_part")
    return MatchSplit(
        found.select(*match_columns("exact", F.col("order_key"))), rest(ledger), rest(bank)
    )
