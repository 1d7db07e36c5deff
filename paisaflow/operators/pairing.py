"""One-to-one greedy pairing of ledger and bank rows inside small groups.

All pairs of a key are ranked by (cost, ledger id, bank id) and taken when both rows are
still free. Groups are bounded by ``keys.SMALL_GROUP_PAIRS``; larger ones go to
``hot_pairing``, which gives the same pairs without listing a group's pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from paisaflow.functions import times
from paisaflow.functions.money import band, expected_net
from paisaflow.schemas import Tolerance
from paisaflow.session import cut


def ledger_points(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "order_key", F.col("source_id").alias("l_id"), F.col("amount").alias("l_amount"),
        expected_net().alias("net"), F.col("created_at").alias("l_at"),
    )


def bank_points(bank: DataFrame) -> DataFrame:
    return bank.select(
        "order_key", F.col("source_id").alias("b_id"), F.col("amount").alias("b_amount"),
        F.col("created_at").alias("b_at"),
    )


def diff() -> Column:
    return F.abs(F.col("b_amount") - F.col("net"))


def hours() -> Column:
    return times.hours_between(F.col("b_at"), F.col("l_at"))


def fuzzy_cost(tolerance: Tolerance) -> Column:
    return diff() / F.greatest(F.col("l_amount"), F.lit(1.0)) + hours() / F.lit(
        float(tolerance.hours)
    )


def in_band(tolerance: Tolerance) -> Column:
    width = band(F.col("l_amount"), tolerance.amount_abs, tolerance.amount_pct)
    return (diff() <= width) & (hours() <= tolerance.hours)


def same_key_edges(
    ledger: DataFrame, bank: DataFrame, cost: Column, condition: Column | None = None
) -> DataFrame:
    """Pairs of equal key, optionally within a band, with their cost.

    Rows whose cost is unknown (no amount, or no time where the cost needs one) pair with nothing
    and stay open; ``hot_pairing`` and ``hot_nearest`` follow the same rule.
    """
    l, b = ledger_points(ledger), bank_points(bank)
    pairs = l.join(b, "order_key")
    if condition is not None:
        pairs = pairs.filter(condition)
    return pairs.select(
        "order_key", cost.alias("cost"), "l_id", "b_id", diff().alias("diff"),
        hours().alias("hours"),
    ).filter(F.col("cost").isNotNull())


def take_greedily(edges: DataFrame) -> DataFrame:
    """Sequential greedy choice per key.

    A key's first edge is always taken. Of its other edges only those that share no row with it are
    still open, in most keys none or one, which is taken too; keys with more are folded.
    """
    columns = ["order_key", "cost", "l_id", "b_id", "diff", "hours"]
    ranked = Window.partitionBy("order_key").orderBy(*columns[1:])
    first = lambda name: F.first(name).over(ranked)
    # an unknown id equals none
    clash = F.coalesce(
        (F.col("l_id") == F.col("_l")) | (F.col("b_id") == F.col("_b")), F.lit(False)
    )
    counted = cut(
        edges.select(
            *columns, F.row_number().over(ranked).alias("_place"), first("l_id").alias("_l"),
            first("b_id").alias("_b"),
        )
        .filter((F.col("_place") == 1) | ~clash)
        .withColumn("_open", F.count("*").over(Window.partitionBy("order_key")) - 1)
        .select(*columns, "_place", "_open")
    )
    taken = counted.filter((F.col("_place") == 1) | (F.col("_open") == 1)).select(*columns)
    rest = counted.filter((F.col("_place") > 1) & (F.col("_open") > 1))
    return taken.unionByName(_fold(rest.select(*columns)))


def _fold(edges: DataFrame) -> DataFrame:
    """The choice as a fold over each key's sorted edges."""
    ranked = edges.groupBy("order_key").agg(
        F.array_sort(F.collect_list(F.struct("cost", "l_id", "b_id", "diff", "hours")))
        .alias("ranked")
    )
    element = "array<struct<cost:double,l_id:string,b_id:string,diff:double,hours:double>>"

    def step(taken: Column, edge: Column) -> Column:
        clash = F.exists(
            taken, lambda t: (t["l_id"] == edge["l_id"]) | (t["b_id"] == edge["b_id"])
        )
        return F.when(clash, taken).otherwise(F.concat(taken, F.array(edge)))

    folded = F.aggregate("ranked", F.array().cast(element), step)
    return ranked.select("order_key", F.explode(folded).alias("e")).select("order_key", "e.*")
