"""Tier 3 pairing: inside an order, repeatedly the globally closest amounts, no tolerance."""

from __future__ import annotations

from pyspark.sql import DataFrame

from paisaflow.operators import hot_nearest, pairing
from paisaflow.operators.keys import FIND, hot_keys_of, split_hot


def nearest_pairs(
    ledger: DataFrame, bank: DataFrame, hot_keys: DataFrame | str | None = FIND
) -> DataFrame:
    """``order_key, l_id, b_id, diff, hours``: every row of the shorter side of a key gets one,
    rows without an amount apart."""
    hot_keys = hot_keys_of(ledger, bank, hot_keys)
    l_small, l_hot = split_hot(ledger, hot_keys)
    b_small, b_hot = split_hot(bank, hot_keys)
    taken = pairing.take_greedily(
        pairing.same_key_edges(l_small, b_small, pairing.diff())
    ).drop("cost")
    if hot_keys is not None:
        taken = taken.unionByName(hot_nearest.pair_nearest(l_hot, b_hot))
    return taken
