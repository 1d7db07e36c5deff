"""Tier 2: wider bands, best-scoring pairs first, each row used once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from paisaflow.operators import hot_pairing, pairing
from paisaflow.operators.exact import MatchSplit, match_columns
from paisaflow.operators.keys import FIND, hot_keys_of, split_hot, with_order_key
from paisaflow.schemas import FUZZY_TOLERANCE, Tolerance


def fuzzy_candidates(
    ledger: DataFrame, bank: DataFrame, tolerance: Tolerance = FUZZY_TOLERANCE
) -> DataFrame:
    """Every same-order pair inside the bands, with its score: a view for inspection.
    ``fuzzy_match`` does not list the pairs of hot keys."""
    return pairing.same_key_edges(
        with_order_key(ledger), with_order_key(bank), pairing.fuzzy_cost(tolerance),
        pairing.in_band(tolerance),
    ).withColumnRenamed("cost", "score")


def without_rows(df: DataFrame, used: DataFrame, id_column: str) -> DataFrame:
    """Rows of ``df`` whose id is not in ``used``."""
    taken = used.select(F.col(id_column).alias("source_id"))
    return df.join(taken, "source_id", "left_anti")


def fuzzy_match(
    ledger: DataFrame,
    bank: DataFrame,
    hot_keys: DataFrame | str | None = FIND,
    tolerance: Tolerance = FUZZY_TOLERANCE,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> MatchSplit:
    """``hot_keys``: the keys too large for one task, looked for unless given."""
    hot_keys = hot_keys_of(ledger, bank, hot_keys)
    l_small, l_hot = split_hot(ledger, hot_keys)
    b_small, b_hot = split_hot(bank, hot_keys)
    taken = pairing.take_greedily(pairing.same_key_edges(
        l_small, b_small, pairing.fuzzy_cost(tolerance), pairing.in_band(tolerance)
    )).drop("cost")
    if hot_keys is not None:
        taken = taken.unionByName(hot_pairing.pair_in_bands(l_hot, b_hot, tolerance))
    matches = taken.select(*match_columns("fuzzy", F.col("order_key")))
    if keep is not None:
        matches = keep(matches)
    return MatchSplit(
        matches, without_rows(ledger, matches, "ledger_row_id"),
        without_rows(bank, matches, "bank_row_id"),
    )
