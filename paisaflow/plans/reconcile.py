"""The three tiers in order, from normalised ledger and bank rows to matches and exceptions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame

from paisaflow.operators.adjudicate import open_items, refused_candidates, resolve
from paisaflow.operators.exact import exact_match
from paisaflow.operators.fuzzy import fuzzy_match
from paisaflow.operators.keys import FIND, hot_keys_of
from paisaflow.session import cut, side_by_side


class Reconciliation(NamedTuple):
    exact: DataFrame
    fuzzy: DataFrame
    adjudicated: DataFrame
    exceptions: DataFrame
    open_items: DataFrame

    @property
    def matches(self) -> DataFrame:
        return self.exact.unionByName(self.fuzzy).unionByName(self.adjudicated)


def reconcile(
    ledger: DataFrame,
    bank: DataFrame,
    resolutions: DataFrame | None = None,
    hot_keys: DataFrame | str | None = FIND,
    keep: Callable[[DataFrame], DataFrame] = cut,
    emit_both_sides: bool = False,
) -> Reconciliation:
    """Reconcile two sides.

    ``hot_keys``: ``FIND`` counts rows per order first, so that an order with very many rows is
    spread over tasks; None promises there is none. ``keep`` stores what a tier found and what
    it leaves for the next, so that no tier runs twice; the default writes tables.
    """
    hot_keys = hot_keys_of(ledger, bank, hot_keys)
    first = exact_match(ledger, bank, keep=keep)
    l1, b1 = side_by_side(keep, first.ledger_rest, first.bank_rest)
    second = fuzzy_match(l1, b1, hot_keys, keep=keep)
    l2, b2 = side_by_side(keep, second.ledger_rest, second.bank_rest)
    items = keep(open_items(l2, b2, hot_keys))
    third = resolve(items, resolutions, keep=keep)
    exceptions = third.exceptions
    if emit_both_sides:
        exceptions = exceptions.unionByName(refused_candidates(items, exceptions))
    return Reconciliation(first.matches, second.matches, third.matches, exceptions, items)
