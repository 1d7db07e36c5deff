"""Tier 3: what the bands could not settle, decided by externally supplied answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from paisaflow.operators.exact import match_columns
from paisaflow.operators.fuzzy import without_rows
from paisaflow.operators.keys import FIND
from paisaflow.operators.nearest import nearest_pairs
from paisaflow.schemas import (
    DEFAULT_EXCEPTION_EXPLANATION, DEFAULT_EXCEPTION_REASON, RESOLUTIONS,
)


class Adjudication(NamedTuple):
    matches: DataFrame
    exceptions: DataFrame


def row_summary(prefix: str = "") -> Column:
    """The fields a reviewer sees of one row."""
    c = lambda name: F.col(f"{prefix}{name}")
    return F.struct(
        c("source_id").alias("row_id"), c("order_id").alias("order_id"),
        c("amount").alias("amount"), c("method").alias("method"), c("status").alias("status"),
        c("fee").alias("fee"), c("raw_tax_on_fee").alias("tax_on_fee"),
        c("refund_amount").alias("refund_amount"), c("created_at").alias("timestamp"),
    )


def open_items(
    ledger: DataFrame, bank: DataFrame, hot_keys: DataFrame | str | None = FIND
) -> DataFrame:
    """Every row still open: ledger rows with their nearest bank row, then lone rows.

    Columns: row_id, side, order_id, candidate_id, diff, hours.
    """
    pairs = nearest_pairs(ledger, bank, hot_keys)
    l_open = ledger.select(F.col("source_id").alias("row_id"), "order_id").join(
        pairs.select(
            F.col("l_id").alias("row_id"), F.col("b_id").alias("candidate_id"), "diff", "hours"
        ), "row_id", "left",
    ).withColumn("side", F.lit("ledger"))
    lone_bank = without_rows(bank, pairs, "b_id").select(
        F.col("source_id").alias("row_id"), "order_id", F.lit("bank").alias("side")
    )
    items = l_open.unionByName(lone_bank, allowMissingColumns=True)
    blank = F.col("order_id") == ""
    return items.select(
        "row_id", "side", F.when(~blank, F.col("order_id")).alias("order_id"), "candidate_id",
        "diff", "hours",
    )


def item_texts(items: DataFrame, ledger: DataFrame, bank: DataFrame) -> DataFrame:
    """Items with the summaries an adjudicator reads."""
    rows = ledger.unionByName(bank).select(
        F.col("source_id").alias("row_id"), row_summary().alias("record")
    )
    candidates = bank.select(
        F.col("source_id").alias("candidate_id"), row_summary().alias("candidate")
    )
    return items.join(rows, "row_id", "left").join(candidates, "candidate_id", "left").select(
        "row_id", "side", "record", "candidate"
    )


def answer_in_batches(
    items: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame], schema, size: int
) -> DataFrame:
    """Run an external answering function over fixed-size batches inside the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), size):
                yield answer(frame.iloc[start:start + size])

    return items.mapInPandas(run, schema)


def resolve(
    items: DataFrame, resolutions: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> Adjudication:
    """Apply answers ``row_id, resolution, matched_row_id, explanation`` to open items.

    An item becomes a match only when its answer says so and names its own candidate. An item
    without answer keeps the default reason. A refused pair leaves only its ledger row as an
    exception: the bank row was never an item. ``keep`` (e.g. ``session.cut``) is applied to the
    judged items, which both results share.
    """
    if resolutions is None:
        resolutions = items.sparkSession.createDataFrame([], RESOLUTIONS)
    said = resolutions.select(
        "row_id", "resolution", "matched_row_id", F.col("explanation").alias("said")
    )
    judged = items.join(said, "row_id", "left")
    agreed = F.coalesce(
        (F.col("resolution") == "matched") & (F.col("matched_row_id") == F.col("candidate_id")),
        F.lit(False),
    )
    judged = judged.select(
        "row_id", "side", "order_id", "candidate_id", "diff", "hours", "resolution", "said",
        agreed.alias("agreed"),
    )
    if keep is not None:
        judged = keep(judged)
    matches = judged.filter("agreed").withColumns(
        {"l_id": F.col("row_id"), "b_id": F.col("candidate_id")}
    ).select(*match_columns("llm", F.col("order_id"), F.col("said")))
    exceptions = judged.filter("not agreed").select(
        "row_id", "side", "order_id",
        F.coalesce("resolution", F.lit(DEFAULT_EXCEPTION_REASON)).alias("reason"),
        F.coalesce("said", F.lit(DEFAULT_EXCEPTION_EXPLANATION)).alias("explanation"),
    )
    return Adjudication(matches, exceptions)


def refused_candidates(items: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Bank rows of refused pairs, for callers that want every row accounted for."""
    kept = items.filter(F.col("candidate_id").isNotNull()).join(
        exceptions.filter(F.col("side") == "ledger").select("row_id", "reason", "explanation"),
        "row_id",
    )
    return kept.select(
        F.col("candidate_id").alias("row_id"), F.lit("bank").alias("side"), "order_id",
        "reason", "explanation",
    )
