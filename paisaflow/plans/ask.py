"""What a question needs: the records it names or resembles, statistics, forecast and cash."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from paisaflow.operators.records import aggregate_stats, breakdowns
from paisaflow.operators.scoring import official_report
from paisaflow.operators.similarity import semantic_search
from paisaflow.plans.cash import cash_position
from paisaflow.schemas import (
    CASH_POSITION_KEYWORDS, DEFAULT_CURRENT_CASH, FORWARD_LOOKING_KEYWORDS, ID_PATTERN,
)


class Context(NamedTuple):
    records: DataFrame
    stats: DataFrame
    breakdowns: DataFrame
    official_report: DataFrame | None
    forecast: DataFrame | None
    cash_position: DataFrame | None


def named_records(records: DataFrame, ids: list[str]) -> DataFrame:
    return records.filter(F.col("order_id").isin(ids) | F.col("txn_id").isin(ids))


def retrieve(
    question: str,
    records: DataFrame,
    index: DataFrame,
    embed_question: Callable[[str], list[float]],
    forecast: Callable[[DataFrame], DataFrame] | None = None,
    score_row: DataFrame | None = None,
    max_records: int = 15,
) -> Context:
    """Records named in the question win over similar ones; statistics always cover all
    records. The scored report is attached only where all data are scored (``TXN`` ids)."""
    ids = re.findall(ID_PATTERN, question)
    if ids:
        hits = named_records(records, ids).orderBy("txn_id").limit(max_records)
    else:
        hits = semantic_search(embed_question(question), records, index, max_records)
    lowered = question.lower()
    asks = lambda keywords: any(k in lowered for k in keywords)
    report = None
    if score_row is not None:
        if records.agg(F.bool_and(F.col("txn_id").startswith("TXN"))).first()[0]:
            report = official_report(score_row)
    return Context(
        hits, aggregate_stats(records), breakdowns(records), report,
        forecast(records) if forecast and asks(FORWARD_LOOKING_KEYWORDS) else None,
        cash_position(records, DEFAULT_CURRENT_CASH) if asks(CASH_POSITION_KEYWORDS) else None,
    )
