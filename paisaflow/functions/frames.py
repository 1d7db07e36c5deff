"""Small DataFrame helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def one_row(*frames: DataFrame) -> DataFrame:
    """Several one-row frames side by side as one row."""
    wide = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return wide.agg(*[F.max(c).alias(c) for c in wide.columns])
