"""Narration texts for rows: supplied ones where present, a template elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paisaflow.functions.text import float_text


def with_narration(rows: DataFrame, narrations: DataFrame | None = None) -> DataFrame:
    """``narrations`` holds ``row_id, narration``."""
    template = F.concat(
        F.lit("Settlement - Order "), F.coalesce("order_id", F.lit("None")),
        F.lit(" - INR "), float_text(F.col("amount")),
    )
    rows = rows.drop("narration")
    if narrations is None:
        return rows.withColumn("narration", template)
    return rows.join(narrations.select("row_id", "narration"), "row_id", "left").withColumn(
        "narration", F.coalesce("narration", template)
    )
