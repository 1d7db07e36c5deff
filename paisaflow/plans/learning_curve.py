"""Cross-validated learning curve of the least-squares model in two passes over the data.

One pass takes the sums of products per fold and size step (``least_squares``); all fits are then solved
from small matrices, and a second pass measures every fit at once. Forty fits would otherwise read the rows forty times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from paisaflow.plans.forecast import FeatureSet
from paisaflow.plans.least_squares import Cells, LinearModel, fit

FOLDS = 5
SIZES = tuple(float(s) for s in np.linspace(0.2, 1.0, 8))


def placed(rows: DataFrame) -> DataFrame:
    """Rows with their ``fold`` and the first size ``step`` they belong to."""
    place = F.pmod(F.xxhash64("txn_id", F.lit("size")), F.lit(1_000_000)) / 1_000_000.0
    step = F.lit(0)
    for s in SIZES[:-1]:
        step = step + (place >= s).cast("int")
    return rows.withColumns({
        "fold": F.pmod(F.xxhash64("txn_id", F.lit("fold")), F.lit(FOLDS)).cast("int"), "step": step,
    })


def _fits(rows: DataFrame, features: FeatureSet) -> list[list[LinearModel]]:
    """Per fold and step the fit on the other folds' rows up to that step."""
    cells = Cells(rows, features.numeric, features.categorical, features.target, ["fold", "step"])
    fold, step = cells.table["fold"], cells.table["step"]
    return [
        [fit(cells.moments((fold != f) & (step <= s)), features.numeric) for s in range(len(SIZES))]
        for f in range(FOLDS)
    ]


def _design(frame: pd.DataFrame, features: FeatureSet, models: list[LinearModel]) -> np.ndarray:
    """Predictions of the models for the rows of a batch, a column per model."""
    out = np.zeros((len(frame), len(models)))
    numbers = frame[list(features.numeric)].to_numpy(dtype=float)
    for k, model in enumerate(models):
        out[:, k] = model.intercept + numbers @ np.array([model.numeric[c] for c in features.numeric])
        for c in features.categorical:
            out[:, k] += frame[c].map(model.levels[c]).fillna(0.0).to_numpy(dtype=float)
    return out


def learning_curve(rows: DataFrame, features: FeatureSet) -> DataFrame:
    """``step, size, train_rows, train_mae, validation_mae``, averaged over the folds."""
    used = placed(rows.select("txn_id", *features.numeric, *features.categorical, features.target).dropna())
    models = _fits(used, features)

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            y, fold, step = frame[features.target].to_numpy(dtype=float), frame["fold"].to_numpy(), frame["step"].to_numpy()
            out = []
            for f in range(FOLDS):
                gaps = np.abs(y[:, None] - _design(frame, features, models[f]))
                for s in range(len(SIZES)):
                    inside = (fold != f) & (step <= s)
                    held = fold == f
                    out.append((f, s, gaps[inside, s].sum(), int(inside.sum()),
                                gaps[held, s].sum(), int(held.sum())))
            yield pd.DataFrame(out, columns=["fold", "step", "tg", "tn", "vg", "vn"])

    parts = used.drop("txn_id").mapInPandas(
        measure, "fold int, step int, tg double, tn long, vg double, vn long"
    )
    per_fold = parts.groupBy("fold", "step").agg(*[F.sum(c).alias(c) for c in ("tg", "tn", "vg", "vn")])
    sizes = F.element_at(F.array(*[F.lit(s) for s in SIZES]), F.col("step") + 1)
    return per_fold.groupBy("step").agg(
        F.avg("tn").alias("train_rows"),
        F.avg(F.col("tg") / F.col("tn")).alias("train_mae"),
        F.avg(F.col("vg") / F.col("vn")).alias("validation_mae"),
    ).withColumn("size", sizes).orderBy("step")
