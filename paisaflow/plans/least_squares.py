"""Least squares from sums of products, taken for many fits in one scan.

A fit needs no rows, only the sums of products of its columns. Category columns are 0/1 columns of their levels, so
the sums fall into cells of equal categories: one aggregation with map-side combine gives, per cell and per
part of the rows (training, test, folds), the number of rows and the sums over the numeric columns and the
target. All fits over any union of parts, linear or with powers, are then solved from the cells.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Cells are the pairs of two categories' levels; columns of free text do not belong in a model.
MOST_CELLS = 200_000
NONE = "\x00"


def power(column: str, degree: int) -> str:
    return f"{column}_{degree}"


@dataclass(frozen=True)
class Moments:
    """Sums of products of all columns: the constant, numbers, levels, and the target last."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    levels: dict[str, list[str]]
    target: str
    matrix: np.ndarray

    @property
    def n(self) -> int:
        return int(round(self.matrix[0, 0]))

    def place(self, column: str, level: str | None = None) -> int:
        if level is None:
            return 1 + self.numeric.index(column)
        at = 1 + len(self.numeric)
        for c in self.categorical:
            if c == column:
                return at + self.levels[c].index(level)
            at += len(self.levels[c])
        raise KeyError(column)


@dataclass(frozen=True)
class LinearModel:
    """Coefficients of numbers and of category levels; an unseen level adds nothing."""

    intercept: float
    numeric: dict[str, float]
    levels: dict[str, dict[str, float]] = field(default_factory=dict)

    def prediction(self) -> Column:
        total = F.lit(self.intercept)
        for name, value in self.numeric.items():
            base, _, degree = name.rpartition("_")
            known = F.pow(F.col(base), F.lit(float(degree))) if degree.isdigit() and base == "txn_amount" else F.col(name)
            total = total + F.lit(value) * known.cast("double")
        for name, values in self.levels.items():
            # a known category of an unseen level predicts; an unknown one does not
            table = F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair])
            share = F.coalesce(F.try_element_at(table, F.col(name).cast("string")), F.lit(0.0)) if values else F.lit(0.0)
            total = total + F.when(F.col(name).isNotNull(), share)
        return total

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", self.prediction())

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"intercept": self.intercept, "numeric": self.numeric, "levels": self.levels})
        spark.createDataFrame([(text,)], "model string").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinearModel:
        return LinearModel(**json.loads(spark.read.parquet(path).first()[0]))


def _sums(rows: DataFrame, numbers: list[str], categorical: tuple[str, ...], by: list[str]) -> pd.DataFrame:
    c = F.col
    wide = rows.select(*by, *[c(x).cast("string").alias(x) for x in categorical], *[
        c(x).cast("double").alias(f"z{i}") for i, x in enumerate(numbers)
    ])
    products = [
        F.sum(c(f"z{i}") * c(f"z{j}")).alias(f"s_{i}_{j}") for i in range(len(numbers)) for j in range(i, len(numbers))
    ]
    cells = wide.groupBy(*by, *categorical).agg(
        F.count("*").alias("n"), *[F.sum(f"z{i}").alias(f"s_{i}") for i in range(len(numbers))], *products
    )
    found = cells.limit(MOST_CELLS + 1).toPandas()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} pairs of category levels")
    return found


class Cells:
    """The collected cells of ``rows``, which hold no nulls in the columns used."""

    def __init__(
        self, rows: DataFrame, numeric: tuple[str, ...], categorical: tuple[str, ...], target: str, by: list[str],
        squares_of: str | None = None,
    ) -> None:
        self.numeric, self.categorical, self.target = tuple(numeric), tuple(categorical), target
        if squares_of is not None:
            rows = rows.withColumn(power(squares_of, 2), F.pow(F.col(squares_of), F.lit(2.0)))
            self.numeric += (power(squares_of, 2),)
        self.table = _sums(rows, [*self.numeric, target], self.categorical, by)
        self.levels = {c: sorted(self.table[c].unique()) for c in self.categorical}

    def moments(self, inside: pd.Series | None = None) -> Moments:
        part = self.table if inside is None else self.table[inside]
        k = len(self.numeric) + 1
        at, width = {}, k
        for c in self.categorical:
            for level in self.levels[c]:
                at[c, level] = width
                width += 1
        m = np.zeros((width + 1, width + 1))
        places = [*range(1, k), width]

        def add(i: int, j: int, value: float) -> None:
            m[i, j] += value
            if i != j:
                m[j, i] += value

        add(0, 0, part["n"].sum())
        for i, p in enumerate(places):
            add(0, p, part[f"s_{i}"].sum())
            for j in range(i, len(places)):
                add(p, places[j], part[f"s_{i}_{j}"].sum())
        for a, c in enumerate(self.categorical):
            for level, own in part.groupby(c):
                q = at[c, level]
                add(q, q, own["n"].sum())
                add(0, q, own["n"].sum())
                for i, p in enumerate(places):
                    add(q, p, own[f"s_{i}"].sum())
            for d in self.categorical[a + 1:]:
                for (x, y), n in part.groupby([c, d])["n"].sum().items():
                    add(at[c, x], at[d, y], n)
        return Moments(self.numeric, self.categorical, self.levels, self.target, m)


def solve(matrix: np.ndarray, used: list[int]) -> np.ndarray:
    """Coefficients of the columns ``used``: the smallest of all best solutions, columns brought to one scale."""
    left, right = matrix[np.ix_(used, used)], matrix[used, -1]
    scale = np.sqrt(np.where(np.diag(left) > 0, np.diag(left), 1.0))
    return np.linalg.lstsq(left / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale


def fit(moments: Moments, numeric: tuple[str, ...]) -> LinearModel:
    """The fit on the given numbers and all categories."""
    if moments.n == 0:
        raise ValueError("no complete row to learn from")
    names = [(c, level) for c in moments.categorical for level in moments.levels[c]]
    used = [0, *[moments.place(x) for x in numeric], *[moments.place(c, level) for c, level in names]]
    beta = solve(moments.matrix, used)
    levels: dict[str, dict[str, float]] = {c: {} for c in moments.categorical}
    for (c, level), value in zip(names, beta[1 + len(numeric):]):
        levels[c][level] = float(value)
    return LinearModel(float(beta[0]), {x: float(b) for x, b in zip(numeric, beta[1:])}, levels)


def residual_correlation(moments: Moments, model: LinearModel, column: str) -> float | None:
    """Correlation of the residual with a column, from the sums alone; None where either does not vary."""
    m = moments.matrix
    r = np.zeros(len(m))
    r[-1], r[0] = 1.0, -model.intercept
    for name, value in model.numeric.items():
        r[moments.place(name)] = -value
    for c, values in model.levels.items():
        for level, value in values.items():
            r[moments.place(c, level)] = -value
    s = moments.place(column)
    n = m[0, 0]
    spread = lambda square, total: max(square / n - (total / n) ** 2, 0.0)
    var_r, var_s = spread(r @ m @ r, r @ m[:, 0]), spread(m[s, s], m[s, 0])
    var_y = spread(m[-1, -1], m[-1, 0])
    # what is left of a perfect fit is rounding
    if np.sqrt(var_r) < 1e-9 or np.sqrt(var_s) < 1e-9 or var_r <= 1e-12 * var_y:
        return None
    return float(((r @ m[:, s]) / n - (r @ m[:, 0]) / n * m[s, 0] / n) / np.sqrt(var_r * var_s))
