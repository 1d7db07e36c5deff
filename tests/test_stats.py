"""Quantiles by distributed selection against numpy."""

import random

import numpy as np
import pytest

from paisaflow.operators import stats

SHARES = (0.0, 0.25, 0.5, 0.9, 1.0)


def expected(values):
    known = np.array([v for v in values if v is not None])
    return (len(known), known.min(), known.max(), *np.quantile(known, SHARES))


def got(row):
    return (row.n, row.low, row.high, *row.q)


@pytest.mark.parametrize("bins", [2, 1024])
def test_quantiles_by_group(spark, monkeypatch, bins):
    monkeypatch.setattr(stats, "QUANTILE_BINS", bins)
    rng = random.Random(3)
    groups = {
        "one": [5.0], "same": [2.5] * 40, "two": [1.0, 2.0], None: [rng.uniform(-9, 9) for _ in range(101)],
        "spread": [rng.choice([1e-9, 1.0, 1e12]) * rng.random() for _ in range(200)],
        "ties": [float(rng.randrange(4)) for _ in range(333)], "gaps": [None, 3.0, None, 7.0],
    }
    rows = [(g, v) for g, values in groups.items() for v in values] + [("empty", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    found = {r.g: got(r) for r in stats.exact_quantiles(df, "v", SHARES, ["g"]).collect()}
    assert set(found) == set(groups)
    for g, values in groups.items():
        assert found[g] == pytest.approx(expected(values), rel=1e-12, abs=1e-12)


def test_quantiles_of_all_rows(spark):
    df = spark.range(0, 10_001).selectExpr("cast(id * id % 7919 as int) as v")
    values = [i * i % 7919 for i in range(10_001)]
    assert got(stats.exact_quantiles(df, "v", SHARES).first()) == pytest.approx(expected(values))


def test_describe_of_nothing(spark):
    row = stats.describe(spark.createDataFrame([], "v int"), "v").first()
    assert row.n == 0 and row.q50 is None and row.low is None
