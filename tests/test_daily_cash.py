import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from paisaflow.operators import daily
from paisaflow.plans import cash, forecast, learning_curve
from tests.helpers import at

REFUND = "created_at timestamp_ntz, refund_amount double"
SETTLED = (
    "created_at timestamp_ntz, settled_at timestamp_ntz, status string, txn_amount double,"
    " refund_amount double, fee_amount double, tax_on_fee double"
)


def test_refund_baseline(spark):
    rows = [(at("2025-06-01T10:00"), 100.0), (at("2025-06-01T14:00"), 50.0),
            (at("2025-05-31T10:00"), 999.0)]
    r = cash.next_day_refunds(spark.createDataFrame(rows, REFUND)).first()
    assert (r.value, r.based_on_date, r.forecast_date, r.note) == (
        150.0, dt.date(2025, 6, 1), dt.date(2025, 6, 2), None
    )


def test_empty_baselines(spark):
    r = cash.next_day_refunds(spark.createDataFrame([], REFUND)).first()
    assert (r.value, r.forecast_date) == (0.0, None) and r.note
    pending = [(at("2025-06-01T10:00"), None, "pending", 1000.0, 0.0, 20.0, 3.6)]
    s = cash.next_day_settlement(spark.createDataFrame(pending, SETTLED)).first()
    assert s.value == 0.0 and s.note


def test_settlement_baseline_and_cash(spark):
    rows = [
        (at("2025-06-01T10:00"), at("2025-06-02T10:00"), "settled", 1000.0, 0.0, 20.0, 3.6),
        (at("2025-05-31T10:00"), at("2025-06-01T10:00"), "settled", 500.0, None, 10.0, 1.8),
        (at("2025-06-01T09:00"), None, "pending", 5000.0, 2000.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, SETTLED)
    s = cash.next_day_settlement(df).first()
    assert (s.value, s.forecast_date) == (976.4, dt.date(2025, 6, 3))
    c = cash.cash_position(df, 100_000.0).first()
    assert (c.expected_settlement, c.expected_refunds) == (976.4, 2000.0)
    assert (c.expected_net_cash_flow, c.projected_cash) == (-1023.6, 98_976.4)
    assert c.forecast_date == dt.date(2025, 6, 3)


def series(spark):
    rng = random.Random(0)
    rows = []
    for day in range(60):
        for n in range(rng.randint(3, 8)):
            when = at("2025-01-01T00:00") + dt.timedelta(days=day, hours=n)
            rows.append((f"t{day}_{n}", when, round(rng.uniform(100, 5000), 2)))
    return rows, spark.createDataFrame(
        rows, "txn_id string, created_at timestamp_ntz, txn_amount double"
    )


def test_no_leak_in_gmv_features(spark):
    rows, df = series(spark)
    totals = {}
    for _, when, amount in rows:
        totals[when.date()] = totals.get(when.date(), 0) + round(amount * 100)
    days = sorted(totals)
    got = {r.date: r for r in daily.gmv_features(df).collect()}
    for i, day in enumerate(days):
        r = got[day]
        assert r.total_gmv == totals[day] / 100
        if i >= 7:
            want = sum(totals[d] for d in days[i - 7:i]) / 700
            assert r.gmv_rolling_7 == pytest.approx(want)
            assert r.gmv_lag_7 == totals[days[i - 7]] / 100
        else:
            assert r.gmv_rolling_7 is None
        if i + 1 < len(days):
            assert r.target_gmv == totals[days[i + 1]] / 100


def test_gmv_model(spark, tmp_path):
    _, df = series(spark)
    frame = daily.gmv_features(df)
    made = forecast.train_daily_model(frame, forecast.GMV, "total_gmv")
    assert made.report["n_train"] == 23 and made.report["n_test"] == 6
    forecast.save_model(spark, made.model, str(tmp_path / "gmv"))
    again = forecast.load_model(spark, str(tmp_path / "gmv"))
    r = forecast.predict_next_day_gmv(frame, again).first()
    assert r.forecast_date == dt.date(2025, 3, 2) and r.based_on_date == dt.date(2025, 3, 1)
    with pytest.raises(ValueError):
        forecast.predict_next_day_gmv(frame.limit(5), again)


def test_cashflow_days_are_filled(spark):
    rows = [(at("2025-06-01T12:00"), 100.0, 1.5, 0.1), (at("2025-06-01T12:00"), 50.0, 0.2, 0.0),
            (at("2025-06-01T12:00"), 70.0, 9.0, 0.0)]
    df = spark.createDataFrame(
        rows, "created_at timestamp_ntz, txn_amount double, predicted_days_to_settle double,"
        " predicted_deduction_pct double",
    )
    out = cash.cashflow_forecast(df, 0.2).collect()
    assert [str(r.date) for r in out] == [f"2025-06-0{d}" for d in range(2, 9)]
    third = out[1]
    assert (third.expected_amount, third.lower_bound, third.upper_bound) == (90.0, 70.0, 100.0)
    assert sum(r.expected_amount for r in out) == 90.0
    assert cash.window_total(cash.cashflow_forecast(df, 0.2)).first()[0] == 90.0


def test_transaction_models(spark, sf_dir):
    import registry

    rows = forecast.to_features(registry.workspace(spark, sf_dir).base)
    days = forecast.train_transaction_model(rows, forecast.DAYS_TO_SETTLE)
    cuts = forecast.train_deduction_model(rows)
    assert 0 < days.report["mae"] < 1.5 and 0 < cuts.combined["mae"] < 0.05
    out = forecast.predict_transactions(rows, days.model, cuts.fee.model, cuts.refund.model)
    assert out.count() == rows.count()
    assert out.filter("predicted_deduction_pct not between 0 and 1").isEmpty()
    gap = forecast.predict_transactions(
        rows.limit(3).withColumn("txn_amount", F.lit(None).cast("double")), days.model, cuts.fee.model,
        cuts.refund.model,
    )
    assert gap.filter("predicted_days_to_settle is null and predicted_deduction_pct is null").count() == 3
    unseen = rows.limit(1).drop("merchant_category").selectExpr("*", "'new' as merchant_category")
    assert days.model.transform(unseen).first().prediction > 0


def test_learning_curve_equals_plain_fits(spark, sf_dir):
    import numpy as np
    import registry

    rows = forecast.to_features(registry.workspace(spark, sf_dir).base)
    form = forecast.DAYS_TO_SETTLE
    got = learning_curve.learning_curve(rows, form).collect()
    pdf = learning_curve.placed(rows).toPandas()
    hot = [pdf[c] == level for c in form.categorical for level in sorted(pdf[c].unique())]
    x = np.column_stack([np.ones(len(pdf)), pdf[list(form.numeric)].astype(float), *hot]).astype(float)
    y = pdf[form.target].to_numpy(dtype=float)
    maes = []
    for f in range(learning_curve.FOLDS):
        inside = ((pdf["fold"] != f) & (pdf["step"] <= 3)).to_numpy()
        held = (pdf["fold"] == f).to_numpy()
        beta = np.linalg.lstsq(x[inside], y[inside], rcond=None)[0]
        maes.append(np.abs(y[held] - x[held] @ beta).mean())
    assert got[3].validation_mae == pytest.approx(np.mean(maes), rel=1e-6)
    assert len(got) == 8 and got[0].train_rows < got[7].train_rows
