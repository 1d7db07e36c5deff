"""Linear forecasts: settlement time, deductions and daily totals.

Each model takes two passes over its rows: one for the sums that all its fits are solved from (linear,
degree 2, the fit on all rows, and the curvature of the residual), one for the errors on held-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paisaflow.operators import daily
from paisaflow.plans.least_squares import Cells, LinearModel, fit, power, residual_correlation
from paisaflow.schemas import FORECASTER_METRICS

CURVATURE_LIMIT = 0.15


@dataclass(frozen=True)
class FeatureSet:
    label: str
    target: str
    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    degree: int = 1


# What each model sees and predicts.
DAYS_TO_SETTLE = FeatureSet(
    "model_a", "days_to_settle",
    ("txn_amount", "day_of_week", "is_weekend_or_holiday", "had_dispute_flag"),
    ("payment_method", "merchant_category"),
)
FEE_DEDUCTION = FeatureSet(
    "model_b_fee", "fee_deduction_pct", ("txn_amount", "gst_on_fee_flag"), ("payment_method",)
)
REFUND_DEDUCTION = FeatureSet(
    "model_b_refund", "refund_deduction_pct", ("txn_amount", "refund_amount"),
    ("payment_method",),
)
GMV = FeatureSet("gmv", "target_gmv", (
    "gmv_lag_1", "gmv_lag_7", "gmv_rolling_7", "gmv_rolling_30", "txn_count_lag_1",
    "txn_count_lag_7", "txn_count_rolling_7", "is_weekend",
))
GMV_EXPERIMENT = replace(GMV, label="gmv_experiment", numeric=("total_gmv", *GMV.numeric))
REFUND_EXPERIMENT = FeatureSet("refund_experiment", "target_refund", (
    "total_refunds", "refund_lag_1", "refund_lag_7", "refund_rolling_7", "refund_rolling_30",
    "refund_count_lag_1", "refund_count_lag_7", "refund_count_rolling_7",
))
SETTLEMENT_EXPERIMENT = FeatureSet("settlement_experiment", "target_settlement", (
    "settlement_lag_1", "settlement_lag_7", "settlement_rolling_7", "settlement_rolling_30",
    "settlement_count_lag_1", "settlement_count_lag_7", "settlement_count_rolling_7",
))


def to_features(base: DataFrame) -> DataFrame:
    """Flags as 0/1 and the two deduction shares."""
    flags = ("is_weekend_or_holiday", "had_dispute_flag", "had_refund", "gst_on_fee_flag")
    present = {c: F.col(c).cast("int") for c in flags if c in base.columns}
    amount = F.col("txn_amount")
    return base.withColumns({
        **present,
        "fee_deduction_pct": F.try_divide(F.col("fee_amount") + F.col("tax_on_fee"), amount),
        "refund_deduction_pct": F.try_divide(F.col("refund_amount"), amount),
    })


def is_test_row() -> Column:
    """A fixed fifth of the rows by transaction id, the same under any partitioning and in any engine."""
    return F.conv(F.left(F.md5("txn_id"), F.lit(8)), 16, 10).cast("bigint") % 5 == 0


def errors(predicted: DataFrame, target: str, prediction: str = "prediction") -> DataFrame:
    """Mean absolute, mean absolute percentage (targets near zero left out) and root mean
    square error in one pass."""
    y, gap = F.col(target).cast("double"), F.col(target) - F.col(prediction)
    return predicted.agg(
        F.count("*").alias("n"), F.avg(F.abs(gap)).alias("mae"),
        (F.avg(F.when(F.abs(y) > 1e-6, F.abs(gap / y))) * 100).alias("mape_pct"),
        F.sqrt(F.avg(gap * gap)).alias("rmse"),
    )


def curvature(predicted: DataFrame, target: str) -> DataFrame:
    """Correlation of the residual with the squared amount, and whether it counts."""
    squared = F.pow("txn_amount", F.lit(2.0))
    rows = predicted.select((F.col(target) - F.col("prediction")).alias("r"), squared.alias("s"))
    return rows.agg(
        F.corr("r", "s").alias("c"), F.stddev_pop("r").alias("sr"),
        F.stddev_pop("s").alias("ss"), F.count("*").alias("n"),
    ).select(
        F.col("c").alias("corr_with_amount_sq"),
        F.when((F.col("sr") < 1e-9) | (F.col("ss") < 1e-9), F.lit(False))
        .otherwise(F.coalesce(F.abs("c") > CURVATURE_LIMIT, F.lit(False))).alias("curved"), "n",
    )


@dataclass
class Trained:
    model: LinearModel
    features: FeatureSet
    report: dict


def _inputs(features: FeatureSet) -> tuple[str, ...]:
    return features.numeric + tuple(power("txn_amount", d) for d in range(2, features.degree + 1))


def train_from_split(rows: DataFrame, features: FeatureSet) -> Trained:
    """Linear first; degree 2 in the amount only if the residual is curved and it does better
    on held-out rows (those with ``is_test``). The chosen form is fitted again on all rows."""
    cells = Cells(rows, features.numeric, features.categorical, features.target, ["is_test"], "txn_amount")
    train = cells.moments(~cells.table["is_test"].astype(bool))
    linear = fit(train, _inputs(features))
    related = residual_correlation(train, linear, power("txn_amount", 2))
    curved = related is not None and abs(related) > CURVATURE_LIMIT
    second = replace(features, degree=2)
    forms = [(features, linear)] + ([(second, fit(train, _inputs(second)))] if curved else [])
    tested = rows.filter("is_test")
    measured = [
        errors(tested.withColumn("prediction", model.prediction()), features.target).withColumn("form", F.lit(i))
        for i, (_, model) in enumerate(forms)
    ]
    found = {r["form"]: r for one in measured for r in one.collect()}
    best = 1 if curved and found[1]["mae"] < found[0]["mae"] else 0
    chosen = forms[best][0]
    return Trained(fit(cells.moments(), _inputs(chosen)), chosen, {
        "label": features.label, "target": features.target, "n_train": train.n,
        "n_test": found[best]["n"], "mae": found[best]["mae"], "mape_pct": found[best]["mape_pct"],
        "chosen_model": "linear" if chosen.degree == 1 else "polynomial(degree=2)",
        "curvature_detected": curved, "linear_mae": found[0]["mae"],
        "polynomial_mae": found[1]["mae"] if curved else None,
    })


def _used(rows: DataFrame, features: FeatureSet) -> DataFrame:
    return rows.select("txn_id", *features.numeric, *features.categorical, features.target)


def train_transaction_model(rows: DataFrame, features: FeatureSet) -> Trained:
    """``rows`` from ``to_features``."""
    used = _used(rows, features).dropna().withColumn("is_test", is_test_row())
    return train_from_split(used, features)


@dataclass
class DeductionModel:
    fee: Trained
    refund: Trained
    combined: dict


def train_deduction_model(rows: DataFrame) -> DeductionModel:
    """Fee share on all rows, refund share on refunded rows; scored together on held-out rows."""
    fee = train_transaction_model(rows, FEE_DEDUCTION)
    refund = train_transaction_model(rows.filter("had_refund = 1"), REFUND_DEDUCTION)
    test = predict_deduction(rows.filter(is_test_row()), fee.model, refund.model)
    total = errors(test, "deduction_pct", "raw_deduction").first()
    return DeductionModel(fee, refund, {
        "label": "model_b_combined", "target": "deduction_pct", "n_train": fee.report["n_train"],
        "n_test": total["n"], "mae": total["mae"], "mape_pct": total["mape_pct"],
        "chosen_model": "fee + refund", "curvature_detected": None,
    })


def _predict(rows: DataFrame, model: LinearModel, name: str) -> DataFrame:
    return rows.withColumn(name, model.prediction())


def predict_deduction(rows: DataFrame, fee: LinearModel, refund: LinearModel) -> DataFrame:
    both = _predict(_predict(rows, fee, "fee_prediction"), refund, "refund_prediction")
    gated = F.when(F.col("had_refund") == 1, F.col("refund_prediction")).otherwise(0.0)
    return both.withColumn("raw_deduction", F.col("fee_prediction") + gated)


def predict_transactions(
    rows: DataFrame, days: LinearModel, fee: LinearModel, refund: LinearModel
) -> DataFrame:
    """All rows of ``to_features`` with predicted days (2 places) and deduction in [0, 1]
    (4 places), as lazy column work over the whole frame."""
    scored = predict_deduction(_predict(rows, days, "days_prediction"), fee, refund)
    share = F.when(
        F.col("raw_deduction").isNotNull(),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_deduction"))),
    )
    return scored.select(
        *rows.columns, F.round("days_prediction", 2).alias("predicted_days_to_settle"),
        F.round(share, 4).alias("predicted_deduction_pct"),
    )


# --- daily series ------------------------------------------------------------


def train_daily_model(frame: DataFrame, features: FeatureSet, today: str) -> Trained:
    """Chronological 80/20 fit against "tomorrow equals today", then a fit on all days.

    ``frame`` has one row per day; it is cached by the caller or small enough not to matter.
    """
    columns = [*features.numeric, features.target]
    split = daily.chronological_split(frame, columns)
    cells = Cells(split, features.numeric, (), features.target, ["is_train"])
    inside = cells.table["is_train"].astype(bool)
    train = cells.moments(inside)
    model = fit(train, features.numeric)
    found = errors(model.transform(split.filter(~F.col("is_train"))), features.target).first()
    naive = daily.naive_error(split, today, features.target).first()["naive_mae"]
    return Trained(fit(cells.moments(), features.numeric), features, {
        "label": features.label, "target": features.target, "n_train": train.n,
        "n_test": found["n"], "mae": found["mae"], "mape_pct": found["mape_pct"], "rmse": found["rmse"],
        "naive_mae": naive,
        "improvement_pct": (naive - found["mae"]) / naive * 100 if naive else None,
        "chosen_model": "linear_regression", "curvature_detected": None,
    })


def predict_next_day_gmv(frame: DataFrame, model: LinearModel) -> DataFrame:
    """One row from the last complete day; an error when there is none."""
    latest = daily.latest_complete(frame, list(GMV.numeric))
    if latest.isEmpty():
        raise ValueError("The series has no day with all of its features yet.")
    return model.transform(latest).select(
        F.round("prediction", 2).alias("value"), F.lit("linear_regression").alias("method"),
        F.date_add("date", 1).alias("forecast_date"), F.col("date").alias("based_on_date"),
    )


# --- reports and stored models -----------------------------------------------


def metrics_frame(spark: SparkSession, reports: list[dict]) -> DataFrame:
    names = FORECASTER_METRICS.names
    return spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in reports], FORECASTER_METRICS
    )


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    model.save(spark, path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    return LinearModel.load(spark, path)


def residuals(predicted: DataFrame, target: str) -> DataFrame:
    """Actual, predicted and residual per held-out row."""
    return predicted.select(
        "txn_id", "txn_amount", F.col(target).cast("double").alias("actual"),
        F.col("prediction").alias("predicted"),
        (F.col(target) - F.col("prediction")).alias("residual"),
    )
