"""Forecast accuracy, alignment, comparison and presentation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_KEYS
from .series import LENGTH, POSITION, with_position
from .timeseries import append, last_n

METRICS = ("mae", "rmse", "mape")


def error_metrics(actual: Column, forecast: Column) -> dict[str, Column]:
    """Aggregates: mean absolute error, root mean squared error, and percentage error
    over rows whose actual is not zero (0.0 when there are none)."""
    error = actual - forecast
    percent = F.abs(error / F.nullif(actual, F.lit(0.0))) * 100
    return {
        "mae": F.avg(F.abs(error)),
        "rmse": F.sqrt(F.avg(error * error)),
        "mape": F.coalesce(F.avg(percent), F.lit(0.0)),
    }


def align_by_date(
    test: DataFrame, forecast: DataFrame, target: str, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """``(keys, model, time, actual, forecast)``; a model of a key takes part only
    when its forecast has every test date."""
    actual = test.select(*keys, "time", F.col(target).alias("actual"))
    expected = actual.groupBy(*keys).agg(F.count(F.lit(1)).alias("_expected"))
    joined = forecast.select(*keys, "model", "time", "forecast").join(actual, [*keys, "time"])
    found = joined.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("_found"))
    whole = found.join(expected, list(keys)).where("_found = _expected").select(*keys, "model")
    return joined.join(whole, [*keys, "model"], "left_semi").select(
        *keys, "model", "time", "actual", "forecast"
    )


def align_by_position(
    test: DataFrame, forecast: DataFrame, target: str, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """The i-th test row against the i-th forecast row, whatever their dates."""
    actual = with_position(
        test.select(*keys, "time", F.col(target).alias("actual")), keys
    ).drop(LENGTH)
    by_model = [*keys, "model"]
    placed = with_position(forecast.select(*by_model, "time", "forecast"), by_model).drop(
        LENGTH, "time"
    )
    return placed.join(actual, [*keys, POSITION]).select(
        *by_model, "time", "actual", "forecast"
    )


def rows_on_test_dates(
    forecast: DataFrame, test: DataFrame, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Forecast rows whose time is one of the key's test dates."""
    return forecast.join(test.select(*keys, "time"), [*keys, "time"], "left_semi")


def forecast_metrics(
    test: DataFrame,
    forecast: DataFrame,
    target: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    by_position: bool = False,
) -> DataFrame:
    """``(keys, model, mae, rmse, mape)`` of forecasts against test rows."""
    align = align_by_position if by_position else align_by_date
    pairs = align(test, forecast, target, keys)
    metrics = error_metrics(F.col("actual"), F.col("forecast"))
    return pairs.groupBy(*keys, "model").agg(*[m.alias(name) for name, m in metrics.items()])


def residual_interval(
    forecast: DataFrame, residuals: DataFrame, keys: Sequence[str] = DEFAULT_KEYS, z: float = 1.96
) -> DataFrame:
    """``forecast`` with ``lower_ci`` and ``upper_ci``: plus or minus ``z`` population
    standard deviations of the key's in-sample residuals (column ``residual``)."""
    width = residuals.groupBy(*keys).agg((z * F.stddev_pop("residual")).alias("_width"))
    return (
        forecast.join(width, list(keys), "left")
        .withColumn("lower_ci", F.col("forecast") - F.col("_width"))
        .withColumn("upper_ci", F.col("forecast") + F.col("_width"))
        .drop("_width")
    )


def compare_models(metrics: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Metrics of every model with the best model of each metric marked.

    Works on one row per key and model.  Ties go to the first name.
    """
    rivals = Window.partitionBy(*keys)
    best = [
        (F.min_by("model", F.struct(m, "model")).over(rivals) == F.col("model")).alias(f"best_{m}")
        for m in METRICS
    ]
    return metrics.select(*keys, "model", *METRICS, *best)


def best_models(metrics: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """One row per key: the model with the lowest value of each metric."""
    return metrics.groupBy(*keys).agg(
        *[F.min_by("model", F.struct(m, "model")).alias(f"best_{m}") for m in METRICS]
    )


def history_plus_forecast(
    history: DataFrame,
    forecast: DataFrame,
    target: str,
    keys: Sequence[str] = DEFAULT_KEYS,
    days: int = 365,
) -> DataFrame:
    """Last rows of history and all forecast rows in one table.

    History rows fill ``observed``; forecast rows fill ``model``, ``forecast``
    and the band.
    """
    past = last_n(history.select(*keys, "time", F.col(target).alias("observed")), days, keys)
    ahead = forecast.select(*keys, "time", "model", "forecast", "lower_ci", "upper_ci")
    joined = append(
        past.withColumn("series", F.lit("history")), ahead.withColumn("series", F.lit("forecast"))
    )
    return joined.select(
        *keys, "series", "time", "observed", "model", "forecast", "lower_ci", "upper_ci"
    )
