"""Linear regression on lags, rolling means and season, forecast step by step."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions.calendar import DAYS_PER_YEAR
from ...schema import DEFAULT_KEYS
from ..timeseries import LAGS, ROLLING, ml_feature_frame, ml_feature_names
from .common import (
    Z95,
    extent,
    forecast_rows,
    gram_blocks,
    least_squares,
    moment_matrix,
    tail_arrays,
    train_rows,
    with_steps,
)


def _calendar_features(last_time: pd.Series, steps: int) -> np.ndarray:
    """Month and annual cycle of the days after each time: (rows, steps, 3)."""
    days = last_time.to_numpy().astype("datetime64[D]")[:, None] + np.arange(1, steps + 1)
    month = days.astype("datetime64[M]").astype(int) % 12 + 1
    of_year = (days - days.astype("datetime64[Y]")).astype(int) + 1
    angle = 2 * np.pi * of_year / DAYS_PER_YEAR
    return np.stack([month, np.sin(angle), np.cos(angle)], axis=-1).astype(float)


MODEL = T.StructType(
    [
        T.StructField("level", T.DoubleType()),
        T.StructField("weights", T.ArrayType(T.DoubleType())),
        T.StructField("residual_std", T.DoubleType()),
    ]
)


@F.pandas_udf(MODEL)
def _solve(means: pd.Series, moments: pd.Series) -> pd.DataFrame:
    """Each key's small system of equations."""
    size = len(ml_feature_names()) + 1
    cov = moment_matrix(np.vstack(moments.to_numpy()), size)
    center = np.vstack(means.to_numpy())
    x_cov, xy_cov, y_var = cov[:, :-1, :-1], cov[:, :-1, -1], cov[:, -1, -1]
    weights = least_squares(x_cov, xy_cov)
    explained = 2 * (weights * xy_cov).sum(axis=1) - np.einsum("ki,kij,kj->k", weights, x_cov, weights)
    return pd.DataFrame(
        {
            "level": center[:, -1] - (weights * center[:, :-1]).sum(axis=1),
            "weights": list(weights),
            "residual_std": np.sqrt(np.maximum(y_var - explained, 0.0)),
        }
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _run_forward(
    level: pd.Series, weights: pd.Series, tail: pd.Series, last_time: pd.Series, steps: pd.Series
) -> pd.Series:
    """Forecasts of all keys of the batch together, a day at a time."""
    base, factors = level.to_numpy(), np.vstack(weights.to_numpy())
    horizon, reach = int(steps.max()), max(LAGS)
    path = np.full((len(tail), reach + horizon), np.nan)
    for row, values in enumerate(tail):
        if len(values):
            path[row, reach - len(values) : reach] = values
    calendar = _calendar_features(last_time, horizon)
    for step in range(horizon):
        now = reach + step
        lagged = [path[:, now - k] for k in LAGS]
        rolled = [path[:, now - k : now].mean(axis=1) for k in ROLLING]
        row = np.column_stack([calendar[:, step], *lagged, *rolled])
        # Lags from before the series began count as zero.
        path[:, now] = base + (np.nan_to_num(row) * factors).sum(axis=1)
    return pd.Series([path[i, reach : reach + n] for i, n in enumerate(steps)])


def fit_lag_linear(
    split: DataFrame, target: str = "temperature_2m_mean", keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """The fitted models as a table, one row per key, to be stored and run later.

    ``keys, last_time, train_rows, test_rows, level, weights, residual_std, tail_y``:
    the weights are in the order of ``ml_feature_names``, the tail holds the last
    values a forecast looks back on.  Training is one pass for the moments; the solver
    sees one small array per key.  The series must be free of nulls but at its start,
    as daily tables are.
    """
    train = train_rows(split)
    features = ml_feature_frame(train, target, keys).dropna(subset=[target])
    moments = gram_blocks(features, [*ml_feature_names(), target], keys)
    solved = moments.select(*keys, _solve("_means", "_moments").alias("_m")).select(*keys, "_m.*")
    history = train.select(*keys, "time", F.col(target).cast("double").alias("y"))
    return extent(split, keys).join(solved, list(keys)).join(tail_arrays(history, ["y"], max(LAGS), keys), list(keys))


def run_lag_linear(models: DataFrame, forecast_days: int = 90, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Forecasts from the table of :func:`fit_lag_linear`."""
    ahead = _run_forward("level", "weights", "tail_y", "last_time", "steps")
    solved = with_steps(models, forecast_days).withColumn("predictions", ahead)
    return forecast_rows(solved, "linear_regression", keys, "predictions", Z95 * F.col("residual_std"))


def forecast_lag_linear(
    split: DataFrame,
    forecast_days: int = 90,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Recursive lag regression with a constant residual band.

    Each step feeds earlier predictions back as lags.  The horizon covers the
    test rows: the larger of their number and ``forecast_days``.
    """
    return run_lag_linear(fit_lag_linear(split, target, keys), forecast_days, keys)
