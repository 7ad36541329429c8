"""Seasonal autoregressive moving-average forecasts by two least-squares fits.

A long autoregression gives estimates of the shocks; the differenced series is
then regressed on its own lags and on lagged shocks (Hannan and Rissanen).  A
likelihood search over the same orders gives other coefficients and so other
numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...schema import DEFAULT_KEYS
from ..clean import regularize_daily
from ..series import BLOCK, block_arrays, with_day_blocks
from ..timeseries import lagged_products
from .common import (
    Z95,
    _block,
    days_after,
    extent,
    least_squares,
    merged_blocks,
    moment_matrix,
    train_rows,
    with_steps,
)

# Weekly season, largest orders tried, orders used without a search.
SEASON = 7
MOST = 3
DEFAULT_ORDER = (1, 1)

LONG_AR = 21
LAGS = (*range(1, MOST + 1), SEASON)
TERMS = [*[f"_w{k}" for k in LAGS], *[f"_e{k}" for k in LAGS]]
ORDERS = [(p, q) for p in range(MOST + 1) for q in range(MOST + 1)]
# Rows before the first usable one: both differences, the long lags, the terms.
REACH = SEASON + 1 + LONG_AR + SEASON
_TAIL = SEASON + 1
_DOUBLES = T.ArrayType(T.DoubleType())


@F.pandas_udf(_DOUBLES)
def _long_autoregression(sums: pd.Series) -> pd.Series:
    """Yule-Walker coefficients of every series of the batch."""
    cov = np.vstack(sums.to_numpy())
    size = cov.shape[1] - 1
    apart = np.abs(np.subtract.outer(np.arange(size), np.arange(size)))
    return pd.Series(list(least_squares(cov[:, apart], cov[:, 1:])))


def series_blocks(
    split: DataFrame, target: str = "temperature_2m_mean", keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """The training days of each series in blocks, one array each, a value a day.

    What every fit here reads.  Each block is led by enough earlier days for all later
    steps, so the last one with days of its own also ends in the days a forecast runs on.
    Store it to fit several models on the same series.
    """
    daily = regularize_daily(train_rows(split).select(*keys, "time", target), keys, [target])
    rows = daily.select(*keys, "time", F.col(target).cast("double").alias("_y"))
    return block_arrays(with_day_blocks(rows, before=_TAIL + REACH), keys, "_y")


def _tails(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``tail`` per key: its latest days, as many as a forecast looks back on."""
    size, most = F.size("_values"), _TAIL + REACH
    latest = F.slice("_values", F.greatest(size - (most - 1), F.lit(1)), most)
    return blocks.where(size > F.col("_context")).groupBy(*keys).agg(F.max_by(latest, BLOCK).alias("tail"))


def _differenced(values: np.ndarray, seasonal: bool) -> np.ndarray:
    """Change by a day and, if asked, by a week on top; unknown where it reaches too far back."""
    moves = np.diff(np.asarray(values, dtype=float), prepend=np.nan)
    if seasonal:
        moves = moves - np.concatenate([np.full(SEASON, np.nan), moves[:-SEASON]])[: len(moves)]
    return moves


def _lagged(x: np.ndarray, k: int) -> np.ndarray:
    return np.concatenate([np.full(k, np.nan), x[:-k]])[: len(x)]


@F.pandas_udf(_DOUBLES)
def _block_products(values: pd.Series, context: pd.Series, seasonal: pd.Series) -> pd.Series:
    """Sums of products of differences up to ``LONG_AR`` rows apart."""
    return pd.Series(
        [lagged_products(_differenced(v, s), c, LONG_AR) for v, c, s in zip(values, context, seasonal, strict=True)]
    )


def _long_weights(blocks: DataFrame, keys: Sequence[str], seasonal: bool) -> DataFrame:
    """``_phi`` per key: the long autoregression of the differences.

    Differencing leaves a mean of nearly zero, so none is taken off.
    """
    products = blocks.select(*keys, _block_products("_values", "_context", F.lit(seasonal)).alias("_p"))
    totals = products.groupBy(*keys).agg(
        F.array(*[F.sum(F.col("_p")[k]) for k in range(LONG_AR + 1)]).alias("_sums")
    )
    return totals.select(*keys, _long_autoregression("_sums").alias("_phi"))


_PART = T.StructType([T.StructField("_count", T.DoubleType()), T.StructField("_block", _DOUBLES)])


@F.pandas_udf(_PART)
def _block_moments(values: pd.Series, context: pd.Series, phi: pd.Series, seasonal: pd.Series) -> pd.DataFrame:
    """Count, means and products of all lag terms and the response over each block's own rows."""
    upper = np.triu_indices(len(TERMS) + 1)
    counts, parts = [], []
    for v, c, long, s in zip(values, context, phi, seasonal, strict=True):
        w = _differenced(v, s)
        shocks = w - sum(f * _lagged(w, k) for k, f in enumerate(long, start=1))
        columns = [*[_lagged(w, k) for k in LAGS], *[_lagged(shocks, k) for k in LAGS], w]
        table = np.stack(columns, axis=1)[c:]
        table = table[~np.isnan(table).any(axis=1)]
        counts.append(float(len(table)))
        if len(table):
            _, mean, products = _block(table)
            parts.append(np.concatenate([mean, products[upper]]))
        else:
            parts.append(None)
    return pd.DataFrame({"_count": counts, "_block": parts})


def _moments(blocks: DataFrame, long: DataFrame, keys: Sequence[str], seasonal: bool) -> DataFrame:
    """Per key, means and second moments of all lag terms and the response."""
    parts = blocks.join(long, list(keys)).select(
        *keys, _block_moments("_values", "_context", "_phi", F.lit(seasonal)).alias("_part")
    )
    known = parts.select(*keys, "_part.*").where("_count > 0")
    return merged_blocks(known, len(TERMS) + 1, keys)


_CANDIDATES = T.ArrayType(
    T.StructType(
        [
            T.StructField("p", T.IntegerType()),
            T.StructField("q", T.IntegerType()),
            T.StructField("aicc", T.DoubleType()),
            T.StructField("level", T.DoubleType()),
            T.StructField("weights", _DOUBLES),
            T.StructField("variance", T.DoubleType()),
        ]
    )
)


def _used_terms(p: int, q: int) -> np.ndarray:
    """Indices into ``TERMS`` of an order; the weekly terms always take part."""
    own = [i for i, k in enumerate(LAGS) if k <= p or k == SEASON]
    shocks = [len(LAGS) + i for i, k in enumerate(LAGS) if k <= q or k == SEASON]
    return np.array(own + shocks)


@F.pandas_udf(_CANDIDATES)
def _fit_orders(means: pd.Series, moments: pd.Series, rows: pd.Series) -> pd.Series:
    """Every order for every key of the batch, each from a part of the same moments."""
    cov = moment_matrix(np.vstack(moments.to_numpy()), len(TERMS) + 1)
    center = np.vstack(means.to_numpy())
    n = rows.to_numpy(dtype=float)
    found: list[list[dict]] = [[] for _ in range(len(n))]
    for p, q in ORDERS:
        used = _used_terms(p, q)
        gram, rhs = cov[:, used[:, None], used], cov[:, used, -1]
        part = least_squares(gram, rhs)
        variance = np.maximum(cov[:, -1, -1] - (part * rhs).sum(axis=1), 1e-12)
        level = center[:, -1] - (part * center[:, used]).sum(axis=1)
        count = len(used) + 2
        spare = np.where(n - count - 1 > 0, n - count - 1, np.nan)
        aicc = n * np.log(variance) + 2 * count + 2 * count * (count + 1) / spare
        weights = np.zeros((len(n), len(TERMS)))
        weights[:, used] = part
        for i, orders in enumerate(found):
            orders.append(
                {
                    "p": p,
                    "q": q,
                    "aicc": None if np.isnan(aicc[i]) else float(aicc[i]),
                    "level": float(level[i]),
                    "weights": weights[i].tolist(),
                    "variance": float(variance[i]),
                }
            )
    return pd.Series(found)


def _candidates(blocks: DataFrame, keys: Sequence[str], seasonal: bool) -> DataFrame:
    """One row per key and order with its fit and the key's ``_phi``."""
    long = _long_weights(blocks, keys, seasonal)
    fits = _moments(blocks, long, keys, seasonal).select(
        *keys, _fit_orders("_means", "_moments", "_rows").alias("_fits")
    )
    return fits.join(long, list(keys)).select(*keys, "_phi", F.inline("_fits"))


def order_search(
    split: DataFrame,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """``(keys, p, q, aicc, best)`` for all orders up to three, weekly and daily
    differences taken.

    An order that a key is too short for has no ``aicc`` and is never best.  A key
    too short for any lagged row has one row without an order.
    """
    train = train_rows(split)
    fits = _candidates(series_blocks(split, target, keys), keys, seasonal=True)
    usable = fits.where(F.col("aicc").isNotNull())
    chosen = usable.groupBy(*keys).agg(
        F.min_by(F.struct("p", "q"), F.struct("aicc", "p", "q")).alias("_best")
    )
    joined = train.select(*keys).distinct().join(fits, list(keys), "left").join(chosen, list(keys), "left")
    best = (F.col("p") == F.col("_best.p")) & (F.col("q") == F.col("_best.q"))
    return joined.select(*keys, "p", "q", "aicc", F.coalesce(best, F.lit(False)).alias("best"))


@F.pandas_udf(
    T.StructType([T.StructField("path", _DOUBLES), T.StructField("spread", _DOUBLES)])
)
def _run_forward(
    weights: pd.Series,
    level: pd.Series,
    variance: pd.Series,
    seasonal: pd.Series,
    phi: pd.Series,
    tail: pd.Series,
    steps: pd.Series,
) -> pd.DataFrame:
    """Forecasts and their standard deviations, all keys of the batch together.

    The response to one unit shock follows the same recursion as the forecast,
    so both run through one loop.
    """
    horizon = int(steps.max())
    size = len(weights)
    own, shock = np.split(np.vstack(weights.to_numpy()), 2, axis=1)
    weekly = seasonal.to_numpy(dtype=float)

    # Latest values, their differences and shocks, as in training.
    past = np.full((size, _TAIL + REACH), np.nan)
    for i, values in enumerate(tail):
        past[i, _TAIL + REACH - len(values) :] = values
    moves = np.diff(past, axis=1)
    moves = moves[:, SEASON:] - weekly[:, None] * moves[:, :-SEASON]
    long = np.vstack(phi.to_numpy())
    jolts = moves[:, LONG_AR:].copy()
    for k in range(1, LONG_AR + 1):
        jolts -= long[:, k - 1 : k] * moves[:, LONG_AR - k : -k]

    def started(values: np.ndarray) -> np.ndarray:
        latest = np.nan_to_num(values[:, -_TAIL:])
        return np.hstack([latest, np.zeros((size, horizon))])

    y, w, e = started(past), started(moves), started(jolts)
    zeros = np.zeros((size, _TAIL + horizon))
    y1, w1, e1 = zeros.copy(), zeros.copy(), zeros.copy()
    for step in range(horizon):
        now = _TAIL + step
        if step == 0:
            e1[:, now] = 1.0
        for values, diffs, shocks, base in ((y, w, e, level.to_numpy()), (y1, w1, e1, 0.0)):
            diffs[:, now] = base + shocks[:, now]
            for i, k in enumerate(LAGS):
                diffs[:, now] += own[:, i] * diffs[:, now - k] + shock[:, i] * shocks[:, now - k]
            last_week = values[:, now - SEASON] - values[:, now - SEASON - 1]
            values[:, now] = values[:, now - 1] + weekly * last_week + diffs[:, now]
    deviation = np.sqrt(variance.to_numpy()[:, None] * np.cumsum(y1[:, _TAIL:] ** 2, axis=1))
    return pd.DataFrame(
        {
            "path": [y[i, _TAIL : _TAIL + n] for i, n in enumerate(steps)],
            "spread": [deviation[i, :n] for i, n in enumerate(steps)],
        }
    )


def fit_seasonal_ar(
    split: DataFrame,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    search: bool = False,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """The fitted models as a table, one row per key, to be stored and run later.

    ``keys, last_time, train_rows, test_rows, mean, deviation, tail, weekly, fits, level,
    weights, variance, phi``: weights and the long autoregression ``phi`` of the chosen
    order, and the latest days they run on.  ``fits`` is null for a key too short to fit.
    ``blocks`` is the stored table of :func:`series_blocks`, if there is one.
    """
    if blocks is None:
        blocks = series_blocks(split, target, keys)
    fits = _candidates(blocks, keys, seasonal=search)
    if search:
        usable = fits.where(F.col("aicc").isNotNull())
        chosen = usable.groupBy(*keys).agg(
            F.min_by(
                F.struct("level", "weights", "variance", F.col("_phi").alias("phi")), F.struct("aicc", "p", "q")
            ).alias("_f")
        ).select(*keys, "_f.*")
    else:
        p, q = DEFAULT_ORDER
        chosen = fits.where((F.col("p") == p) & (F.col("q") == q)).select(
            *keys, "level", "weights", "variance", F.col("_phi").alias("phi")
        )
    known = train_rows(split).groupBy(*keys).agg(
        F.avg(target).alias("mean"), F.stddev_samp(target).alias("deviation")
    )
    return (
        extent(split, keys)
        .join(known, list(keys))
        .join(_tails(blocks, keys), list(keys), "left")
        .withColumn("weekly", F.lit(1.0 if search else 0.0))
        .join(chosen.withColumn("fits", F.lit(True)), list(keys), "left")
    )


def run_seasonal_ar(models: DataFrame, forecast_days: int = 90, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Forecasts from the table of :func:`fit_seasonal_ar`; keys without a fit get their mean."""
    # Keys without a fit run along on zeros, so that nothing is computed twice.
    run = _run_forward(
        F.coalesce("weights", F.array_repeat(F.lit(0.0), F.lit(len(TERMS)))),
        F.coalesce("level", F.lit(0.0)),
        F.coalesce("variance", F.lit(0.0)),
        "weekly",
        F.coalesce("phi", F.array_repeat(F.lit(0.0), F.lit(LONG_AR))),
        F.coalesce("tail", F.array().cast(_DOUBLES)),
        "steps",
    )
    solved = with_steps(models, forecast_days).withColumn("_out", run)
    pairs = F.arrays_zip(F.col("_out.path").alias("path"), F.col("_out.spread").alias("spread"))
    daily_rows = solved.select(*keys, "last_time", "fits", "mean", "deviation", F.posexplode(pairs).alias("_i", "_at"))

    def either(fitted: Column, mean: Column) -> Column:
        return F.when(F.col("fits"), fitted).otherwise(mean)

    path, spread = F.col("_at.path"), Z95 * F.col("_at.spread")
    mean, width = F.col("mean"), 2 * F.col("deviation")
    return daily_rows.select(
        *keys,
        either(F.lit("seasonal_ar"), F.lit("seasonal_ar_mean")).alias("model"),
        days_after(F.col("last_time"), F.col("_i") + 1).alias("time"),
        either(path, mean).alias("forecast"),
        either(path - spread, mean - width).alias("lower_ci"),
        either(path + spread, mean + width).alias("upper_ci"),
    )


def forecast_seasonal_ar(
    split: DataFrame,
    forecast_days: int = 90,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    search: bool = False,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Daily forecasts with a 95 percent band that widens with the horizon.

    ``search`` picks the order with the lowest corrected information criterion
    for each key; otherwise the fixed order is used.  Keys too short to fit get
    the mean forecast over the same days, as model ``seasonal_ar_mean``.  ``blocks`` as in
    :func:`fit_seasonal_ar`.
    """
    return run_seasonal_ar(fit_seasonal_ar(split, target, keys, search, blocks), forecast_days, keys)
