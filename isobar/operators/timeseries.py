"""Series operators: lags, rolling means, autocorrelation, splits, first and last rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import seasonal_encoding
from ..schema import DEFAULT_KEYS, require
from .clean import fill_forward_backward
from .series import (
    BLOCK,
    CORE,
    LENGTH,
    POSITION,
    block_arrays,
    block_window,
    core_only,
    neighbours,
    with_blocks,
    with_position,
)

# The lags and rolling widths of the regression features.
LAGS = (1, 2, 7, 30, 365)
ROLLING = (7, 30)


def lag_columns(target: str, keys: Sequence[str], lags: Sequence[int] = LAGS) -> dict[str, Column]:
    """Lags by row position, inside blocks."""
    window = block_window(keys)
    return {f"lag_{k}": F.lag(target, k).over(window) for k in lags}


def rolling_columns(
    target: str, keys: Sequence[str], widths: Sequence[int] = ROLLING
) -> dict[str, Column]:
    """Mean of the previous rows, current excluded; null unless all are known."""
    out = {}
    for k in widths:
        window = block_window(keys).rowsBetween(-k, -1)
        full = F.count(target).over(window) == k
        out[f"rolling_mean_{k}"] = F.when(full, F.avg(target).over(window))
    return out


def _with_frames(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, Column],
    before: int,
    after: int = 0,
    time: str = "time",
) -> DataFrame:
    """``df`` with bounded-frame columns added."""
    blocks = with_blocks(with_position(df, keys, time), keys, before, after)
    return core_only(
        blocks.select("*", *[c.alias(name) for name, c in columns.items()]), POSITION, LENGTH
    )


def lag_features(
    df: DataFrame,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    lags: Sequence[int] = LAGS,
) -> DataFrame:
    """``df`` with ``lag_<k>`` columns by row position."""
    require(df, "time", target)
    return _with_frames(df, keys, lag_columns(target, keys, lags), before=max(lags))


def rolling_mean_features(
    df: DataFrame,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    widths: Sequence[int] = ROLLING,
) -> DataFrame:
    """``df`` with ``rolling_mean_<k>`` columns of the previous ``k`` rows."""
    require(df, "time", target)
    return _with_frames(df, keys, rolling_columns(target, keys, widths), before=max(widths))


def centered_rolling_mean(
    df: DataFrame,
    width: int,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    name: str = "centered_mean",
) -> DataFrame:
    """Centred rolling mean over the known values of each frame.

    An even width reaches one row further back than ahead.
    """
    require(df, "time", target)
    ahead = (width - 1) // 2
    back = width - 1 - ahead
    window = block_window(keys).rowsBetween(-back, ahead)
    return _with_frames(df, keys, {name: F.avg(target).over(window)}, back, ahead)


def ml_feature_names() -> list[str]:
    return [
        "month",
        "sin_dayofyear",
        "cos_dayofyear",
        *[f"lag_{k}" for k in LAGS],
        *[f"rolling_mean_{k}" for k in ROLLING],
    ]


def ml_feature_frame(
    df: DataFrame,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Regression features per row: ``keys, time, target`` and the feature columns.

    A missing feature takes the next known value of its column, else the last
    known one, else 0.0, as backfill followed by forward fill does.
    """
    require(df, "time", target)
    names = ml_feature_names()
    series = df.select(*keys, "time", F.col(target).cast("double").alias(target))
    framed = {**lag_columns(target, keys), **rolling_columns(target, keys)}
    sine, cosine = seasonal_encoding(F.col("time"))
    blocks = with_blocks(with_position(series, keys), keys, before=max(LAGS))
    features = blocks.select(
        *keys,
        "time",
        target,
        POSITION,
        BLOCK,
        CORE,
        F.month("time").cast("double").alias("month"),
        sine.alias("sin_dayofyear"),
        cosine.alias("cos_dayofyear"),
        *[c.alias(name) for name, c in framed.items()],
    ).where(CORE)
    near = neighbours(features, keys, list(framed), time=POSITION, cell=BLOCK)
    known = [c for c in names if c not in framed]
    return near.select(
        *keys,
        "time",
        target,
        *known,
        *[
            F.coalesce(c, f"_next_{c}", f"_prev_{c}", F.lit(0.0)).alias(c)
            for c in framed
        ],
    )


def train_test_split(
    df: DataFrame, test_size: int = 30, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """``df`` with ``split`` = ``train`` or ``test``: the last rows by time are test.

    A series no longer than ``test_size`` trains on its first 80 percent.
    """
    require(df, "time")
    train_rows = F.when(F.col(LENGTH) > test_size, F.col(LENGTH) - test_size).otherwise(
        F.floor(F.col(LENGTH) * 0.8)
    )
    split = F.when(F.col(POSITION) < train_rows, F.lit("train")).otherwise(F.lit("test"))
    return with_position(df, keys).withColumn("split", split).drop(POSITION, LENGTH)


def _ranked(df: DataFrame, n: int, keys: Sequence[str], order: Column) -> DataFrame:
    """At most ``n`` rows per key.  The rank filter is pushed below the exchange,
    so each input task sends no more than ``n`` rows of a key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def last_n(df: DataFrame, n: int, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The last ``n`` rows of each series by time."""
    return _ranked(df, n, keys, F.col("time").desc())


def first_n(df: DataFrame, n: int, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """The first ``n`` rows of each series by time."""
    return _ranked(df, n, keys, F.col("time").asc())


def lag_products(
    df: DataFrame,
    target: str,
    nlags: int,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Per key, ``n`` and ``sums``: at index k the sum of products of deviations
    from the mean that lie ``k`` rows apart.

    Each block of the series becomes one array, and all its products are taken in
    one pass over it; only ``nlags + 1`` numbers per key and task are exchanged.
    """
    series = df.select(*keys, "time", F.col(target).cast("double").alias("_x"))
    filled = fill_forward_backward(series, keys, ["_x"], unit="year")
    totals = {
        "_total": (F.sum("_x"), F.sum),
        "_known": (F.count("_x"), F.sum),
    }
    placed = with_position(filled, keys, totals=totals).withColumn(
        "_d", F.col("_x") - F.try_divide(F.col("_total"), F.col("_known"))
    )
    blocks = with_blocks(placed.select(*keys, POSITION, LENGTH, "_d"), keys, before=nlags)
    products = block_arrays(blocks, keys, "_d").select(
        *keys, _products("_values", "_context", F.lit(nlags)).alias("_p"), (F.size("_values") - F.col("_context")).alias("_core_rows")
    )
    return products.groupBy(*keys).agg(
        F.sum("_core_rows").alias("n"),
        F.array(*[F.sum(F.col("_p")[k]) for k in range(nlags + 1)]).alias("sums"),
    )


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _products(values: pd.Series, context: pd.Series, nlags: pd.Series) -> pd.Series:
    """Sums of products of a block's rows with those 0 to ``nlags`` rows before."""
    return pd.Series([lagged_products(v, c, n) for v, c, n in zip(values, context, nlags, strict=True)])


def lagged_products(values: np.ndarray, context: int, nlags: int) -> np.ndarray:
    """Index k: the sum over rows after the first ``context`` of the row times the one k before."""
    x = np.nan_to_num(np.asarray(values, dtype=float))
    sums = np.zeros(nlags + 1)
    for k in range(min(nlags, len(x) - 1) + 1):
        start = max(context, k)
        sums[k] = x[start:] @ x[start - k : len(x) - k]
    return sums


def _usable_lags(nlags: int) -> Column:
    """Highest lag of a series of ``n`` rows."""
    return F.least(F.lit(nlags), (F.floor(F.col("n") / 2) - 1).cast("int"))


def acf(
    df: DataFrame,
    target: str = "temperature_2m_mean",
    nlags: int = 40,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Autocorrelation: ``(keys, lag, acf)`` for lags 0 up to half the length."""
    sums = lag_products(df, target, nlags, keys)
    return sums.select(*keys, "n", F.posexplode("sums").alias("lag", "_s"), "sums").where(
        F.col("lag") <= _usable_lags(nlags)
    ).select(
        *keys, "lag", F.try_divide(F.col("_s"), F.nullif(F.col("sums")[0], F.lit(0.0))).alias("acf")
    )


def _durbin_levinson(cov: Column, nlags: int) -> Column:
    """Partial autocorrelations for lags 0 to ``nlags`` from autocovariances, one step a lag."""
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), cov[0].alias("error"), F.array(F.lit(1.0)).cast("array<double>").alias("partial"))

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        products = F.zip_with(phi, F.reverse(F.slice(cov, F.lit(2), k - 1)), lambda a, b: a * b)
        ahead = F.aggregate(products, F.lit(0.0), lambda total, v: total + v)

        def advanced(newest: Column) -> Column:
            moved = F.zip_with(phi, F.reverse(phi), lambda a, b: a - newest * b)
            return F.struct(
                F.concat(moved, F.array(newest)).alias("phi"),
                (state["error"] * (1 - newest * newest)).alias("error"),
                F.concat(state["partial"], F.array(newest)).alias("partial"),
            )

        # An array of one element names the value, so that it is computed once a step.
        newest = F.array(F.try_divide(F.get(cov, k) - ahead, state["error"]))
        return F.transform(newest, advanced)[0]

    return F.aggregate(F.sequence(F.lit(1), F.lit(nlags)), start, step, lambda state: state["partial"])


def pacf(
    df: DataFrame,
    target: str = "temperature_2m_mean",
    nlags: int = 40,
    keys: Sequence[str] = DEFAULT_KEYS,
) -> DataFrame:
    """Partial autocorrelation by Yule-Walker: ``(keys, lag, pacf)``.

    Folds the sums of :func:`acf`, divided by their numbers of pairs, lag by lag (Durbin
    and Levinson).  A series that does not vary has null from lag 1 on.
    """
    sums = lag_products(df, target, nlags, keys)
    pairs = F.transform("sums", lambda s, k: s / F.greatest(F.col("n") - k, F.lit(1)))
    solved = sums.select(*keys, "n", pairs.alias("_cov")).withColumn("_partial", _durbin_levinson(F.col("_cov"), nlags))
    return solved.select(*keys, "n", F.posexplode("_partial").alias("lag", "pacf")).where(
        F.col("lag") <= _usable_lags(nlags)
    ).select(*keys, "lag", "pacf")


def sort_by_time(df: DataFrame, keys: Sequence[str] = DEFAULT_KEYS) -> DataFrame:
    """Rows ordered for presentation, by key and time; a range-partitioned sort."""
    require(df, "time")
    return df.orderBy(*keys, "time")


def append(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Rows of all tables, columns matched by name, absent ones null."""
    out = first
    for df in more:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
