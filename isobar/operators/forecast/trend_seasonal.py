"""Piecewise-linear trend with yearly and weekly Fourier terms.

A ridge regression stands in for a Bayesian fit of the same curve: the numbers
are those of penalised least squares, and the band is that of its residuals.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...schema import DEFAULT_KEYS
from ..series import BLOCK
from .common import Z95, days_after, extent, train_rows, with_steps

# Shape of the curve.
KNOTS = 25
KNOT_RANGE = 0.8
CYCLES = ((365.25, 10), (7.0, 3))
# How strongly trend changes and seasonal terms are held back,
# relative to noise of one tenth of the largest value.
KNOT_PENALTY = (0.1 / 0.05) ** 2
SEASON_PENALTY = (0.1 / 10.0) ** 2

SIZE = 2 + KNOTS + 2 * sum(order for _, order in CYCLES)
_KNOT_AT = [KNOT_RANGE * (i + 1) / KNOTS for i in range(KNOTS)]


def _design(days: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Curve terms per row from days since the epoch and the share of history passed."""
    columns = [np.ones_like(share), share, *[np.maximum(share - k, 0.0) for k in _KNOT_AT]]
    for period, order in CYCLES:
        for n in range(1, order + 1):
            angle = 2 * np.pi * n * days / period
            columns += [np.sin(angle), np.cos(angle)]
    return np.column_stack(columns)


def _curve_terms(days: Column, share: Column) -> list[Column]:
    """The same terms as :func:`_design`, as expressions."""
    terms = [F.lit(1.0), share, *[F.greatest(share - k, F.lit(0.0)) for k in _KNOT_AT]]
    for period, order in CYCLES:
        for n in range(1, order + 1):
            angle = days * (2 * math.pi * n / period)
            terms += [F.sin(angle), F.cos(angle)]
    return terms


_UPPER = np.triu_indices(SIZE + 1)


# Days of a series that one task adds up.
BLOCK_DAYS = 8192


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _added_up(parts: pd.Series) -> pd.Series:
    return pd.Series([np.sum(np.stack(p), axis=0) for p in parts])


@F.pandas_udf(
    T.StructType(
        [
            T.StructField("weights", T.ArrayType(T.DoubleType())),
            T.StructField("residual_std", T.DoubleType()),
        ]
    )
)
def _solve(
    products: pd.Series, rows: pd.Series, largest: pd.Series, center: pd.Series
) -> pd.DataFrame:
    """Penalised least squares for every key of the batch.

    The values have had their mean taken off, which the level, free of any
    penalty, gets back.
    """
    flat = np.vstack(products.to_numpy())
    full = np.empty((len(flat), SIZE + 1, SIZE + 1))
    full[:, _UPPER[0], _UPPER[1]] = flat
    full[:, _UPPER[1], _UPPER[0]] = flat
    gram, rhs, square = full[:, :-1, :-1], full[:, :-1, -1], full[:, -1, -1]
    penalty = np.concatenate(
        [[0.0, 0.0], np.full(KNOTS, KNOT_PENALTY), np.full(SIZE - 2 - KNOTS, SEASON_PENALTY)]
    )
    weights = (np.linalg.pinv(gram + np.diag(penalty), hermitian=True) @ rhs[..., None])[..., 0]
    left = square - 2 * (weights * rhs).sum(axis=1)
    left = left + np.einsum("ki,kij,kj->k", weights, gram, weights)
    scale = largest.to_numpy()
    scaled = weights * scale[:, None]
    scaled[:, 0] += center.to_numpy()
    return pd.DataFrame(
        {
            "weights": list(scaled),
            "residual_std": np.sqrt(np.maximum(left, 0.0) / rows.to_numpy()) * scale,
        }
    )


def forecast_trend_seasonal(
    split: DataFrame,
    forecast_days: int = 90,
    target: str = "temperature_2m_mean",
    keys: Sequence[str] = DEFAULT_KEYS,
    include_history: bool = True,
) -> DataFrame:
    """Fitted curve over history (optional) and future with a constant band.

    Each block of days gives one small matrix of products, whatever rows it holds; the
    matrices of a key are added up, so no key gathers in one task.
    """
    day = (F.datediff(F.to_date("time"), F.lit("1970-01-01").cast("date"))).cast("double")
    known = train_rows(split).dropna(subset=[target, "time", *keys])
    series = known.select(*keys, day.alias("_days"), F.col(target).cast("double").alias("_y"))
    totals = series.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.min("_days").alias("_first"),
        F.max("_days").alias("_last"),
        F.avg("_y").alias("_center"),
        F.min("_y").alias("_low"),
        F.max("_y").alias("_high"),
    )
    # Work on distances from the mean, of at most 1; a level series stays zero.
    center = F.col("_center")
    largest = F.greatest(F.col("_high") - center, center - F.col("_low"))
    shape = totals.select(
        *keys, "_rows", "_first", "_last", "_center", F.coalesce(F.nullif(largest, F.lit(0.0)), F.lit(1.0)).alias("_scale")
    )
    span = F.nullif(F.col("_last") - F.col("_first"), F.lit(0.0))
    share = F.coalesce((F.col("_days") - F.col("_first")) / span, F.lit(0.0))
    scaled = series.join(shape, list(keys)).select(
        *keys,
        F.floor(F.col("_days") / BLOCK_DAYS).alias(BLOCK),
        "_days",
        share.alias("_share"),
        ((F.col("_y") - center) / F.col("_scale")).alias("_y"),
    )
    key_fields = [f for f in split.schema.fields if f.name in keys]
    names = [f.name for f in key_fields]
    part_schema = T.StructType([*key_fields, T.StructField("_parts", T.ArrayType(T.DoubleType()))])

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total = None, None
        for batch in batches:
            if batch.empty:
                continue
            columns = _design(batch["_days"].to_numpy(), batch["_share"].to_numpy())
            table = np.column_stack([columns, batch["_y"].to_numpy()])
            own = batch[names].reset_index(drop=True)
            starts = np.flatnonzero((own != own.shift()).any(axis=1))
            done = []
            for s, e in zip(starts, [*starts[1:], len(own)], strict=True):
                here, part = tuple(own.iloc[s]), (table[s:e].T @ table[s:e])[_UPPER]
                if here != key and key is not None:
                    done.append((*key, total))
                total = total + part if here == key else part
                key = here
            yield pd.DataFrame(done, columns=part_schema.names)
        if key is not None:
            yield pd.DataFrame([(*key, total)], columns=part_schema.names)

    # A fixed number of tasks: the work lies in the terms, not in the bytes that are read.
    tasks = int(split.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = scaled.repartition(tasks, *keys, BLOCK).sortWithinPartitions(*keys)
    parts = sorted_rows.select(*names, "_days", "_share", "_y").mapInPandas(products, part_schema)
    listed = parts.groupBy(*keys).agg(F.collect_list("_parts").alias("_listed"))
    summed = listed.select(*keys, _added_up("_listed").alias("_products"))
    fitted = summed.join(shape, list(keys)).select(
        *keys, "_first", "_last", _solve("_products", "_rows", "_scale", "_center").alias("_fit")
    )
    fitted = fitted.select(*keys, "_first", "_last", "_fit.weights", "_fit.residual_std")

    ahead = with_steps(extent(split, keys), forecast_days).select(
        *keys, "last_time", F.explode(F.sequence(F.lit(1), F.col("steps"))).alias("_i")
    )
    times = ahead.select(*keys, days_after(F.col("last_time"), F.col("_i")).alias("time"))
    if include_history:
        times = train_rows(split).select(*keys, "time").unionByName(times)
    dated = times.withColumn("_days", day).join(fitted, list(keys))
    terms = F.array(*_curve_terms(F.col("_days"), share))
    curve = F.aggregate(
        F.zip_with(terms, "weights", lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v
    )
    width = Z95 * F.col("residual_std")
    return dated.withColumn("forecast", curve).select(
        *keys,
        F.lit("trend_seasonal").alias("model"),
        "time",
        "forecast",
        (F.col("forecast") - width).alias("lower_ci"),
        (F.col("forecast") + width).alias("upper_ci"),
    )
