"""What the forecasting models share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..timeseries import last_n

Z95 = 1.96


def train_rows(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "train").drop("split")


def test_rows(split: DataFrame) -> DataFrame:
    return split.where(F.col("split") == "test").drop("split")


def extent(split: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: last training time, training rows and test rows."""
    train = F.col("split") == "train"
    sizes = split.groupBy(*keys).agg(
        F.max(F.when(train, F.col("time"))).alias("last_time"),
        F.count_if(train).alias("train_rows"),
        F.count_if(~train).alias("test_rows"),
    )
    return sizes.where(F.col("train_rows") > 0)


def with_steps(extents: DataFrame, forecast_days: int) -> DataFrame:
    """Days to forecast: those asked for, or the test rows if there are more."""
    return extents.withColumn("steps", F.greatest(F.col("test_rows"), F.lit(forecast_days)).cast("int"))


def days_after(start: Column, days: Column) -> Column:
    """A timestamp some whole days later."""
    return start + F.make_dt_interval(days=days.cast("int"))


def tail_arrays(
    df: DataFrame, columns: Sequence[str], rows: int, keys: Sequence[str]
) -> DataFrame:
    """Per key, the last ``rows`` values of each column as arrays in time order."""
    entry = F.struct("time", *columns)
    kept = last_n(df.select(*keys, "time", *columns), rows, keys)
    listed = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(entry)).alias("_tail"))
    return listed.select(*keys, *[F.col(f"_tail.{c}").alias(f"tail_{c}") for c in columns])


def gram_blocks(rows: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per key ``_rows``, ``_means`` and ``_moments``: row count, means, and central
    second moments (divided by the count) of all pairs, upper triangle row by row.

    Every task adds up the rows it holds to one block per key: count, means, and the
    matrix of products around them.  Blocks merge pairwise without cancellation
    (Chan, Golub and LeVeque), so only they are exchanged, one per key and task.
    Rows with a null in any column take no part.
    """
    names = list(columns)
    size = len(names)
    upper = np.triu_indices(size)
    fields = [f for f in rows.schema.fields if f.name in keys]
    schema = T.StructType(
        [*fields, T.StructField("_count", T.DoubleType()), T.StructField("_block", T.ArrayType(T.DoubleType()))]
    )

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, tuple] = {}
        for batch in batches:
            table = batch[names].to_numpy(dtype=float)
            usable = ~np.isnan(table).any(axis=1)
            batch, table = batch[usable], table[usable]
            for key, at in batch.groupby(list(keys), sort=False).indices.items():
                part = _block(table[at])
                key = key if isinstance(key, tuple) else (key,)
                held[key] = _merged(held[key], part) if key in held else part
            if len(held) > MOST_HELD:
                yield _block_rows(held, keys)
                held = {}
        if held:
            yield _block_rows(held, keys)

    def _block_rows(held: dict, keys: Sequence[str]) -> pd.DataFrame:
        out = pd.DataFrame(list(held), columns=[f.name for f in fields])
        out["_count"] = [float(n) for n, _, _ in held.values()]
        out["_block"] = [np.concatenate([mean, products[upper]]) for _, mean, products in held.values()]
        return out

    ordered = [f.name for f in fields]
    return merged_blocks(rows.select(*ordered, *names).mapInPandas(blocks, schema), size, keys)


def merged_blocks(parts: DataFrame, size: int, keys: Sequence[str]) -> DataFrame:
    """The result of :func:`gram_blocks` from blocks of ``size`` columns, ``_count`` and ``_block``."""
    upper = np.triu_indices(size)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def merged(counts: pd.Series, parts: pd.Series) -> pd.Series:
        found = []
        for n, some in zip(counts, parts, strict=True):
            n, some = np.asarray(n), np.vstack(some)
            mean = n @ some[:, :size] / n.sum()
            apart = some[:, :size] - mean
            products = some[:, size:].sum(axis=0) + ((apart * n[:, None]).T @ apart)[upper]
            found.append(np.concatenate([mean, products / n.sum()]))
        return pd.Series(found)

    listed = parts.groupBy(*keys).agg(F.collect_list(F.struct("_count", "_block")).alias("_b"))
    return listed.select(
        *keys,
        F.aggregate("_b._count", F.lit(0.0), lambda total, n: total + n).cast("bigint").alias("_rows"),
        merged("_b._count", "_b._block").alias("_m"),
    ).select(
        *keys, "_rows", F.slice("_m", 1, size).alias("_means"), F.slice("_m", size + 1, len(upper[0])).alias("_moments")
    )


#: Keys whose blocks a task holds before it sends them on.
MOST_HELD = 20_000


def _block(table: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    mean = table.mean(axis=0)
    apart = table - mean
    return len(table), mean, apart.T @ apart


def _merged(one: tuple, other: tuple) -> tuple[int, np.ndarray, np.ndarray]:
    n = one[0] + other[0]
    apart = other[1] - one[1]
    return n, one[1] + apart * (other[0] / n), one[2] + other[2] + np.outer(apart, apart) * (one[0] * other[0] / n)


def moment_matrix(flat: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices, one per row of ``flat``, from :func:`gram_blocks`."""
    rows, cols = np.triu_indices(size)
    out = np.empty((len(flat), size, size))
    out[:, rows, cols] = flat
    out[:, cols, rows] = flat
    return out


def least_squares(moments: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Minimum-norm coefficients for stacked normal equations."""
    inverse = np.linalg.pinv(moments, rcond=1e-13, hermitian=True)
    return (inverse @ rhs[..., None])[..., 0]


def forecast_rows(
    solved: DataFrame, model: str, keys: Sequence[str], predictions: str, half_width: Column
) -> DataFrame:
    """Daily rows from one row per key: array element i falls i + 1 days after training."""
    daily = solved.withColumn("_w", half_width).select(
        *keys, "last_time", "_w", F.posexplode(predictions).alias("_i", "forecast")
    )
    return daily.select(
        *keys,
        F.lit(model).alias("model"),
        days_after(F.col("last_time"), F.col("_i") + 1).alias("time"),
        "forecast",
        (F.col("forecast") - F.col("_w")).alias("lower_ci"),
        (F.col("forecast") + F.col("_w")).alias("upper_ci"),
    )
