"""Descriptive statistics, correlations and straight-line fits per key."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DEFAULT_KEYS, variable_columns
from .quantiles import exact_quantiles


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def long_form(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``(keys, variable, value)`` rows of the given columns."""
    doubles = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keys), list(columns), "variable", "value")


def corrected_skewness(value: Column) -> Column:
    """Aggregate: bias-corrected skewness; null below 3 values, 0 when constant."""
    n = F.count(value).cast("double")
    factor = F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    raw = F.when(F.var_pop(value) == 0, F.lit(0.0)).otherwise(F.skewness(value))
    return F.when(n >= 3, factor * raw)


def corrected_kurtosis(value: Column) -> Column:
    """Aggregate: bias-corrected excess kurtosis; null below 4 values, 0 when constant."""
    n = F.count(value).cast("double")
    scale = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0))
    corrected = scale * ((n + 1) * F.kurtosis(value) + 6)
    flat = F.var_pop(value) == 0
    return F.when(n >= 4, F.when(flat, F.lit(0.0)).otherwise(corrected))


def with_quantiles(stats: DataFrame, quantiles: DataFrame, group: Sequence[str]) -> DataFrame:
    """Quantiles beside the other figures of their group; a null key is a group too."""
    other = {c: f"_of_{c}" for c in group}
    same = F.lit(True)
    for c, o in other.items():
        same = same & F.col(c).eqNullSafe(F.col(o))
    return stats.join(quantiles.withColumnsRenamed(other), same, "left").drop(*other.values())


def describe_stats(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles, maximum and shape.

    One row per key and variable.  Quartiles interpolate linearly between ranks and are
    exact for groups of any size, so the rows are gone over more than once: store them
    first if they are dear to make.
    """
    columns = list(columns or variable_columns(df, keys))
    group = [*keys, "variable"]
    long = long_form(df, keys, columns)
    value = F.col("value")
    stats = long.groupBy(*group).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        corrected_skewness(value).alias("skewness"),
        corrected_kurtosis(value).alias("kurtosis"),
    )
    return with_quantiles(stats, exact_quantiles(long, group, "value", QUARTILES), group).select(
        *group, "count", "mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis"
    )


def skew_kurtosis(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis per key and variable."""
    columns = list(columns or variable_columns(df, keys))
    value = F.col("value")
    return (
        long_form(df, keys, columns)
        .groupBy(*keys, "variable")
        .agg(
            corrected_skewness(value).alias("skewness"),
            corrected_kurtosis(value).alias("kurtosis"),
        )
    )


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: Pearson correlation over rows where both are known; null when
    either side does not vary."""
    spread = F.sqrt(F.regr_sxx(y, x) * F.regr_syy(y, x))
    return F.try_divide(F.regr_sxy(y, x), F.nullif(spread, F.lit(0.0)))


def correlation_matrix(
    df: DataFrame,
    keys: Sequence[str] = DEFAULT_KEYS,
    columns: Sequence[str] | None = None,
    lower_triangle: bool = False,
) -> DataFrame:
    """Pearson correlation of each pair: ``(keys, var_x, var_y, corr)``.

    All pairs come from one aggregate, which shrinks to one row per key and pair
    before the exchange.  Each unordered pair is computed once and mirrored; ``lower_triangle`` keeps pairs below the diagonal only.
    """
    columns = list(columns or variable_columns(df, keys))
    pairs = list(combinations(columns, 2)) + ([] if lower_triangle else [(c, c) for c in columns])

    # One row per pair leaves three running sums to each group; as columns of one
    # wide aggregate the pairs would outgrow what the engine can compile.
    entries = ", ".join(
        f"struct({i} AS _pair, CAST(`{x}` AS DOUBLE) AS _x, CAST(`{y}` AS DOUBLE) AS _y)"
        for i, (x, y) in enumerate(pairs)
    )
    long = df.selectExpr(*[f"`{k}`" for k in keys], f"inline(array({entries}))")
    figures = long.groupBy(*keys, "_pair").agg(pearson(F.col("_x"), F.col("_y")).alias("corr"))

    def name_of(side: int) -> Column:
        return F.element_at(F.array(*[F.lit(p[side]) for p in pairs]), F.col("_pair") + 1)

    x, y = name_of(0).alias("_first"), name_of(1).alias("_second")
    named = figures.select(*keys, x, y, "corr")
    below = F.struct(F.col("_second").alias("var_x"), F.col("_first").alias("var_y"))
    above = F.struct(F.col("_first").alias("var_x"), F.col("_second").alias("var_y"))
    sides = [below] if lower_triangle else [below, above]
    mirrored = F.array_distinct(F.array(*sides))
    return named.select(*keys, F.explode(mirrored).alias("_p"), "corr").select(
        *keys, "_p.var_x", "_p.var_y", "corr"
    )


def linear_fit(
    df: DataFrame, x: str, y: str, keys: Sequence[str] = DEFAULT_KEYS
) -> DataFrame:
    """Least-squares line of ``y`` on ``x``: ``(keys, slope, intercept, r2, n)``."""
    x_value, y_value = F.col(x), F.col(y)
    return df.groupBy(*keys).agg(
        F.regr_slope(y_value, x_value).alias("slope"),
        F.regr_intercept(y_value, x_value).alias("intercept"),
        F.regr_r2(y_value, x_value).alias("r2"),
        F.regr_count(y_value, x_value).alias("n"),
    )
