import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import seasonal_series, to_pandas, to_spark
from isobar.operators import decompose
from isobar.operators import timeseries as ts


@pytest.fixture(scope="module")
def frame():
    return seasonal_series([1200, 60, 13, 1, 20000])


@pytest.fixture(scope="module")
def df(spark, frame):
    return to_spark(spark, frame).cache()


def test_lags_and_rolling_means(df, frame):
    groups = frame.groupby("station_id")["v"]
    lags = to_pandas(ts.lag_features(df, "v"))
    for k in ts.LAGS:
        np.testing.assert_allclose(lags[f"lag_{k}"], groups.shift(k), equal_nan=True)
    rolled = to_pandas(ts.rolling_mean_features(df, "v"))
    for k in ts.ROLLING:
        want = groups.transform(lambda x, k=k: x.shift(1).rolling(k).mean())
        np.testing.assert_allclose(rolled[f"rolling_mean_{k}"], want, equal_nan=True)


@pytest.mark.parametrize("width", [7, 8])
def test_centered_mean(df, frame, width):
    got = to_pandas(ts.centered_rolling_mean(df, width, "v"))["centered_mean"]
    want = frame.groupby("station_id")["v"].transform(
        lambda x: x.rolling(width, center=True, min_periods=1).mean()
    )
    np.testing.assert_allclose(got, want)


def test_features_fill_backward_then_forward(spark):
    frame = seasonal_series([500, 40])
    frame.loc[[100, 101, 520], "v"] = np.nan
    got = to_pandas(ts.ml_feature_frame(to_spark(spark, frame), "v"))
    for station, one in frame.groupby("station_id"):
        mine = got[got.station_id == station].reset_index(drop=True)
        v = one["v"].reset_index(drop=True)
        for k in ts.LAGS:
            want = v.shift(k).bfill().ffill().fillna(0.0)
            np.testing.assert_allclose(mine[f"lag_{k}"], want, err_msg=f"{station} {k}")
        for k in ts.ROLLING:
            want = v.shift(1).rolling(k).mean().bfill().ffill().fillna(0.0)
            np.testing.assert_allclose(mine[f"rolling_mean_{k}"], want, atol=1e-9)


def plain_pacf(x, nlags):
    d, n = x - x.mean(), len(x)
    r = np.array([(d[: n - k] * d[k:]).sum() / (n - k) for k in range(nlags + 1)])
    out = [1.0]
    for k in range(1, nlags + 1):
        toeplitz = r[np.abs(np.subtract.outer(np.arange(k), np.arange(k)))]
        out.append(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    return out


def test_autocorrelations(df, frame):
    acf = to_pandas(ts.acf(df, "v"), ("station_id", "lag"))
    pacf = to_pandas(ts.pacf(df, "v"), ("station_id", "lag"))
    for station, one in frame.groupby("station_id"):
        x = one["v"].to_numpy()
        most = min(40, len(x) // 2 - 1)
        mine = acf[acf.station_id == station]["acf"].to_numpy()
        assert len(mine) == max(most + 1, 0)
        if most > 0:
            d = x - x.mean()
            want = [(d[: len(d) - k] * d[k:]).sum() / (d * d).sum() for k in range(most + 1)]
            np.testing.assert_allclose(mine, want, atol=1e-10)
            np.testing.assert_allclose(
                pacf[pacf.station_id == station]["pacf"], plain_pacf(x, most), atol=1e-9
            )


def test_constant_series_has_no_correlation(spark):
    frame = seasonal_series([50]).assign(v=3.0)
    assert to_pandas(ts.acf(to_spark(spark, frame), "v"), ("lag",))["acf"].isna().all()


def plain_decomposition(x, p):
    n, half = len(x), p // 2
    weights = np.repeat(1 / p, p) if p % 2 else np.array([0.5] + [1] * (p - 1) + [0.5]) / p
    trend = np.full(n, np.nan)
    trend[half : n - half] = np.convolve(x, weights, "valid")
    front, back = half, n - 1 - half
    for at, rows in (
        (slice(0, front), np.arange(front, min(front + p, back))),
        (slice(back + 1, n), np.arange(max(front, back - p), back)),
    ):
        line = np.polyfit(rows, trend[rows], 1)
        trend[at] = np.polyval(line, np.arange(n)[at])
    rest = x - trend
    means = np.array([rest[i::p].mean() for i in range(p)])
    return trend, np.tile(means - means.mean(), n // p + 1)[:n]


def test_decomposition(spark):
    frame = seasonal_series([1200, 60, 13, 300, 9000, 731, 1])
    got = to_pandas(decompose.seasonal_decompose(to_spark(spark, frame), "v"))
    np.testing.assert_allclose(got["observed"], got["trend"] + got["seasonal"] + got["resid"])
    for station, one in frame.groupby("station_id"):
        mine, x = got[got.station_id == station], one["v"].to_numpy()
        n = len(x)
        p = 365 if n >= 730 else max(7, min(n // 2 - 1, 30))
        assert set(mine["period"]) == {p}
        if n >= 2 * p:
            trend, seasonal = plain_decomposition(x, p)
            np.testing.assert_allclose(mine["trend"], trend, atol=1e-8)
            np.testing.assert_allclose(mine["seasonal"], seasonal, atol=1e-8)
        else:
            want = one["v"].rolling(p, center=True, min_periods=1).mean()
            np.testing.assert_allclose(mine["trend"], want)
            assert (mine["seasonal"] == 0).all()


def test_split_and_ranks(spark, df):
    sizes = ts.train_test_split(df, 30).groupBy("station_id").pivot("split").count().toPandas()
    sizes = sizes.fillna(0).set_index("station_id")
    assert sizes["train"].to_dict() == {1: 1170, 2: 30, 3: 10, 4: 0, 5: 19970}
    assert ts.last_n(df, 24).count() == 24 * 3 + 13 + 1
    newest = ts.last_n(df, 1).where("station_id = 1").first()["time"]
    assert newest == df.where("station_id = 1").agg(F.max("time")).first()[0]
    plan = ts.last_n(df, 24)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_append_matches_columns_by_name(spark):
    a = spark.createDataFrame([(1, 2.0)], "station_id long, v double")
    b = spark.createDataFrame([(3.0, 1)], "forecast double, station_id long")
    rows = ts.append(a, b).toPandas()
    assert list(rows.columns) == ["station_id", "v", "forecast"]
    assert pd.isna(rows["v"].iloc[1])


def test_a_lag_of_a_year_of_hours(spark):
    n = 10_000
    frame = pd.DataFrame(
        {"station_id": 1, "time": pd.date_range("2020-01-01", periods=n, freq="h"), "v": np.arange(n, dtype=float)}
    )
    got = to_pandas(ts.lag_features(to_spark(spark, frame), "v", lags=(1, 8760)))
    pd.testing.assert_series_equal(got["lag_8760"], frame["v"].shift(8760), check_names=False)


def test_quantiles_of_one_hot_group(spark):
    from isobar.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(4)
    hot = rng.normal(size=60_000) ** 3
    parts = {1: hot, 2: np.array([5.0]), 3: np.array([1.0, 2.0]), 4: np.repeat(3.0, 700), 5: np.arange(900.0)}
    frame = pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in parts.items()])
    df = spark.createDataFrame(frame).repartition(16)
    wanted = {"q01": 0.01, "q25": 0.25, "q50": 0.5, "q999": 0.999, "q1": 1.0}
    got = exact_quantiles(df, ["g"], "v", wanted).toPandas().set_index("g")
    for g, v in parts.items():
        np.testing.assert_allclose(got.loc[g], np.quantile(v, list(wanted.values())), rtol=1e-12)
