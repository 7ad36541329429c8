import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA, seasonal_series, to_pandas, to_spark
from isobar.operators import evaluate, report
from isobar.operators import timeseries as ts
from isobar.operators.forecast.lag_forest import forecast_lag_forest
from isobar.operators.forecast.lag_linear import forecast_lag_linear
from isobar.operators.forecast.seasonal_ar import forecast_seasonal_ar, order_search
from isobar.operators.forecast.simple import forecast_mean
from isobar.operators.forecast.trend_seasonal import forecast_trend_seasonal
from isobar.plans.catalog import QUERIES

LENGTHS = [1200, 60, 13, 1000]


@pytest.fixture(scope="module")
def frame():
    return seasonal_series(LENGTHS)


@pytest.fixture(scope="module")
def split(spark, frame):
    return ts.train_test_split(to_spark(spark, frame), 30).cache()


@pytest.fixture(scope="module")
def mean(split):
    return forecast_mean(split, 90, "v").cache()


def metrics(split, forecast, **options):
    test = split.where("split = 'test'")
    return evaluate.forecast_metrics(test, forecast, "v", **options)


def check_shape(forecast, stations, steps):
    assert (forecast["lower_ci"] <= forecast["forecast"]).all()
    assert (forecast["forecast"] <= forecast["upper_ci"]).all()
    assert forecast.groupby("station_id").size().to_dict() == dict.fromkeys(stations, steps)


def features(series):
    day = series["time"].dt.dayofyear
    out = {
        "month": series["time"].dt.month,
        "sin": np.sin(2 * np.pi * day / 365.25),
        "cos": np.cos(2 * np.pi * day / 365.25),
    }
    out |= {f"lag{k}": series["v"].shift(k) for k in ts.LAGS}
    out |= {f"mean{k}": series["v"].shift(1).rolling(k).mean() for k in ts.ROLLING}
    return pd.DataFrame(out).bfill().ffill().fillna(0.0)


def test_lag_linear_equals_a_plain_loop(split, frame):
    got = to_pandas(forecast_lag_linear(split, 40, "v"))
    check_shape(got, [1, 2, 3, 4], 40)
    for station, one in frame.groupby("station_id"):
        series = one[["time", "v"]].reset_index(drop=True)
        n = len(series)
        series = series[: n - 30 if n > 30 else int(n * 0.8)]
        x, y = features(series).to_numpy(), series["v"].to_numpy()
        w = np.linalg.lstsq(x - x.mean(0), y - y.mean(), rcond=1e-10)[0]
        spread = np.std(y - y.mean() - (x - x.mean(0)) @ w)
        path = []
        for _ in range(40):
            day = series["time"].iloc[-1] + pd.Timedelta(days=1)
            asked = pd.concat([series, pd.DataFrame({"time": [day], "v": [np.nan]})], ignore_index=True)
            path.append(y.mean() + (features(asked).iloc[-1].to_numpy() - x.mean(0)) @ w)
            asked.loc[len(asked) - 1, "v"] = path[-1]
            series = asked
        mine = got[got.station_id == station]
        np.testing.assert_allclose(mine["forecast"], path, atol=1e-3)
        np.testing.assert_allclose(mine["upper_ci"] - mine["forecast"], 1.96 * spread, atol=1e-6)


def test_horizon_covers_the_test_rows(split):
    got = to_pandas(forecast_lag_linear(split, 7, "v")).groupby("station_id").size().to_dict()
    assert got == {1: 30, 2: 30, 3: 7, 4: 30}


def test_trend_seasonal(split, frame, mean):
    table = forecast_trend_seasonal(split, 90, "v")
    rows = to_pandas(table).groupby("station_id").size().to_dict()
    assert rows == {1: 1260, 2: 120, 3: 100, 4: 1060}
    future = to_pandas(forecast_trend_seasonal(split, 90, "v", include_history=False))
    check_shape(future, [1, 2, 3, 4], 90)
    assert beats(split, table, mean) >= {1, 4}


def test_trend_seasonal_keeps_its_digits_at_high_levels(spark):
    low = seasonal_series([400])
    high = low.assign(v=low["v"] + 1e7)
    made = [
        to_pandas(forecast_trend_seasonal(ts.train_test_split(to_spark(spark, f)), 30, "v", include_history=False))
        for f in (low, high)
    ]
    np.testing.assert_allclose(made[1]["forecast"] - 1e7, made[0]["forecast"], atol=1e-6)
    np.testing.assert_allclose(
        made[1]["upper_ci"] - made[1]["forecast"], made[0]["upper_ci"] - made[0]["forecast"], rtol=1e-6
    )


def beats(split, table, mean):
    """Stations where a forecast has a smaller error than the mean."""
    mine = metrics(split, table).toPandas().set_index("station_id")["mae"]
    base = metrics(split, mean).toPandas().set_index("station_id")["mae"]
    return {s for s in mine.index if mine[s] < base[s]}


def test_seasonal_ar(split, mean):
    table = forecast_seasonal_ar(split, 90, "v", search=True)
    got = to_pandas(table)
    check_shape(got, [1, 2, 3, 4], 90)
    assert got.groupby("station_id")["model"].first().to_dict() == {
        1: "seasonal_ar", 2: "seasonal_ar_mean", 3: "seasonal_ar_mean", 4: "seasonal_ar",
    }
    widths = (got["upper_ci"] - got["lower_ci"]).to_numpy()[:90]
    assert (np.diff(widths) >= 0).all()
    assert beats(split, table, mean) >= {1, 4}
    fixed = to_pandas(forecast_seasonal_ar(split, 30, "v"))
    assert set(fixed["station_id"]) == {1, 2, 3, 4}
    plain = to_pandas(forecast_mean(split, 30, "v")).query("station_id == 3")
    short = fixed[fixed["station_id"] == 3]
    np.testing.assert_allclose(short["forecast"], plain["forecast"])
    np.testing.assert_allclose(short["upper_ci"], plain["upper_ci"])


def test_every_series_length_gets_a_forecast(spark):
    lengths = [5, 9, 10, 30, 36, 45, 60, 370, 400]
    parts = ts.train_test_split(to_spark(spark, seasonal_series(lengths)), 1)
    wanted = dict.fromkeys(range(1, len(lengths) + 1), 7)
    for search in (False, True):
        got = to_pandas(forecast_seasonal_ar(parts, 7, "v", search=search))
        assert got.groupby("station_id").size().to_dict() == wanted
    for model in (forecast_lag_linear, forecast_mean):
        assert to_pandas(model(parts, 7, "v")).groupby("station_id").size().to_dict() == wanted
    forest = to_pandas(forecast_lag_forest(parts, 7, "v", trees=5))
    assert forest.groupby("station_id").size().to_dict() == wanted
    assert order_search(parts, "v").select("station_id").distinct().count() == len(lengths)


def test_a_test_of_one_day_and_a_horizon_of_two(spark):
    parts = ts.train_test_split(to_spark(spark, seasonal_series([5])), 1)
    models = (forecast_lag_linear, forecast_seasonal_ar, forecast_mean)
    for model in models:
        assert len(to_pandas(model(parts, 2, "v"))) == 2
    assert len(to_pandas(forecast_trend_seasonal(parts, 2, "v", include_history=False))) == 2
    assert len(to_pandas(forecast_lag_forest(parts, 2, "v", trees=3))) == 2


def test_order_search_marks_one_best(split):
    orders = order_search(split, "v").toPandas()
    assert orders.groupby("station_id").size().to_dict() == {1: 16, 2: 1, 3: 1, 4: 16}
    assert orders[orders["best"]].groupby("station_id").size().to_dict() == {1: 1, 4: 1}
    for _, one in orders[orders["station_id"].isin([1, 4])].groupby("station_id"):
        assert one.loc[one["best"], "aicc"].iloc[0] == one["aicc"].min()


def test_forest(split, mean):
    table = forecast_lag_forest(split, 12, "v", trees=10).cache()
    got = to_pandas(table)
    check_shape(got[got.station_id != 3], [1, 2, 4], 30)
    assert got.groupby("station_id").size().to_dict() == {1: 30, 2: 30, 3: 12, 4: 30}
    assert beats(split, table, mean) >= {1, 4}


def test_mean_forecast_and_metrics(spark, frame, split, mean):
    got = to_pandas(mean)
    train = frame[frame.station_id == 1]["v"][:1170]
    one = got[got.station_id == 1].iloc[0]
    assert one["forecast"] == pytest.approx(train.mean())
    assert one["upper_ci"] - one["forecast"] == pytest.approx(2 * train.std())
    both = [metrics(split, mean, by_position=p).toPandas().set_index("station_id") for p in (0, 1)]
    pd.testing.assert_frame_equal(both[0].sort_index(), both[1].sort_index())
    test = frame[frame.station_id == 1]["v"][1170:]
    assert both[0].loc[1, "mae"] == pytest.approx((test - train.mean()).abs().mean())


def test_percentage_error_skips_zero_actuals(spark):
    rows = spark.createDataFrame([(0.0, 5.0), (2.0, 1.0)], "a double, f double")
    found = evaluate.error_metrics(F.col("a"), F.col("f"))
    assert rows.agg(found["mape"]).first()[0] == 50.0
    assert rows.where("a = 0").agg(found["mape"]).first()[0] == 0.0


def test_by_date_needs_every_test_date(spark, split, mean):
    short = mean.where("station_id <> 1 or day(time) <> 20")
    found = metrics(split, short).select("station_id").toPandas()["station_id"].tolist()
    assert sorted(found) == [2, 3, 4]


def test_comparison_and_history(split, frame, spark, mean):
    other = mean.withColumn("model", F.lit("off")).withColumn("forecast", F.col("forecast") + 99)
    table = metrics(split, mean.unionByName(other))
    best = evaluate.best_models(table).toPandas()
    assert set(best["best_mae"]) == {"mean"}
    compared = evaluate.compare_models(table).toPandas()
    assert compared["best_rmse"].sum() == 4
    joined = evaluate.history_plus_forecast(to_spark(spark, frame), mean, "v")
    sizes = joined.groupBy("station_id", "series").count().where("station_id = 1").toPandas()
    assert dict(zip(sizes["series"], sizes["count"], strict=True)) == {"history": 365, "forecast": 90}


def test_residual_interval(spark, mean):
    residuals = spark.createDataFrame([(1, 1.0), (1, 3.0)], "station_id long, residual double")
    plain = mean.where("station_id = 1").drop("lower_ci", "upper_ci")
    row = evaluate.residual_interval(plain, residuals).first()
    assert row["upper_ci"] - row["forecast"] == pytest.approx(1.96)


def test_report_keeps_nulls_without_data(spark, frame, mean):
    daily = to_spark(spark, frame).withColumnRenamed("v", "temperature_2m_mean")
    rows = report.climate_summary(daily, mean.where("station_id = 1")).toPandas().set_index("station_id")
    assert rows.loc[1, "trend"] == "Stable"
    assert rows.loc[1, "energy"] == "heating requirements"
    assert rows.loc[2, "trend"] is None
    assert rows["annual_precipitation"].isna().all()


@pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")
def test_all_models_are_compared_for_every_target(spark):
    rows = QUERIES["F10_compare_all_models"](spark, str(TESTDATA)).select("target", "by_position", "model").distinct().collect()
    models = {}
    for r in rows:
        models.setdefault((r.target, r.by_position), set()).add(r.model)
    assert len(models) == 6 and len(set(map(frozenset, models.values()))) == 1
    assert any("forest" in m for m in next(iter(models.values())))
    assert any(m.startswith("seasonal_ar_search") for m in next(iter(models.values())))
