import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor

from conftest import seasonal_series, to_pandas, to_spark
from isobar.operators.forecast import lag_forest
from isobar.operators.forecast.common import gram_blocks, moment_matrix
from isobar.operators.forecast.lag_linear import fit_lag_linear, forecast_lag_linear, run_lag_linear
from isobar.operators.forecast.seasonal_ar import fit_seasonal_ar, forecast_seasonal_ar, run_seasonal_ar
from isobar.operators.timeseries import lagged_products, train_test_split

FITS = [(fit_lag_linear, run_lag_linear, forecast_lag_linear), (fit_seasonal_ar, run_seasonal_ar, forecast_seasonal_ar)]


@pytest.mark.parametrize(("fit", "run", "forecast"), FITS)
def test_stored_models_run_like_fresh_ones(spark, tmp_path, fit, run, forecast):
    parts = train_test_split(to_spark(spark, seasonal_series([500, 420, 12])))
    fit(parts, "v").write.parquet(str(tmp_path / "models"))
    models = spark.read.parquet(str(tmp_path / "models"))
    assert models.count() == 3
    for days in (5, 40):  # thirty test days are covered in any case
        later = to_pandas(run(models, days), ("station_id", "time"))
        fresh = to_pandas(forecast(parts, days, "v"), ("station_id", "time"))
        pd.testing.assert_frame_equal(later, fresh)
        assert (later.groupby("station_id").size().loc[[1, 2]] == max(days, 30)).all()


def test_moment_blocks_merge_without_cancellation(spark):
    rng = np.random.default_rng(7)
    table = rng.normal(1e8, [1.0, 5.0, 0.1], (3000, 3))
    frame = pd.DataFrame(table, columns=list("abc")).assign(s=rng.integers(0, 3, 3000), t="x")
    frame.loc[5, "b"] = None
    got = gram_blocks(spark.createDataFrame(frame).repartition(7), list("abc"), ["s", "t"]).toPandas()
    assert len(got) == 3 and gram_blocks(spark.createDataFrame(frame).limit(0), list("abc"), ["s"]).count() == 0
    for row in got.itertuples():
        x = frame[(frame.s == row.s)].dropna()[list("abc")].to_numpy()
        assert row._3 == len(x)
        np.testing.assert_allclose(row._4, x.mean(axis=0), rtol=1e-14)
        np.testing.assert_allclose(moment_matrix(np.array([row._5]), 3)[0], np.cov(x.T, bias=True), rtol=1e-5, atol=1e-6)


def test_lagged_products_leave_context_out():
    x = np.random.default_rng(1).normal(size=50)
    whole = lagged_products(x, 0, 60)
    parts = lagged_products(x[:30], 0, 60)[:11] + lagged_products(x[20:], 10, 60)[:11]
    np.testing.assert_allclose(whole[:11], parts)
    np.testing.assert_allclose(whole[3], x[3:] @ x[:-3])
    assert (whole[50:] == 0).all()


def test_packed_trees_predict_like_the_forest(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame(rng.normal(size=(400, 3)), columns=list("abc"))
    frame["y"] = frame.a * 3 + (frame.b > 0) * 5 + rng.normal(size=400) * 0.1
    rows = VectorAssembler(inputCols=list("abc"), outputCol="x").transform(spark.createDataFrame(frame))
    model = RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=30, maxDepth=6, seed=1).fit(rows)
    groups = lag_forest._stored_nodes(spark, model, 30)
    assert len(groups) == 2
    packed = sum(g.value.total(frame[list("abc")].to_numpy(np.float32)) for g in groups) / 30
    told = model.transform(rows).select("a", "prediction").toPandas().set_index("a").loc[frame.a, "prediction"]
    close = np.isclose(packed, told.to_numpy(), atol=1e-4)
    assert close.mean() > 0.98  # a value right at a cut may fall on either side in single precision
    assert all(g.value.left.dtype == np.int32 and g.value.cut.dtype == np.float32 for g in groups)


def test_series_cut_into_blocks_fit_like_whole_ones(spark, monkeypatch):
    """a series may end within the days that the next block is led by, or just after them."""
    from isobar.operators.forecast import seasonal_ar, trend_seasonal

    first = (pd.Timestamp("1990-01-01") - pd.Timestamp("1970-01-01")).days
    to_border = 8192 - first % 8192
    lengths = [to_border - 3 + 30, to_border + 3 + 30, 700]
    parts = train_test_split(to_spark(spark, seasonal_series(lengths)))
    blocks = seasonal_ar.series_blocks(parts, "v").cache()
    tails = {r.station_id: r.tail for r in seasonal_ar._tails(blocks, ["station_id"]).collect()}
    for key, n in enumerate(lengths, start=1):
        last = parts.where(f"station_id = {key} AND split = 'train'").toPandas().sort_values("time").v.to_numpy()[-44:]
        np.testing.assert_array_equal(tails[key], last)
    for search in (False, True):
        given = to_pandas(forecast_seasonal_ar(parts, 30, "v", search=search, blocks=blocks), ("station_id", "time"))
        fresh = to_pandas(forecast_seasonal_ar(parts, 30, "v", search=search), ("station_id", "time"))
        pd.testing.assert_frame_equal(given, fresh)
    whole = to_pandas(trend_seasonal.forecast_trend_seasonal(parts, 30, "v"), ("station_id", "time"))
    monkeypatch.setattr(trend_seasonal, "BLOCK_DAYS", 100)
    cut = to_pandas(trend_seasonal.forecast_trend_seasonal(parts, 30, "v"), ("station_id", "time"))
    pd.testing.assert_frame_equal(whole, cut, rtol=1e-6)


def test_forest_rows_remember_their_nodes(spark, monkeypatch):
    """a level of a tree does not send every row down from the root again."""
    asked = {}

    class Stop(Exception):
        pass

    def regressor(**settings):
        asked.update(settings)
        raise Stop

    monkeypatch.setattr(lag_forest, "RandomForestRegressor", regressor)
    with pytest.raises(Stop):
        lag_forest.forecast_lag_forest(train_test_split(to_spark(spark, seasonal_series([60]))), 5, "v")
    assert asked["cacheNodeIds"] is True
