"""Plans whose memory and work must not outgrow the input."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA, seasonal_series, to_spark
from isobar.operators import clean, quantiles
from isobar.operators.series import neighbours
from isobar.plans import catalog

_LIMIT = "spark.sql.codegen.hugeMethodLimit"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_cell_is_ordered_one_way_only(spark):
    """F5 to F9, F11 to F15: looking ahead takes no second sort of the readings."""
    frame = seasonal_series([40]).rename(columns={"v": "temperature_2m"})
    plan = plan_of(neighbours(to_spark(spark, frame), ["station_id"], ["temperature_2m"], positions=["temperature_2m"]))
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "time#" in line]
    assert sorts and not any("DESC" in line for line in sorts)


def test_neighbours_in_gaps_and_at_edges(spark):
    values = [np.nan, 1.0, np.nan, np.nan, 4.0, np.nan]
    time = pd.to_datetime(["2024-01-30", "2024-01-31", "2024-02-01", "2024-02-02", "2024-03-05", "2024-03-06"])
    frame = pd.DataFrame({"station_id": 1, "time": time, "v": values})
    near = neighbours(to_spark(spark, frame), ["station_id"], ["v"], positions=["v"], next_time=True)
    rows = near.orderBy("time").select("_prev_v", "_next_v", "_prev_at_v", "_next_at_v").collect()
    assert [tuple(r) for r in rows] == [
        (None, 1.0, None, 2), (1.0, 1.0, 2, 2), (1.0, 4.0, 2, 5), (1.0, 4.0, 2, 5), (4.0, 4.0, 5, 5), (4.0, None, 5, None),
    ]


def test_fused_methods_stay_small_enough_to_compile(spark):
    """F5 to F9, F11 to F15: the JVM interprets methods above 8,000 bytes."""
    kept = spark.conf.get(_LIMIT)
    try:
        spark.conf.set(_LIMIT, "65535")
        clean.clean_hourly(catalog.weather(spark, str(TESTDATA)))
        assert spark.conf.get(_LIMIT) == "8000"
        spark.conf.set(_LIMIT, "9000")
        clean.clean_hourly(catalog.weather(spark, str(TESTDATA)))
        assert spark.conf.get(_LIMIT) == "9000"
    finally:
        spark.conf.set(_LIMIT, kept)


@pytest.mark.parametrize("group", [["g"], []])
def test_quantiles_count_without_sorting_all_values(spark, monkeypatch, group):
    """only hashed counts, no sort that holds every value with its ranges."""
    plans, stored = [], quantiles.stored
    monkeypatch.setattr(quantiles, "stored", lambda df, name: plans.append(plan_of(df)) or stored(df, name))
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("v"))
    row = quantiles.exact_quantiles(df, group, "v", {"half": 0.5}).first()
    assert row.half in ((999.0, 1000.0) if group else (999.5,))
    assert len(plans) == 2 and "SortAggregate" not in plans[1]


def test_buckets_grow_with_the_readings(spark, monkeypatch):
    """a task holds one bucket, so their number and not their size must grow."""
    monkeypatch.setattr(catalog, "BUCKET_LINES", 200)
    name = []
    table = spark.table
    monkeypatch.setattr(type(spark), "table", lambda self, n: name.append(n) or table(n))
    catalog.in_cells(spark, str(TESTDATA))
    lines = spark.read.parquet(str(TESTDATA / "lineitem.parquet")).count()
    facts = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name[0]}").collect()}
    assert int(facts["Num Buckets"]) == -(-lines // 200)


def test_history_plus_forecast_cleans_the_readings_once(spark, monkeypatch):
    """history and forecast come from one stored daily table."""
    calls, stored_days = [], catalog.stored_days
    monkeypatch.setattr(catalog, "stored_days", lambda *a: calls.append(1) or stored_days(*a))
    catalog.f_history(spark, str(TESTDATA))
    assert len(calls) == 1


def test_forest_statistics_of_four_tasks_fit_an_executor(spark, monkeypatch):
    """each running task holds the statistics of as many nodes as this setting allows."""
    from isobar.operators.forecast import lag_forest

    class Stop(Exception):
        pass

    asked = {}

    def regressor(**settings):
        asked.update(settings)
        raise Stop

    monkeypatch.setattr(lag_forest, "RandomForestRegressor", regressor)
    with pytest.raises(Stop):
        lag_forest.forecast_lag_forest(catalog.placed_split(spark, str(TESTDATA)))
    assert asked["maxMemoryInMB"] <= 256 and asked["numTrees"] == 100 and asked["maxDepth"] == 16


@pytest.mark.parametrize("name", ["A17_climate_summary", "F5_residual_interval"])
def test_reports_clean_the_readings_once(spark, monkeypatch, name):
    """history and forecast come from one stored table of the figures they use."""
    calls, days = [], catalog.days
    monkeypatch.setattr(catalog, "days", lambda *a: calls.append(1) or days(*a))
    catalog.QUERIES[name](spark, str(TESTDATA))
    assert len(calls) == 1


def test_stored_figures_leave_other_readings_unfilled(spark):
    """what no named figure comes from is not carried through the cells."""
    table = catalog.stored_days(spark, str(TESTDATA), catalog.MEAN_T)
    assert table.columns == [catalog.KEY, "time", catalog.MEAN_T]
    whole = catalog.stored_days(spark, str(TESTDATA)).select(*table.columns)
    assert table.count() > 0 and table.exceptAll(whole).isEmpty() and whole.exceptAll(table).isEmpty()
