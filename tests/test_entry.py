"""Registered queries against a second engine.

A cross-section runs by default; set ISOBAR_ALL_QUERIES to run every query.
"""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from conftest import TESTDATA

CROSS_SECTION = {
    "S1_read_hourly_payload",
    "S3_write_hourly",
    "S8_current_by_station",
    "P5_wmo_description",
    "C7_clean_hourly",
    "A3_hourly_to_daily",
    "A4_describe_stats",
    "A7_calendar_matrix",
    "A12_wind_rose",
    "W3_ml_feature_frame",
    "W5_seasonal_decompose",
    "W7_pacf",
    "F3_forecast_lag_linear",
    "F7_forecast_seasonal_ar_search",
    "F10_compare_models",
    "S3_stored_ranges",
    "T1_stream_daily",
    "T2_stream_fill",
    "A3_daily_from_cells",
    "A8_quartiles_from_sketches",
}
CHOSEN = set(entry.oracle_sql()) if os.environ.get("ISOBAR_ALL_QUERIES") else CROSS_SECTION

pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="needs the given tables")


@pytest.fixture(scope="module")
def other_engine():
    con = duckdb.connect()
    for file in TESTDATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def ordered(table):
    table = table[sorted(table.columns)].astype(object)
    return table.where(table.notna(), None).map(str).sort_values(sorted(table.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(CHOSEN))
def test_query_equals_sql(spark, other_engine, name):
    mine = entry.queries()[name](spark, str(TESTDATA)).toPandas()
    theirs = other_engine.execute(entry.oracle_sql()[name]).df()
    for column in mine:
        if pd.api.types.is_numeric_dtype(mine[column]) and not pd.api.types.is_bool_dtype(mine[column]):
            mine[column], theirs[column] = mine[column].astype(float), theirs[column].astype(float)
    pd.testing.assert_frame_equal(ordered(mine), ordered(theirs))


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
