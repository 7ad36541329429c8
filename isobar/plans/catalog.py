"""Every operator as a query over the given tables, with its SQL counterpart.

A query takes a session and a table folder and returns a lazy DataFrame.  Where
plain SQL can state the same result, the entry carries that SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixture
from ..functions import (
    calendar_parts,
    display_temperature,
    heat_index,
    is_daytime,
    seasonal_encoding,
    temperatures_to_fahrenheit,
    weather_category,
    wind_chill,
    wind_components,
    wmo_description,
)
from ..functions.comfort import feels_like_of
from ..functions.text import display_name
from ..operators import clean, climate, daily, decompose, evaluate, report, spatial, stats
from ..operators import timeseries as ts
from ..operators.forecast.lag_forest import forecast_lag_forest
from ..operators.forecast.lag_linear import forecast_lag_linear
from ..operators.forecast.seasonal_ar import DEFAULT_ORDER, forecast_seasonal_ar, order_search, series_blocks
from ..operators.forecast.simple import forecast_mean
from ..operators.forecast.trend_seasonal import forecast_trend_seasonal
from ..operators.quantiles import exact_quantiles, quantile_sketches
from ..schema import CAPPED_READINGS, variable_columns
from ..sources import payload, stations, tables
from ..storage import shared_folder
from ..streaming.gaps import STATE_STORE, stream_fill
from ..streaming.readings import stream_clean, stream_daily
from . import model_sql as M
from . import sql as S

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

KEY = "station_id"
MEAN_T = "temperature_2m_mean"
DAILY_FLOATS = (*S.DAILY_VARIABLES, "wind_direction_10m_dominant")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# -- inputs -------------------------------------------------------------------


def quantised(df: DataFrame, *columns: str) -> DataFrame:
    """Four decimals; the rounding border is moved off the decimals that occur."""

    def four(c: str) -> str:
        return f"floor(`{c}` * 10000D + 0.3819D) / 10000D AS `{c}`"

    return df.selectExpr(*[four(c) if c in columns else f"`{c}`" for c in df.columns])


def weather(spark: SparkSession, d: str) -> DataFrame:
    return fixture.weather_hourly(spark, d)


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean_hourly(weather(spark, d))


def days(spark: SparkSession, d: str) -> DataFrame:
    return daily.clean_daily(weather(spark, d))


def stored_days(spark: SparkSession, d: str, *figures: str) -> DataFrame:
    """Daily table, or the named figures of it, written to the shared folder first.

    For operators that go over it several times: it is a twenty-fourth of the
    readings, and cleaning them again for each pass would cost more.  Readings that
    no named figure comes from are neither filled nor aggregated.
    """
    path = fresh_path(spark, "daily")
    table = days(spark, d)
    (table.select(KEY, "time", *figures) if figures else table).write.parquet(path)
    return spark.read.parquet(path)


def stored_hours(spark: SparkSession, d: str) -> DataFrame:
    """Clean readings written to the shared folder first, for several passes over them."""
    path = fresh_path(spark, "hourly")
    hourly(spark, d).write.parquet(path)
    return spark.read.parquet(path)


def split(spark: SparkSession, d: str) -> DataFrame:
    return ts.train_test_split(target_series(spark, d))


def summary(spark: SparkSession, d: str) -> DataFrame:
    return spatial.station_summary(days(spark, d), fixture.stations(spark, d))


def coded(spark: SparkSession, d: str) -> DataFrame:
    """Hourly rows with a weather code from the whole range of codes, some unknown."""
    return weather(spark, d).withColumn(
        "weather_code", (F.col("wind_direction_10m").cast("int") + F.hour("time")) % 101
    )


CODED = S.W + """,
wc AS (SELECT *, CAST((CAST(wind_direction_10m AS INTEGER) + hour(time)) % 101 AS INTEGER)
              AS weather_code FROM w)"""


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for each run."""
    return f"{shared_folder(spark).rstrip('/')}/isobar-{name}-{uuid.uuid4().hex}"


# -- sources and sinks ---------------------------------------------------------


def archive_texts(spark: SparkSession, d: str) -> DataFrame:
    """Archive answers, one JSON text per station and day.

    Odd stations leave the elevation out; answers for the first of a month leave
    ``hourly`` out.
    """
    readings = ["time", *S.READINGS]
    rows = weather(spark, d).withColumn("time", F.col("time").cast("string"))
    per_day = rows.groupBy(KEY, F.substring("time", 1, 10).alias("day")).agg(
        F.sort_array(F.collect_list(F.struct(*readings))).alias("r")
    )
    block = F.struct(*[F.col(f"r.{c}").alias(c) for c in readings])
    answer = F.struct(
        KEY,
        (F.col(KEY) * 1.5).alias("latitude"),
        (F.col(KEY) * -2.5).alias("longitude"),
        F.when(F.col(KEY) % 2 == 0, F.lit(120.0)).alias("elevation"),
        F.when(F.substring("day", 9, 2) != "01", block).alias("hourly"),
    )
    return per_day.select(F.to_json(answer).alias("value"))


@query(
    "S1_read_hourly_payload",
    S.query(
        S.W,
        f"""SELECT station_id, time, {S.quantised(S.READINGS)},
        station_id * 1.5::DOUBLE AS latitude, station_id * -2.5::DOUBLE AS longitude,
        CASE WHEN station_id % 2 = 0 THEN 120.0::DOUBLE ELSE 0.0::DOUBLE END AS elevation
        FROM w WHERE day(time) <> 1""",
    ),
)
def read_hourly_payload(spark, d):
    rows = payload.hourly_rows(payload.parse_archive(archive_texts(spark, d)))
    kept = rows.select(KEY, "time", *S.READINGS, "latitude", "longitude", "elevation")
    return quantised(kept, *S.READINGS)


@query(
    "S2_read_hourly_csv",
    S.query(S.W, f"SELECT station_id, time, {S.quantised(S.READINGS)} FROM w"),
)
def read_hourly_csv(spark, d):
    path = fresh_path(spark, "hourly-csv")
    rows = weather(spark, d)
    rows.write.option("header", True).csv(path)
    return quantised(tables.read_hourly_csv(spark, path, rows.schema), *S.READINGS)


@query(
    "S3_write_hourly",
    S.query(
        S.W,
        f"""SELECT station_id, time, {S.quantised(S.READINGS)} FROM w
        WHERE station_id IN (0, 3) AND time >= TIMESTAMP '1996-03-01'
          AND time < TIMESTAMP '1998-02-16'""",
    ),
)
def write_hourly(spark, d):
    path = fresh_path(spark, "hourly")
    tables.write_hourly(weather(spark, d), path, buckets=4)
    stored = tables.read_hourly(spark, path, [0, 3], "1996-03-01", "1998-02-15", buckets=4)
    return quantised(stored, *S.READINGS)


_FETCHES = (
    (("1996-02-01", "1996-08-01"), ("1997-03-01", "1997-06-01")),
    (("1996-06-01", "1997-04-01"), ("1997-05-15", "1998-01-01"), ("1996-03-01", "1996-04-01")),
)
_GAPS = (*_FETCHES[0], ("1996-08-01", "1997-03-01"), ("1997-06-01", "1998-01-01"))


def fetched(spark: SparkSession, d: str) -> str:
    """A table filled by two requests that overlap, each writing only what was missing."""
    rows = stored(spark, weather(spark, d), "weather")
    path = fresh_path(spark, "ranges")
    for ranges in _FETCHES:
        listed = F.array(*[F.struct(F.lit(a).cast("timestamp_ntz").alias("start"), F.lit(b).cast("timestamp_ntz").alias("end")) for a, b in ranges])
        wanted = rows.select(KEY).distinct().select(KEY, F.inline(listed))
        tables.write_ranges(rows, wanted, path, buckets=4)
    return path


_IN_RANGE = "time >= TIMESTAMP '1996-02-01' AND time < TIMESTAMP '1998-01-01'"


@query("S3_reused_ranges", S.query(S.W, f"SELECT station_id, time, {S.quantised(S.READINGS)} FROM w WHERE {_IN_RANGE}"))
def reused_ranges(spark, d):
    return quantised(tables.read_hourly(spark, fetched(spark, d), buckets=4).select(KEY, "time", *S.READINGS), *S.READINGS)


@query(
    "S3_stored_ranges",
    S.query(
        S.W,
        "SELECT DISTINCT station_id, s AS start, e AS \"end\" FROM w, (VALUES "
        + ", ".join(f"(TIMESTAMP '{a}', TIMESTAMP '{b}')" for a, b in _GAPS)
        + ") v(s, e)",
    ),
)
def stored_ranges(spark, d):
    return tables.stored_ranges(spark, fetched(spark, d))


@query(
    "S4_date_range_scan",
    S.query(
        S.W,
        f"""SELECT station_id, time, {S.quantised(S.READINGS)} FROM w
        WHERE time >= TIMESTAMP '1997-01-01' AND time < TIMESTAMP '1998-01-01'""",
    ),
)
def date_range_scan(spark, d):
    path = fresh_path(spark, "hourly")
    tables.write_hourly(weather(spark, d), path, buckets=4)
    rows = tables.read_hourly(spark, path, start="1997-01-01", end="1997-12-31")
    return quantised(rows, *S.READINGS)


def realtime_texts(spark: SparkSession, d: str) -> DataFrame:
    """Real-time answers, one per station: newest reading, 24 hours and 7 days.

    Every seventh station answers without ``current``.
    """
    rows = coded(spark, d)
    newest = ts.last_n(rows, 24).withColumn("time", F.col("time").cast("string"))
    hours = newest.groupBy(KEY).agg(
        F.sort_array(
            F.collect_list(
                F.struct("time", "temperature_2m", "relative_humidity_2m", "weather_code")
            )
        ).alias("h")
    )
    week = ts.last_n(days(spark, d), 7).withColumn("time", F.substring(F.col("time").cast("string"), 1, 10))
    week = week.groupBy(KEY).agg(
        F.sort_array(
            F.collect_list(
                F.struct("time", "temperature_2m_max", "temperature_2m_min", "precipitation_sum")
            )
        ).alias("w")
    )
    latest = F.get("h", F.size("h") - 1)

    def arrays(source: str, *names: str) -> Column:
        return F.struct(*[F.col(f"{source}.{n}").alias(n) for n in names])

    answer = F.struct(
        KEY,
        F.when(
            F.col(KEY) % 7 != 6,
            F.struct(
                latest["time"].alias("time"),
                latest["temperature_2m"].alias("temperature_2m"),
                latest["weather_code"].alias("weather_code"),
                F.when(F.col(KEY) % 3 != 0, F.lit(0)).alias("is_day"),
            ),
        ).alias("current"),
        arrays("h", "time", "temperature_2m", "relative_humidity_2m", "weather_code").alias("hourly"),
        arrays("w", "time", "temperature_2m_max", "temperature_2m_min", "precipitation_sum").alias(
            "daily"
        ),
    )
    return hours.join(week, KEY).select(F.to_json(answer).alias("value"))


LATEST = CODED + """,
lh AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time DESC) AS r FROM wc)"""


@query(
    "S5_read_realtime_payload_hourly",
    S.query(
        LATEST,
        f"""SELECT station_id, time, {S.quantised(["temperature_2m", "relative_humidity_2m"])},
        weather_code FROM lh WHERE r <= 24""",
    ),
)
def read_realtime_hourly(spark, d):
    rows = payload.outlook_hourly_rows(payload.parse_realtime(realtime_texts(spark, d)))
    kept = rows.select(KEY, "time", "temperature_2m", "relative_humidity_2m", "weather_code")
    return quantised(kept, "temperature_2m", "relative_humidity_2m")


@query(
    "S5_read_realtime_payload_daily",
    S.query(
        S.D,
        f"""SELECT station_id, time,
        {S.quantised(["temperature_2m_max", "temperature_2m_min", "precipitation_sum"])}
        FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time DESC) AS r FROM d)
        WHERE r <= 7""",
    ),
)
def read_realtime_daily(spark, d):
    rows = payload.outlook_daily_rows(payload.parse_realtime(realtime_texts(spark, d)))
    figures = ["temperature_2m_max", "temperature_2m_min", "precipitation_sum"]
    return quantised(rows.select(KEY, "time", *figures), *figures)


@query(
    "S5_read_realtime_payload_current",
    S.query(
        LATEST,
        f"""SELECT station_id, time, {S.q("temperature_2m", "temperature_2m")}, weather_code,
        CASE WHEN station_id % 3 <> 0 THEN 0 END::INTEGER AS is_day
        FROM lh WHERE r = 1 AND station_id % 7 <> 6""",
    ),
)
def read_realtime_current(spark, d):
    rows = payload.current_rows(payload.parse_realtime(realtime_texts(spark, d)))
    kept = rows.select(KEY, "time", "temperature_2m", "weather_code", "is_day")
    return quantised(kept, "temperature_2m")


@query(
    "S6_write_daily_csv",
    S.query(S.D, f"SELECT station_id, time, {S.quantised(DAILY_FLOATS)} FROM d"),
)
def write_daily_csv(spark, d):
    path = fresh_path(spark, "daily-csv")
    table = days(spark, d)
    tables.write_daily_csv(table, path)
    back = spark.read.schema(table.schema).csv(path, header=True)
    return quantised(back, *DAILY_FLOATS)


@query(
    "S7_station_lookup",
    S.query(
        S.STATIONS,
        """SELECT query, station_id, name, latitude, longitude, elevation, country FROM (
          SELECT '  ' || lower(n_name) || ' ' AS query, st.station_id, st.country AS name,
                 latitude, longitude, coalesce(CASE WHEN st.station_id % 2 = 0 THEN elevation END, 0)
                 AS elevation, CASE WHEN st.station_id % 3 = 0 THEN 'Unknown' ELSE country END AS country,
                 row_number() OVER (PARTITION BY n_name ORDER BY st.station_id) AS r
          FROM nation JOIN st ON st.country = n_name) WHERE r = 1""",
    ),
)
def station_lookup(spark, d):
    named = fixture.stations(spark, d)
    table = named.select(
        KEY,
        F.col("country").alias("name"),
        "latitude",
        "longitude",
        F.when(F.col(KEY) % 2 == 0, F.col("elevation")).alias("elevation"),
        F.when(F.col(KEY) % 3 != 0, F.col("country")).alias("country"),
    )
    nations = fixture.table(spark, d, "nation")
    requests = nations.select(F.concat(F.lit("  "), F.lower("n_name"), F.lit(" ")).alias("query"))
    return stations.station_lookup(requests, table)


@query(
    "S8_current_by_station",
    S.query(
        LATEST + "," + S.STATIONS,
        f"""SELECT st.station_id, st.name,
        {S.q("CASE WHEN st.station_id % 5 = 4 THEN 24 ELSE temperature_2m END", "temp")},
        CASE WHEN st.station_id % 5 = 4 THEN 0 ELSE weather_code END AS weather_code,
        CASE WHEN st.station_id % 5 = 4 OR st.station_id % 3 = 0 THEN 1 ELSE 0 END::INTEGER AS is_day
        FROM st JOIN lh USING (station_id)
        WHERE r = 1 AND (st.station_id % 5 = 4 OR st.station_id % 7 <> 6)""",
    ),
)
def current_by_station(spark, d):
    answers = payload.parse_realtime(realtime_texts(spark, d)).where(F.col(KEY) % 5 != 4)
    rows = stations.current_by_station(fixture.stations(spark, d), answers)
    return quantised(rows, "temp")


# -- projections and scalar expressions ----------------------------------------


@query(
    "P1_heat_index",
    S.query(S.W, f"SELECT station_id, time, {S.q(S.HEAT_INDEX, 'heat_index')} FROM w"),
)
def p_heat_index(spark, d):
    value = heat_index(F.col("temperature_2m"), F.col("relative_humidity_2m"))
    return quantised(weather(spark, d).select(KEY, "time", value.alias("heat_index")), "heat_index")


@query(
    "P2_wind_chill",
    S.query(S.W, f"SELECT station_id, time, {S.q(S.WIND_CHILL, 'wind_chill')} FROM w"),
)
def p_wind_chill(spark, d):
    value = wind_chill(F.col("temperature_2m"), F.col("wind_speed_10m"))
    return quantised(weather(spark, d).select(KEY, "time", value.alias("wind_chill")), "wind_chill")


@query(
    "P3_feels_like",
    S.query(S.W, f"SELECT station_id, time, {S.q(S.FEELS_LIKE, 'feels_like')} FROM w"),
)
def p_feels_like(spark, d):
    rows = weather(spark, d)
    return quantised(rows.select(KEY, "time", feels_like_of(rows).alias("feels_like")), "feels_like")


@query(
    "P4_to_fahrenheit",
    S.query(
        S.D,
        "SELECT station_id, time, "
        + ", ".join(
            S.q(f"{c} * 9 / 5 + 32" if "temperature" in c or "feels" in c else c, c)
            for c in DAILY_FLOATS
        )
        + " FROM d",
    ),
)
def p_fahrenheit(spark, d):
    return quantised(temperatures_to_fahrenheit(days(spark, d)), *DAILY_FLOATS)


def _wmo_sql(default: str) -> str:
    from ..functions.wmo import WMO_TEXT

    cases = " ".join(f"WHEN {k} THEN '{v}'" for k, v in WMO_TEXT.items())
    return f"CASE weather_code {cases} ELSE '{default}' END"


def _category_sql() -> str:
    from ..functions.wmo import CATEGORY_CODES

    cases = " ".join(f"WHEN weather_code IN {codes} THEN '{n}'" for n, codes in CATEGORY_CODES.items())
    return f"CASE {cases} ELSE 'clear' END"


@query(
    "P5_wmo_description",
    S.query(
        CODED,
        f"""SELECT station_id, time, weather_code, {_wmo_sql("Unknown conditions")} AS description,
        {_wmo_sql("Clear")} AS card_text FROM wc""",
    ),
)
def p_wmo(spark, d):
    code = F.col("weather_code")
    return coded(spark, d).select(
        KEY,
        "time",
        code,
        wmo_description(code).alias("description"),
        wmo_description(code, "Clear").alias("card_text"),
    )


@query(
    "P6_weather_category",
    S.query(CODED, f"SELECT station_id, time, weather_code, {_category_sql()} AS category FROM wc"),
)
def p_category(spark, d):
    return coded(spark, d).select(
        KEY, "time", "weather_code", weather_category(F.col("weather_code")).alias("category")
    )


@query(
    "P7_is_daytime",
    S.query(
        S.W,
        """SELECT station_id, time,
        CASE WHEN hour(time) >= 6 AND hour(time) < 18 THEN 1 ELSE 0 END::INTEGER AS is_daytime FROM w""",
    ),
)
def p_daytime(spark, d):
    return weather(spark, d).select(KEY, "time", is_daytime(F.col("time")).alias("is_daytime"))


@query(
    "P8_wind_components",
    S.query(
        S.W,
        f"""SELECT station_id, time, {S.q("sin(radians(wind_direction_10m))", "wind_sin")},
        {S.q("cos(radians(wind_direction_10m))", "wind_cos")} FROM w""",
    ),
)
def p_wind(spark, d):
    sine, cosine = wind_components(F.col("wind_direction_10m"))
    rows = weather(spark, d).select(KEY, "time", sine.alias("wind_sin"), cosine.alias("wind_cos"))
    return quantised(rows, "wind_sin", "wind_cos")


@query(
    "P9_calendar_parts",
    S.query(
        S.W,
        """SELECT station_id, time, year(time)::INTEGER AS year, month(time)::INTEGER AS month,
        strftime(time, '%b') AS month_name, day(time)::INTEGER AS day,
        dayofyear(time)::INTEGER AS dayofyear FROM w""",
    ),
)
def p_calendar(spark, d):
    parts = calendar_parts(F.col("time"))
    return weather(spark, d).select(KEY, "time", *[c.alias(n) for n, c in parts.items()])


@query(
    "P10_seasonal_encoding",
    S.query(
        S.W,
        f"""SELECT station_id, time, {S.q("sin(2 * pi() * dayofyear(time) / 365.25)", "sin_dayofyear")},
        {S.q("cos(2 * pi() * dayofyear(time) / 365.25)", "cos_dayofyear")} FROM w""",
    ),
)
def p_encoding(spark, d):
    sine, cosine = seasonal_encoding(F.col("time"))
    rows = weather(spark, d).select(
        KEY, "time", sine.alias("sin_dayofyear"), cosine.alias("cos_dayofyear")
    )
    return quantised(rows, "sin_dayofyear", "cos_dayofyear")


@query(
    "P11_drop_null_rows",
    S.query(
        S.W,
        f"""SELECT station_id, time, {S.quantised(S.READINGS)} FROM w
        WHERE temperature_2m IS NOT NULL AND relative_humidity_2m IS NOT NULL""",
    ),
)
def p_dropna(spark, d):
    rows = weather(spark, d).dropna(subset=["temperature_2m", "relative_humidity_2m"])
    return quantised(rows, *S.READINGS)


@query(
    "P12_numeric_columns",
    S.query(
        S.D,
        f"""SELECT variable, count(value)::BIGINT AS known FROM
        (UNPIVOT (SELECT {", ".join(S.DAILY_VARIABLES)} FROM d) ON {", ".join(S.DAILY_VARIABLES)}
         INTO NAME variable VALUE value) GROUP BY variable""",
    ),
)
def p_numeric(spark, d):
    table = days(spark, d)
    long = stats.long_form(table, [KEY], variable_columns(table))
    return long.groupBy("variable").agg(F.count("value").alias("known"))


BOUNDARY_NAMES = {
    "NATION_0": " United States of America",
    "NATION_1": "Russian Federation ",
    "NATION_2": "United Kingdom",
}
_BOUNDARY_SQL = (
    "CASE n_name "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BOUNDARY_NAMES.items())
    + " ELSE upper(n_name) END"
)
_CLEAN_SQL = (
    "CASE lower(trim(name)) WHEN 'united states of america' THEN 'united states' "
    "WHEN 'russian federation' THEN 'russia' ELSE lower(trim(name)) END"
)


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Country outlines stand-in: nation names, three of them spelled as maps do."""
    n_name = F.col("n_name")
    name = F.upper(n_name)
    for known, shown in BOUNDARY_NAMES.items():
        name = F.when(n_name == known, F.lit(shown)).otherwise(name)
    return fixture.table(spark, d, "nation").select("n_nationkey", name.alias("name"))


@query(
    "P13_clean_country_name",
    f"SELECT n_nationkey, name, {_CLEAN_SQL} AS name_clean "
    f"FROM (SELECT n_nationkey, {_BOUNDARY_SQL} AS name FROM nation)",
)
def p_country(spark, d):
    clean_name = spatial.clean_country_name(F.col("name"), aliases=True)
    return boundaries(spark, d).withColumn("name_clean", clean_name)


@query(
    "X1_text_and_rounding",
    S.query(
        S.W,
        """SELECT station_id, time, round_even(temperature_2m, 0) AS shown,
        'Temperature 2m' AS label FROM w""",
    ),
)
def p_display(spark, d):
    shown = display_temperature(F.col("temperature_2m"))
    label = display_name(F.lit("temperature_2m"))
    return weather(spark, d).select(KEY, "time", shown.alias("shown"), label.alias("label"))


# -- cleaning -------------------------------------------------------------------


@query(
    "C1_parse_and_sort",
    S.query(S.W, f"SELECT station_id, time, {S.quantised(S.READINGS)} FROM w"),
)
def c_parse(spark, d):
    texts = weather(spark, d).withColumn("time", F.col("time").cast("string"))
    return quantised(ts.sort_by_time(clean.parse_time(texts)), *S.READINGS)


@query(
    "C2_interpolate_linear",
    S.query(S.I, f"SELECT station_id, time, {S.quantised(S.READINGS)} FROM i"),
)
def c_interpolate(spark, d):
    return quantised(clean.interpolate_linear(weather(spark, d)), *S.READINGS)


@query(
    "C3_fill_forward_backward",
    S.query(
        S.W + ",\n" + S.near("w", S.READINGS),
        "SELECT station_id, time, "
        + ", ".join(S.q(f"coalesce(p_{c}, n_{c})", c) for c in S.READINGS)
        + " FROM near",
    ),
)
def c_fill(spark, d):
    return quantised(clean.fill_forward_backward(weather(spark, d)), *S.READINGS)


@query(
    "C4_missing_report",
    S.query(
        S.W,
        "\nUNION ALL\n".join(
            f"SELECT station_id, '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS missing "
            "FROM w GROUP BY 1"
            for c in ("time", *S.READINGS)
        ),
    ),
)
def c_missing(spark, d):
    return clean.missing_report(weather(spark, d))


@query(
    "C5_cap_outliers",
    S.query(
        S.W + ",\n" + S.capped("w"), f"SELECT station_id, time, {S.quantised(S.READINGS)} FROM c"
    ),
)
def c_cap(spark, d):
    return quantised(clean.cap_outliers(weather(spark, d)), *S.READINGS)


@query(
    "C6_outlier_report",
    S.query(
        S.W + ",\n" + S.capped("w"),
        "\nUNION ALL\n".join(
            f"""SELECT station_id, '{c}' AS variable,
            count(*) FILTER (abs({c} - m_{c}) > 3 * s_{c}) AS outliers,
            {S.q(f"any_value(m_{c} - 3 * s_{c})", "lower_limit")},
            {S.q(f"any_value(m_{c} + 3 * s_{c})", "upper_limit")}
            FROM w JOIN b USING (station_id) GROUP BY station_id"""
            for c in S.CAPPED
        ),
    ),
)
def c_outliers(spark, d):
    return quantised(clean.outlier_report(weather(spark, d)), "lower_limit", "upper_limit")


_CLEAN_COLUMNS = (*S.READINGS, "feels_like")


@query(
    "C7_clean_hourly",
    S.query(S.H, f"SELECT station_id, time, {S.quantised(_CLEAN_COLUMNS)} FROM h"),
)
def c_clean(spark, d):
    return quantised(hourly(spark, d), *_CLEAN_COLUMNS)


#: Order lines to a bucket of cells, and so readings at most: what one task sorts.
BUCKET_LINES = 250_000


def in_cells(spark: SparkSession, d: str) -> DataFrame:
    """Raw readings as a table bucketed by station and month, in the shared folder.

    Buckets grow in number with the readings, not in size: a task holds one.
    """
    path = fresh_path(spark, "cells")
    name = f"cells_{uuid.uuid4().hex}"
    lines = fixture.table(spark, d, "lineitem").count()
    tables.store_cells(weather(spark, d), name, path, buckets=max(16, -(-lines // BUCKET_LINES)))
    return spark.table(name)


@query(
    "C7_clean_from_cells",
    S.query(S.H, f"SELECT station_id, time, {S.quantised(_CLEAN_COLUMNS)} FROM h"),
)
def c_cells(spark, d):
    """Cleaning of a table in cells."""
    return quantised(clean.clean_hourly(in_cells(spark, d), cell=tables.CELL), *_CLEAN_COLUMNS)


@query(
    "C8_regularize_daily",
    S.query(
        S.D
        + """,
cal AS (SELECT station_id, unnest(generate_series(min(time), max(time), INTERVAL 1 DAY)) AS time
        FROM d GROUP BY station_id)""",
        f"""SELECT cal.station_id, cal.time,
        {S.q("last_value(temperature_2m_mean IGNORE NULLS) OVER (PARTITION BY cal.station_id ORDER BY cal.time)", "temperature_2m_mean")}
        FROM cal LEFT JOIN d ON d.station_id = cal.station_id AND d.time = cal.time""",
    ),
)
def c_regular(spark, d):
    table = days(spark, d).select(KEY, "time", MEAN_T)
    return quantised(clean.regularize_daily(table), MEAN_T)


# -- aggregations ---------------------------------------------------------------


@query(
    "A1_aggregate_daily",
    S.query(S.D, f"SELECT station_id, time, {S.quantised(DAILY_FLOATS)} FROM d"),
)
def a_daily(spark, d):
    return quantised(daily.aggregate_daily(hourly(spark, d)), *DAILY_FLOATS)


@query(
    "A2_circular_mean_direction",
    S.query(
        S.W,
        f"""SELECT station_id, date_trunc('day', time)::TIMESTAMP AS time,
        {S.q(S.DIRECTION, "direction")} FROM w GROUP BY 1, 2""",
    ),
)
def a_direction(spark, d):
    from ..functions import circular_mean

    day = F.to_date("time").cast("timestamp_ntz").alias("time")
    mean = circular_mean(F.col("wind_direction_10m")).alias("direction")
    return quantised(weather(spark, d).groupBy(KEY, day).agg(mean), "direction")


@query(
    "A3_hourly_to_daily",
    S.query(S.D, f"SELECT station_id, time, {S.quantised(DAILY_FLOATS)} FROM d"),
)
def a_both(spark, d):
    _, by_day = daily.hourly_to_daily(weather(spark, d))
    return quantised(by_day, *DAILY_FLOATS)


@query(
    "A3_daily_from_cells",
    S.query(S.D, f"SELECT station_id, time, {S.quantised(DAILY_FLOATS)} FROM d"),
)
def a_cells(spark, d):
    """Days from a table in cells: no reading moves between tasks any more."""
    return quantised(daily.clean_daily(in_cells(spark, d), cell=tables.CELL), *DAILY_FLOATS)


_LONG = (
    S.D
    + f""",
lo AS (UNPIVOT (SELECT station_id, {", ".join(S.DAILY_VARIABLES)} FROM d)
       ON {", ".join(S.DAILY_VARIABLES)} INTO NAME variable VALUE value)"""
)
_DESCRIBE = ("mean", "std", "min", "q25", "q50", "q75", "max", "skewness", "kurtosis")


@query(
    "A4_describe_stats",
    S.query(
        _LONG,
        f"""SELECT station_id, variable, count(value)::BIGINT AS count, {S.q("avg(value)", "mean")},
        {S.q("stddev_samp(value)", "std")}, {S.q("min(value)", "min")},
        {S.q("quantile_cont(value, 0.25)", "q25")}, {S.q("quantile_cont(value, 0.5)", "q50")},
        {S.q("quantile_cont(value, 0.75)", "q75")}, {S.q("max(value)", "max")},
        {S.q("skewness(value)", "skewness")}, {S.q("kurtosis(value)", "kurtosis")}
        FROM lo GROUP BY 1, 2""",
    ),
)
def a_describe(spark, d):
    return quantised(stats.describe_stats(stored_days(spark, d)), *_DESCRIBE)


@query(
    "A4_describe_stats_hourly",
    S.query(
        S.H
        + f""",
lo AS (UNPIVOT (SELECT station_id, {", ".join(_CLEAN_COLUMNS)} FROM h)
       ON {", ".join(_CLEAN_COLUMNS)} INTO NAME variable VALUE value)""",
        f"""SELECT variable, count(value)::BIGINT AS count, {S.q("avg(value)", "mean")},
        {S.q("stddev_samp(value)", "std")}, {S.q("min(value)", "min")},
        {S.q("quantile_cont(value, 0.25)", "q25")}, {S.q("quantile_cont(value, 0.5)", "q50")},
        {S.q("quantile_cont(value, 0.75)", "q75")}, {S.q("max(value)", "max")},
        {S.q("skewness(value)", "skewness")}, {S.q("kurtosis(value)", "kurtosis")}
        FROM lo GROUP BY 1""",
    ),
)
def a_describe_hourly(spark, d):
    """All stations as one group of hourly values: the groups have no size bound."""
    rows = stored_hours(spark, d)
    table = stats.describe_stats(rows, keys=(), columns=list(_CLEAN_COLUMNS))
    return quantised(table, *_DESCRIBE)


@query(
    "A5_skew_kurtosis",
    S.query(
        _LONG,
        f"""SELECT station_id, variable, {S.q("skewness(value)", "skewness")},
        {S.q("kurtosis(value)", "kurtosis")} FROM lo GROUP BY 1, 2""",
    ),
)
def a_skew(spark, d):
    return quantised(stats.skew_kurtosis(days(spark, d)), "skewness", "kurtosis")


def _correlation_sql(lower: bool) -> str:
    names = S.DAILY_VARIABLES
    pairs = [
        (x, y) for i, x in enumerate(names) for j, y in enumerate(names) if not lower or j < i
    ]
    figures = ", ".join(
        f"CASE WHEN var_pop({x}) > 0 AND var_pop({y}) > 0 THEN corr({x}, {y}) END AS c{k}"
        for k, (x, y) in enumerate(pairs)
    )
    rows = "\nUNION ALL\n".join(
        f"SELECT station_id, '{x}' AS var_x, '{y}' AS var_y, {S.q(f'c{k}', 'corr')} FROM cm"
        for k, (x, y) in enumerate(pairs)
    )
    return S.query(S.D + f",\ncm AS (SELECT station_id, {figures} FROM d GROUP BY 1)", rows)


@query("A6_correlation_matrix", _correlation_sql(lower=False))
def a_correlation(spark, d):
    return quantised(stats.correlation_matrix(days(spark, d)), "corr")


@query("A6_correlation_lower_triangle", _correlation_sql(lower=True))
def a_correlation_lower(spark, d):
    return quantised(stats.correlation_matrix(days(spark, d), lower_triangle=True), "corr")


_DAY_COLUMNS = [f"day_{i}" for i in range(1, 32)]
_MONTHS_SQL = "strftime(make_date(2000, CAST(month AS INTEGER), 1), '%b')"


@query(
    "A7_calendar_matrix",
    S.query(
        S.D
        + """,
ms AS (SELECT station_id, CAST(m AS INTEGER) AS month
       FROM (SELECT DISTINCT station_id FROM d), generate_series(1, 12) AS s(m))""",
        f"SELECT ms.station_id, ms.month, any_value({_MONTHS_SQL}) AS month_name, "
        + ", ".join(
            S.q(f"avg({MEAN_T}) FILTER (day(time) = {i})", f"day_{i}") for i in range(1, 32)
        )
        + " FROM ms LEFT JOIN d ON d.station_id = ms.station_id AND month(d.time) = ms.month GROUP BY 1, 2",
    ),
)
def a_calendar(spark, d):
    return quantised(climate.calendar_matrix(days(spark, d)), *_DAY_COLUMNS)


@query(
    "A8_monthly_distribution",
    S.query(
        S.D,
        f"""SELECT station_id, month, {_MONTHS_SQL} AS month_name, count(v)::BIGINT AS count,
        {S.q("min(v)", "min")}, {S.q("quantile_cont(v, 0.25)", "q25")},
        {S.q("quantile_cont(v, 0.5)", "q50")}, {S.q("quantile_cont(v, 0.75)", "q75")},
        {S.q("max(v)", "max")}
        FROM (SELECT station_id, month(time)::INTEGER AS month, {MEAN_T} AS v FROM d) GROUP BY 1, 2""",
    ),
)
def a_monthly(spark, d):
    table = climate.monthly_distribution(stored_days(spark, d))
    return quantised(table, "min", "q25", "q50", "q75", "max")


@query(
    "A8_quartiles_from_sketches",
    S.query(
        S.H,
        f"""SELECT month(time)::INTEGER AS month, {S.q("quantile_cont(temperature_2m, 0.25)", "q25")},
        {S.q("quantile_cont(temperature_2m, 0.5)", "q50")},
        {S.q("quantile_cont(temperature_2m, 0.75)", "q75")} FROM h GROUP BY 1""",
    ),
)
def a_rolled(spark, d):
    """Sketches stored per station and month of each year, rolled up to calendar months."""
    rows = stored_hours(spark, d).withColumn("month", F.month("time"))
    cells = rows.withColumn("year", F.year("time"))
    path = fresh_path(spark, "sketches")
    quantile_sketches(cells, [KEY, "year", "month"], "temperature_2m").write.parquet(path)
    table = exact_quantiles(rows, ["month"], "temperature_2m", stats.QUARTILES, spark.read.parquet(path))
    return quantised(table, *stats.QUARTILES)


@query(
    "A8_monthly_histogram",
    S.query(
        S.D,
        f"""SELECT station_id, month, bin, {S.q("-10 + (bin - 1) * 2.5", "bin_start")}, n,
        {S.q("n / sum(n) OVER (PARTITION BY station_id, month)", "share")} FROM (
          SELECT station_id, month(time)::INTEGER AS month,
            (CASE WHEN {MEAN_T} < -10 THEN 0 WHEN {MEAN_T} >= 40 THEN 21
                  ELSE floor(({MEAN_T} + 10) / 50 * 20) + 1 END)::BIGINT AS bin,
            count(*)::BIGINT AS n
          FROM d WHERE {MEAN_T} IS NOT NULL GROUP BY 1, 2, 3)""",
    ),
)
def a_histogram(spark, d):
    table = climate.monthly_histogram(days(spark, d), -10, 40, 20)
    return quantised(table, "bin_start", "share")


@query(
    "A9_yearly_sum",
    S.query(
        S.D,
        f"""SELECT station_id, year(time)::INTEGER AS year,
        {S.q("coalesce(sum(precipitation_sum), 0)", "precipitation_sum")} FROM d GROUP BY 1, 2""",
    ),
)
def a_yearly(spark, d):
    return quantised(climate.yearly_sum(days(spark, d)), "precipitation_sum")


@query(
    "A10_monthly_mean",
    S.query(
        S.D,
        f"""SELECT station_id, month, {_MONTHS_SQL} AS month_name,
        {S.q("avg(precipitation_sum)", "precipitation_sum")}
        FROM (SELECT *, month(time)::INTEGER AS month FROM d) GROUP BY 1, 2""",
    ),
)
def a_monthly_mean(spark, d):
    return quantised(climate.monthly_mean(days(spark, d)), "precipitation_sum")


@query(
    "A11_linear_fit",
    S.query(
        S.D,
        f"""SELECT station_id, {S.q("regr_slope(y, x)", "slope")},
        {S.q("regr_intercept(y, x)", "intercept")}, {S.q("regr_r2(y, x)", "r2")},
        regr_count(y, x)::BIGINT AS n
        FROM (SELECT station_id, relative_humidity_2m_mean AS x, feels_like_mean AS y FROM d) GROUP BY 1""",
    ),
)
def a_fit(spark, d):
    table = stats.linear_fit(days(spark, d), "relative_humidity_2m_mean", "feels_like_mean")
    return quantised(table, "slope", "intercept", "r2")


def _rose_sql(ctes: str, source: str, speed: str, direction: str) -> str:
    from ..operators.climate import SECTORS, SPEED_CLASSES

    sectors = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SECTORS))
    speeds = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(SPEED_CLASSES))
    return S.query(
        ctes
        + f""",
kn AS (SELECT station_id, CAST(floor(fmod({direction}, 360) / 45) AS INTEGER) % 8 AS sector,
              CASE WHEN {speed} < 0 THEN NULL WHEN {speed} < 5 THEN 0 WHEN {speed} < 10 THEN 1
                   WHEN {speed} < 20 THEN 2 ELSE 3 END::INTEGER AS speed_class
       FROM {source} WHERE {speed} IS NOT NULL AND {direction} IS NOT NULL),
tt AS (SELECT station_id, count(*) AS total FROM kn GROUP BY 1),
gr AS (SELECT station_id, total, CAST(s AS INTEGER) AS sector, CAST(k AS INTEGER) AS speed_class
       FROM tt, generate_series(0, 7) AS a(s), generate_series(0, 3) AS b(k))""",
        f"""SELECT gr.station_id, gr.sector, CASE gr.sector {sectors} END AS sector_name,
        gr.speed_class, CASE gr.speed_class {speeds} END AS speed_label,
        count(kn.station_id)::BIGINT AS n,
        {S.q("count(kn.station_id) / any_value(total)::DOUBLE * 100", "percent")}
        FROM gr LEFT JOIN kn USING (station_id, sector, speed_class) GROUP BY 1, 2, 3, 4, 5""",
    )


# Rounded first: a direction on a sector border must fall alike in both engines.
_ROSE_DAILY = S.D + """,
rd AS (SELECT station_id, wind_speed_10m_mean AS speed,
              fmod(round(wind_direction_10m_dominant, 6), 360) AS direction FROM d)"""


@query("A12_wind_rose", _rose_sql(_ROSE_DAILY, "rd", "speed", "direction"))
def a_rose(spark, d):
    rounded = F.round("wind_direction_10m_dominant", 6)
    table = days(spark, d).withColumn("wind_direction_10m_dominant", rounded)
    return quantised(climate.wind_rose(table), "percent")


@query("A12_wind_rose_hourly", _rose_sql(S.W, "w", "wind_speed_10m", "wind_direction_10m"))
def a_rose_hourly(spark, d):
    return quantised(climate.wind_rose(weather(spark, d)), "percent")


_KPIS = (
    "avg_temperature",
    "max_temperature",
    "min_temperature",
    "total_precipitation",
    "avg_wind_speed",
)


@query(
    "A13_kpis",
    S.query(
        S.D,
        f"""SELECT station_id, {S.q("avg(temperature_2m_mean)", "avg_temperature")},
        {S.q("max(temperature_2m_max)", "max_temperature")},
        {S.q("min(temperature_2m_min)", "min_temperature")},
        {S.q("sum(precipitation_sum)", "total_precipitation")},
        {S.q("avg(wind_speed_10m_mean)", "avg_wind_speed")} FROM d GROUP BY 1""",
    ),
)
def a_kpis(spark, d):
    return quantised(climate.kpis(days(spark, d)), *_KPIS)


@query(
    "A14_station_summary",
    S.query(
        S.SUMMARY,
        f"""SELECT station_id, name, latitude, longitude, country,
        {S.quantised(["temperature_2m_mean", "precipitation_sum"])} FROM sm""",
    ),
)
def a_summary(spark, d):
    return quantised(summary(spark, d), MEAN_T, "precipitation_sum")


@query(
    "A15_country_average",
    S.query(
        S.SUMMARY,
        f"SELECT country, {S.q(f'avg({MEAN_T})', MEAN_T)} FROM sm GROUP BY country",
    ),
)
def a_country(spark, d):
    return quantised(spatial.country_average(summary(spark, d)), MEAN_T)


@query(
    "A16_heat_weights",
    S.query(
        S.SUMMARY,
        f"""SELECT latitude, longitude, {S.q(
            f'({MEAN_T} - lo) / (CASE WHEN hi = lo THEN 1 ELSE hi - lo END)', 'weight'
        )} FROM sm, (SELECT min({MEAN_T}) AS lo, max({MEAN_T}) AS hi FROM sm)""",
    ),
)
def a_heat(spark, d):
    return quantised(spatial.heat_weights(summary(spark, d)), "weight")


_REPORT = ("mean_temperature", "max_temperature", "min_temperature", "annual_precipitation")


@query(
    "A17_climate_summary",
    S.query(
        S.MEAN_FORECAST
        + """,
hs AS (SELECT station_id, avg(temperature_2m_mean) AS mean_temperature,
              max(temperature_2m_mean) AS max_temperature, min(temperature_2m_mean) AS min_temperature,
              avg(precipitation_sum) * 365.25 AS annual_precipitation FROM d GROUP BY 1),
fs AS (SELECT station_id, arg_min(f, time) AS forecast_start, arg_max(f, time) AS forecast_end,
              count(*) AS forecast_days
       FROM (SELECT *, forecast + day(time) - 15 AS f FROM mf) GROUP BY 1)""",
        f"""SELECT station_id, {S.quantised(_REPORT)},
        {S.quantised(["forecast_start", "forecast_end"])}, forecast_days::BIGINT AS forecast_days,
        CASE WHEN forecast_end > forecast_start THEN 'Warm-up'
             WHEN forecast_end < forecast_start THEN 'Cool-down' ELSE 'Stable' END AS trend,
        CASE WHEN forecast_end > 25 THEN 'increased cooling loads'
             WHEN forecast_end < 15 THEN 'heating requirements'
             ELSE 'moderate base energy demands' END AS energy
        FROM hs JOIN fs USING (station_id)""",
    ),
)
def a_report(spark, d):
    series = stored_days(spark, d, MEAN_T, "precipitation_sum")
    ahead = forecast_mean(ts.train_test_split(series.select(KEY, "time", MEAN_T))).withColumn(
        "forecast", F.col("forecast") + F.day("time") - 15
    )
    table = report.climate_summary(series, ahead)
    return quantised(table, *_REPORT, "forecast_start", "forecast_end")


@query(
    "A18_regional_grid",
    S.query(
        S.SUMMARY
        + f""",
kn AS (SELECT latitude, longitude, {MEAN_T} AS value FROM sm),
fr AS (SELECT min(latitude) AS y0, max(latitude) AS y1, min(longitude) AS x0, max(longitude) AS x1,
              min(value) AS lo, max(value) AS hi FROM kn),
gr AS (SELECT y.i AS row, x.i AS col, y0 + (y1 - y0) * y.i / 23 AS latitude, x0 + (x1 - x0) * x.i / 23 AS longitude
       FROM fr, generate_series(0, 23) AS y(i), generate_series(0, 23) AS x(i)),
ds AS (SELECT row, col, gr.latitude, gr.longitude, value,
              (gr.latitude - kn.latitude) ** 2 + (gr.longitude - kn.longitude) ** 2 AS d2 FROM gr, kn),
ce AS (SELECT row, col, latitude, longitude, count(*) AS points,
              coalesce(avg(CASE WHEN d2 = 0 THEN value END),
                       sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) AS value FROM ds GROUP BY ALL)""",
        f"""SELECT row, col, latitude, longitude, {S.q("value", "value")},
        CAST(CASE WHEN hi = lo THEN 1 ELSE greatest(least(floor((value - lo) / (hi - lo) * 14) + 1, 14), 1) END AS INTEGER) AS level
        FROM ce, fr WHERE points >= 4""",
    ),
)
def a_grid(spark, d):
    return quantised(spatial.regional_grid(summary(spark, d)), "value")


@query(
    "A18_nearest_grid",
    S.query(
        S.SUMMARY
        + f""",
kn AS (SELECT latitude, longitude, {MEAN_T} AS value FROM sm),
fr AS (SELECT min(latitude) AS y0, max(latitude) AS y1, min(longitude) AS x0, max(longitude) AS x1,
              min(value) AS lo, max(value) AS hi FROM kn),
gr AS (SELECT y.i AS row, x.i AS col, y0 + (y1 - y0) * y.i / 23 AS latitude, x0 + (x1 - x0) * x.i / 23 AS longitude
       FROM fr, generate_series(0, 23) AS y(i), generate_series(0, 23) AS x(i)),
ds AS (SELECT row, col, gr.latitude, gr.longitude, value,
              (gr.latitude - kn.latitude) ** 2 + (gr.longitude - kn.longitude) ** 2 AS d2 FROM gr, kn
       QUALIFY row_number() OVER (PARTITION BY row, col ORDER BY d2, kn.latitude, kn.longitude, value) <= 4),
ce AS (SELECT row, col, latitude, longitude, count(*) AS points,
              coalesce(avg(CASE WHEN d2 = 0 THEN value END),
                       sum(value / nullif(d2, 0)) / sum(1 / nullif(d2, 0))) AS value FROM ds GROUP BY ALL)""",
        f"""SELECT row, col, latitude, longitude, {S.q("value", "value")},
        CAST(CASE WHEN hi = lo THEN 1 ELSE greatest(least(floor((value - lo) / (hi - lo) * 14) + 1, 14), 1) END AS INTEGER) AS level
        FROM ce, fr WHERE points >= 4""",
    ),
)
def a_near_grid(spark, d):
    return quantised(spatial.regional_grid(summary(spark, d), nearest=4), "value")


# -- windows and time series ----------------------------------------------------

_OVER = "OVER (PARTITION BY station_id ORDER BY time"


def _lag_sql(k: int) -> str:
    return f"lag({MEAN_T}, {k}) {_OVER})"


def _rolling_sql(k: int) -> str:
    frame = f"{_OVER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({MEAN_T}) {frame} = {k} THEN avg({MEAN_T}) {frame} END"


_LAG_NAMES = [f"lag_{k}" for k in ts.LAGS]
_ROLL_NAMES = [f"rolling_mean_{k}" for k in ts.ROLLING]


def target_series(spark: SparkSession, d: str) -> DataFrame:
    return stored_days(spark, d, MEAN_T)


@query(
    "W1_lag_features",
    S.query(
        S.D,
        "SELECT station_id, time, "
        + ", ".join(S.q(_lag_sql(k), f"lag_{k}") for k in ts.LAGS)
        + " FROM d",
    ),
)
def w_lags(spark, d):
    return quantised(ts.lag_features(target_series(spark, d)).drop(MEAN_T), *_LAG_NAMES)


@query(
    "W2_rolling_mean_features",
    S.query(
        S.D,
        "SELECT station_id, time, "
        + ", ".join(S.q(_rolling_sql(k), f"rolling_mean_{k}") for k in ts.ROLLING)
        + " FROM d",
    ),
)
def w_rolling(spark, d):
    return quantised(ts.rolling_mean_features(target_series(spark, d)).drop(MEAN_T), *_ROLL_NAMES)


_FRAMED = {
    **{f"lag_{k}": _lag_sql(k) for k in ts.LAGS},
    **{f"rolling_mean_{k}": _rolling_sql(k) for k in ts.ROLLING},
}


@query(
    "W3_ml_feature_frame",
    S.query(
        S.D
        + ",\nff AS (SELECT station_id, time, "
        + f"{MEAN_T}, "
        + ", ".join(f"{e} AS {n}" for n, e in _FRAMED.items())
        + " FROM d)",
        f"""SELECT station_id, time, {S.q(MEAN_T, MEAN_T)}, month(time)::DOUBLE AS month,
        {S.q("sin(2 * pi() * dayofyear(time) / 365.25)", "sin_dayofyear")},
        {S.q("cos(2 * pi() * dayofyear(time) / 365.25)", "cos_dayofyear")}, """
        + ", ".join(
            S.q(
                f"coalesce({n}, first_value({n} IGNORE NULLS) {_OVER} ROWS BETWEEN CURRENT ROW AND "
                "UNBOUNDED FOLLOWING), 0)",
                n,
            )
            for n in _FRAMED
        )
        + " FROM ff",
    ),
)
def w_features(spark, d):
    table = ts.ml_feature_frame(target_series(spark, d))
    return quantised(table, MEAN_T, "sin_dayofyear", "cos_dayofyear", *_FRAMED)


@query(
    "W4_centered_rolling_mean",
    S.query(
        S.D,
        f"""SELECT station_id, time,
        {S.q(f"avg({MEAN_T}) {_OVER} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)", "centered_7")},
        {S.q(f"avg({MEAN_T}) {_OVER} ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING)", "centered_30")}
        FROM d""",
    ),
)
def w_centered(spark, d):
    weekly = ts.centered_rolling_mean(target_series(spark, d), 7, name="centered_7")
    both = ts.centered_rolling_mean(weekly, 30, name="centered_30")
    return quantised(both.drop(MEAN_T), "centered_7", "centered_30")


@query(
    "W5_seasonal_decompose",
    S.query(
        M.DECOMPOSE, f"SELECT station_id, time, {S.quantised(['observed', 'trend', 'seasonal', 'resid'])}, period FROM de"
    ),
)
def w_decompose(spark, d):
    table = decompose.seasonal_decompose(target_series(spark, d))
    return quantised(table, "observed", "trend", "seasonal", "resid")


@query(
    "W6_acf",
    S.query(
        S.D
        + f""",
dv AS (SELECT station_id, time, {MEAN_T} - avg({MEAN_T}) OVER (PARTITION BY station_id) AS x,
              count(*) OVER (PARTITION BY station_id) AS n FROM d),
pr AS (SELECT station_id, n, x, """
        + ", ".join(f"x * lag(x, {k}) {_OVER}) AS p{k}" for k in range(1, 41))
        + " FROM dv),\nsm AS (SELECT station_id, any_value(n) AS n, sum(x * x) AS s0, "
        + ", ".join(f"sum(p{k}) AS s{k}" for k in range(1, 41))
        + " FROM pr GROUP BY 1)",
        "SELECT station_id, lag, "
        + S.q("s / nullif(s0, 0)", "acf")
        + " FROM ("
        + "\nUNION ALL\n".join(
            f"SELECT station_id, n, s0, {k}::INTEGER AS lag, s{k} AS s FROM sm" for k in range(41)
        )
        + ") WHERE lag <= least(40, n // 2 - 1)",
    ),
)
def w_acf(spark, d):
    return quantised(ts.acf(target_series(spark, d)), "acf")


@query(
    "W7_pacf",
    M.query(M.PACF, f"SELECT station_id, CAST(lag AS INTEGER) AS lag, {S.q('pacf', 'pacf')} FROM dl WHERE lag <= least(40, n // 2 - 1)"),
)
def w_pacf(spark, d):
    return quantised(ts.pacf(target_series(spark, d)), "pacf")


@query(
    "W8_train_test_split",
    S.query(S.SPLIT, f"SELECT station_id, time, {S.q(MEAN_T, MEAN_T)}, split FROM sp"),
)
def w_split(spark, d):
    return quantised(split(spark, d), MEAN_T)


def _rank_sql(n: int, direction: str) -> str:
    return S.query(
        S.D,
        f"""SELECT station_id, time, {S.q(MEAN_T, MEAN_T)} FROM (
        SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time {direction}) AS r FROM d)
        WHERE r <= {n}""",
    )


@query("W9_last_n", _rank_sql(365, "DESC"))
def w_last(spark, d):
    return quantised(ts.last_n(target_series(spark, d), 365), MEAN_T)


@query("W9_first_n", _rank_sql(24, "ASC"))
def w_first(spark, d):
    return quantised(ts.first_n(target_series(spark, d), 24), MEAN_T)


# -- forecasting and evaluation -------------------------------------------------

_BAND = ("forecast", "lower_ci", "upper_ci")
_METRICS = evaluate.METRICS


def two_forecasts(parts: DataFrame) -> DataFrame:
    """Mean forecast, and the last training value kept level, as input to compare."""
    mean = forecast_mean(parts)
    last = parts.where(F.col("split") == "train").groupBy(KEY).agg(
        F.max_by(MEAN_T, "time").alias("_level")
    )
    level = mean.join(last, KEY).select(
        KEY,
        F.lit("last_value").alias("model"),
        "time",
        *[F.col("_level").alias(c) for c in _BAND],
    )
    return mean.unionByName(level)


def test_part(parts: DataFrame) -> DataFrame:
    return parts.where(F.col("split") == "test")


@query(
    "F1_forecast_metrics",
    S.query(S.LEVEL_FORECAST, f"SELECT station_id, model, {S.quantised(_METRICS)} FROM me"),
)
def f_metrics(spark, d):
    parts = split(spark, d)
    table = evaluate.forecast_metrics(
        test_part(parts), two_forecasts(parts), MEAN_T, by_position=True
    )
    return quantised(table, *_METRICS)


@query(
    "F2_align_by_date",
    S.query(
        S.LEVEL_FORECAST,
        f"SELECT station_id, model, time, {S.quantised(['actual', 'forecast'])} FROM ad",
    ),
)
def f_align_date(spark, d):
    parts = split(spark, d)
    pairs = evaluate.align_by_date(test_part(parts), two_forecasts(parts), MEAN_T)
    return quantised(pairs, "actual", "forecast")


@query(
    "F2_align_by_position",
    S.query(
        S.LEVEL_FORECAST,
        f"SELECT station_id, model, {S.quantised(['actual', 'forecast'])} FROM ap",
    ),
)
def f_align_position(spark, d):
    parts = split(spark, d)
    pairs = evaluate.align_by_position(test_part(parts), two_forecasts(parts), MEAN_T)
    return quantised(pairs.drop("time"), "actual", "forecast")


_FIXED_AR = f"{M.ar_fits('ar', False, [DEFAULT_ORDER])},{M.ar_run('ar', False, 'seasonal_ar')}"
_SEARCHED_AR = f"{M.ar_fits('sa', True, M.ORDERS)},{M.ar_run('sa', True, 'seasonal_ar')}"


def model_sql(ctes: str, name: str) -> str:
    """The forecasts of one model for the mean temperature."""
    return M.query(
        f"{M.series([MEAN_T])},{ctes}", f"SELECT station_id, model, time, {S.quantised(_BAND)} FROM {name}"
    )


@query("F3_forecast_lag_linear", model_sql(M.lag_linear(), "ll"))
def f_linear(spark, d):
    return quantised(forecast_lag_linear(split(spark, d)), *_BAND)


def placed_split(spark: SparkSession, d: str) -> DataFrame:
    """The split with each station's place, which the pooled forest has as features."""
    places = fixture.stations(spark, d).select(KEY, "latitude", "longitude", "elevation")
    return split(spark, d).join(places, KEY)


@query("F4_forecast_lag_forest")
def f_forest(spark, d):
    return quantised(forecast_lag_forest(placed_split(spark, d)), *_BAND)


_COVERAGE = S.query(
    S.MEAN_FORECAST,
    """SELECT station_id, count(*) AS days, min(time) AS first_day, max(time) AS last_day,
    true AS band_in_order FROM mf GROUP BY 1""",
)


def coverage(forecast: DataFrame) -> DataFrame:
    """What holds for any model: a row for each station and day ahead, inside its band."""
    inside = (F.col("lower_ci") <= F.col("forecast")) & (F.col("forecast") <= F.col("upper_ci"))
    return forecast.groupBy(KEY).agg(
        F.count("*").alias("days"),
        F.min("time").alias("first_day"),
        F.max("time").alias("last_day"),
        F.bool_and(inside).alias("band_in_order"),
    )


@query("F3_lag_linear_coverage", _COVERAGE)
def f_linear_coverage(spark, d):
    return coverage(forecast_lag_linear(split(spark, d)))


@query("F4_lag_forest_coverage", _COVERAGE)
def f_forest_coverage(spark, d):
    return coverage(forecast_lag_forest(placed_split(spark, d)))


@query("F6_trend_seasonal_coverage", _COVERAGE)
def f_trend_coverage(spark, d):
    return coverage(forecast_trend_seasonal(split(spark, d), include_history=False))


@query("F7_seasonal_ar_coverage", _COVERAGE)
def f_seasonal_coverage(spark, d):
    return coverage(forecast_seasonal_ar(split(spark, d)))


@query("F7_seasonal_ar_search_coverage", _COVERAGE)
def f_search_coverage(spark, d):
    return coverage(forecast_seasonal_ar(split(spark, d), search=True))


TARGETS = (MEAN_T, "surface_pressure_mean", "wind_speed_10m_mean")
SERIES = (KEY, "target")


def every_target(spark: SparkSession, d: str) -> DataFrame:
    """Train and test rows of several daily figures, one series per station and figure.

    With the figure as part of the key, each model fits all of them in one job.
    """
    long = stored_days(spark, d, *TARGETS).unpivot([KEY, "time"], list(TARGETS), "target", "value")
    return ts.train_test_split(long, keys=SERIES)


def fitted_models(parts: DataFrame) -> DataFrame:
    """Forecasts of every model that least squares fit."""
    blocks = stored(parts.sparkSession, series_blocks(parts, "value", SERIES), "blocks")
    searched = forecast_seasonal_ar(parts, 90, "value", SERIES, search=True, blocks=blocks)
    made = [
        forecast_mean(parts, 90, "value", SERIES),
        forecast_lag_linear(parts, 90, "value", SERIES),
        forecast_trend_seasonal(parts, 90, "value", SERIES, include_history=False),
        forecast_seasonal_ar(parts, 90, "value", SERIES, blocks=blocks),
        searched.withColumn("model", F.regexp_replace("model", "^seasonal_ar", "seasonal_ar_search")),
    ]
    return ts.append(*made)


def compared(parts: DataFrame, ahead: DataFrame) -> DataFrame:
    """Errors of all models by date and by position, the best of each marked."""
    both = []
    for by_position in (False, True):
        metrics = evaluate.forecast_metrics(test_part(parts), ahead, "value", SERIES, by_position)
        both.append(evaluate.compare_models(quantised(metrics, *_METRICS), SERIES).withColumn("by_position", F.lit(by_position)))
    return both[0].unionByName(both[1])


def stored(spark: SparkSession, table: DataFrame, name: str) -> DataFrame:
    path = fresh_path(spark, name)
    table.write.parquet(path)
    return spark.read.parquet(path)


_MODELS = ("mn", "ll", "ts", "ar", "sa")


@query(
    "F10_compare_fitted_models",
    M.query(
        ",".join(
            [M.series(TARGETS), M.MEAN, M.lag_linear(), M.trend_seasonal(history=False), _FIXED_AR]
            + [M.ar_fits("sa", True, M.ORDERS), M.ar_run("sa", True, "seasonal_ar_search")]
            + ["\nfc AS (" + " UNION ALL ".join(f"SELECT * FROM {m}" for m in _MODELS) + ")", M.COMPARED]
        ),
        f"SELECT station_id, target, model, by_position, {', '.join(_METRICS)}, "
        + ", ".join(
            f"row_number() OVER (PARTITION BY station_id, target, by_position ORDER BY {m}, model) = 1 AS best_{m}"
            for m in _METRICS
        )
        + " FROM me",
    ),
)
def f_compare_fitted(spark, d):
    parts = stored(spark, every_target(spark, d), "split")
    return compared(parts, stored(spark, fitted_models(parts), "forecasts"))


@query("F10_compare_all_models")
def f_compare_all(spark, d):
    """Every model, the forest too, on one stored split of all targets."""
    parts = stored(spark, every_target(spark, d), "split")
    places = fixture.stations(spark, d).select(KEY, "latitude", "longitude", "elevation")
    code = F.array_position(F.lit(list(TARGETS)), F.col("target")).cast("double")
    placed = parts.join(places, KEY).withColumn("target_code", code)
    traits = ("latitude", "longitude", "elevation", "target_code")
    # Ten levels are as good as twelve on these series, and take half the time.
    forest = forecast_lag_forest(placed, 90, "value", SERIES, depth=10, traits=traits)
    return compared(parts, stored(spark, ts.append(fitted_models(parts), forest), "forecasts"))


@query(
    "F5_residual_interval",
    S.query(
        S.MEAN_FORECAST
        + f""",
rs AS (SELECT station_id, 1.96 * stddev_pop({MEAN_T} - feels_like_mean) AS half FROM d GROUP BY 1)""",
        f"""SELECT station_id, model, time, {S.q("forecast", "forecast")},
        {S.q("forecast - half", "lower_ci")}, {S.q("forecast + half", "upper_ci")}
        FROM mf JOIN rs USING (station_id)""",
    ),
)
def f_interval(spark, d):
    series = stored_days(spark, d, MEAN_T, "feels_like_mean")
    residuals = series.select(
        KEY, (F.col(MEAN_T) - F.col("feels_like_mean")).alias("residual")
    )
    parts = ts.train_test_split(series.select(KEY, "time", MEAN_T))
    ahead = forecast_mean(parts).drop("lower_ci", "upper_ci")
    return quantised(evaluate.residual_interval(ahead, residuals), *_BAND)


@query("F6_forecast_trend_seasonal", model_sql(M.trend_seasonal(history=True), "ts"))
def f_trend(spark, d):
    return quantised(forecast_trend_seasonal(split(spark, d)), *_BAND)


@query("F7_forecast_seasonal_ar", model_sql(_FIXED_AR, "ar"))
def f_seasonal(spark, d):
    return quantised(forecast_seasonal_ar(split(spark, d)), *_BAND)


@query("F7_forecast_seasonal_ar_search", model_sql(_SEARCHED_AR, "sa"))
def f_seasonal_search(spark, d):
    return quantised(forecast_seasonal_ar(split(spark, d), search=True), *_BAND)


@query(
    "F8_order_search",
    M.query(
        f"{M.series([MEAN_T])},{M.ar_fits('sa', True, M.ORDERS)}",
        f"""SELECT station_id, p, q, {S.q("aicc", "aicc")},
        row_number() OVER (PARTITION BY station_id ORDER BY aicc, p, q) = 1 AS best FROM sa_k""",
    ),
)
def f_orders(spark, d):
    return quantised(order_search(split(spark, d), MEAN_T), "aicc")


@query(
    "F9_forecast_mean",
    S.query(S.MEAN_FORECAST, f"SELECT station_id, model, time, {S.quantised(_BAND)} FROM mf"),
)
def f_mean(spark, d):
    return quantised(forecast_mean(split(spark, d)), *_BAND)


@query(
    "F10_compare_models",
    S.query(
        S.LEVEL_FORECAST
        + f",\nmq AS (SELECT station_id, model, {S.quantised(_METRICS)} FROM me)",
        f"""SELECT station_id, model, {", ".join(_METRICS)}, """
        + ", ".join(
            f"row_number() OVER (PARTITION BY station_id ORDER BY {m}, model) = 1 AS best_{m}"
            for m in _METRICS
        )
        + " FROM mq",
    ),
)
def f_compare(spark, d):
    parts = split(spark, d)
    metrics = evaluate.forecast_metrics(
        test_part(parts), two_forecasts(parts), MEAN_T, by_position=True
    )
    # Rounded first: equal errors must tie in both engines.
    return evaluate.compare_models(quantised(metrics, *_METRICS))


@query(
    "F11_history_plus_forecast",
    S.query(
        S.MEAN_FORECAST,
        f"""SELECT station_id, 'history' AS series, time, {S.q(MEAN_T, "observed")},
        NULL::VARCHAR AS model, NULL::DOUBLE AS forecast, NULL::DOUBLE AS lower_ci,
        NULL::DOUBLE AS upper_ci
        FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time DESC) AS r FROM d)
        WHERE r <= 365
        UNION ALL
        SELECT station_id, 'forecast', time, NULL::DOUBLE, model, {S.quantised(_BAND)} FROM mf""",
    ),
)
def f_history(spark, d):
    series = target_series(spark, d)
    table = evaluate.history_plus_forecast(series, forecast_mean(ts.train_test_split(series)), MEAN_T)
    return quantised(table, "observed", *_BAND)


# -- joins, sorts and set operations --------------------------------------------


@query(
    "J1_country_left_join",
    S.query(
        S.SUMMARY
        + f""",
ca AS (SELECT country, avg({MEAN_T}) AS {MEAN_T} FROM sm GROUP BY 1),
bo AS (SELECT n_nationkey, {_BOUNDARY_SQL} AS name FROM nation)""",
        f"""SELECT {_CLEAN_SQL} AS name_clean, n_nationkey, name, country, {S.q(MEAN_T, MEAN_T)}
        FROM bo JOIN ca ON {_CLEAN_SQL} = lower(trim(country))""",
    ),
)
def j_country(spark, d):
    averages = spatial.country_average(summary(spark, d))
    return quantised(spatial.country_join(boundaries(spark, d), averages), MEAN_T)


@query(
    "J2_date_semi_join",
    S.query(
        S.MEAN_FORECAST,
        f"""SELECT station_id, time, model, {S.quantised(_BAND)} FROM mf
        WHERE (station_id, time) IN (SELECT (station_id, time) FROM sp WHERE split = 'test')""",
    ),
)
def j_semi(spark, d):
    parts = split(spark, d)
    rows = evaluate.rows_on_test_dates(forecast_mean(parts), test_part(parts))
    return quantised(rows, *_BAND)


@query(
    "J3_dictionary_lookup",
    S.query(
        CODED + "," + S.STATIONS,
        f"""SELECT station_id, time, name, country, {_wmo_sql("Unknown conditions")} AS description
        FROM wc LEFT JOIN st USING (station_id)""",
    ),
)
def j_lookup(spark, d):
    place = fixture.stations(spark, d).select(KEY, "name", "country")
    return (
        coded(spark, d)
        .join(place, KEY, "left")
        .select(KEY, "time", "name", "country", wmo_description(F.col("weather_code")).alias("description"))
    )


@query(
    "O1_sort_by_time",
    S.query(S.D, f"SELECT station_id, time, {S.q(MEAN_T, MEAN_T)} FROM d ORDER BY 1, 2"),
)
def o_sort(spark, d):
    return quantised(ts.sort_by_time(target_series(spark, d)), MEAN_T)


@query("O2_limit", _rank_sql(100, "DESC"))
def o_limit(spark, d):
    """The newest hundred rows of each station, as the data page shows them."""
    return quantised(ts.last_n(target_series(spark, d), 100), MEAN_T)


@query(
    "O3_append",
    S.query(
        S.MEAN_FORECAST,
        f"""SELECT station_id, time, {S.q(MEAN_T, MEAN_T)}, split, NULL::DOUBLE AS forecast FROM sp
        UNION ALL SELECT station_id, time, NULL, NULL, {S.q("forecast")} FROM mf""",
    ),
)
def o_append(spark, d):
    parts = split(spark, d)
    ahead = forecast_mean(parts).select(KEY, "time", "forecast")
    rows = ts.append(
        parts.where("split = 'train'"), parts.where("split = 'test'"), ahead
    )
    return quantised(rows, MEAN_T, "forecast")


# -- streaming --------------------------------------------------------------------


def reading_stream(spark: SparkSession, d: str) -> DataFrame:
    """Order lines arriving as readings."""
    lines = fixture.table(spark, d, "lineitem")
    source = spark.readStream.schema(lines.schema).option("pathGlobFilter", "lineitem.parquet")
    hours = F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
    return source.parquet(d).select(
        F.floor(F.col("l_suppkey") / fixture.SUPPLIERS_PER_STATION).alias(KEY),
        (F.col("l_shipdate") + hours).alias("time"),
        (F.col("l_quantity") * 0.9 - 5).alias("temperature_2m"),
        (F.col("l_discount") * 1000).alias("relative_humidity_2m"),
        (F.col("l_tax") * 500).alias("wind_speed_10m"),
        (F.col("l_orderkey") * 37 % 360).cast("double").alias("wind_direction_10m"),
        (F.col("l_suppkey") * 1.5).alias("latitude"),
    )


def run_stream(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run what has arrived through to a table in the shared folder and read it."""
    path = fresh_path(spark, name)
    running = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-state")
        .trigger(availableNow=True)
        .outputMode("append")
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


STREAM_SQL = """
rs AS (SELECT l_suppkey // 20 AS station_id,
              l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS time,
              l_quantity * 0.9 - 5 AS temperature_2m, l_discount * 1000 AS relative_humidity_2m,
              l_tax * 500 AS wind_speed_10m, CAST(l_orderkey * 37 % 360 AS DOUBLE) AS wind_direction_10m
       FROM lineitem)"""
_STREAM_FIGURES = {
    "temperature_2m_mean": "avg(temperature_2m)",
    "temperature_2m_min": "min(temperature_2m)",
    "temperature_2m_max": "max(temperature_2m)",
    "relative_humidity_2m_mean": "avg(relative_humidity_2m)",
    "wind_speed_10m_mean": "avg(wind_speed_10m)",
    "wind_speed_10m_max": "max(wind_speed_10m)",
    "wind_direction_10m_dominant": S.DIRECTION,
}


@query(
    "T1_stream_daily",
    S.query(
        STREAM_SQL,
        f"""SELECT station_id, date_trunc('day', time)::TIMESTAMP AS time,
        {", ".join(S.q(e, n) for n, e in _STREAM_FIGURES.items())} FROM rs
        WHERE date_trunc('day', time) + INTERVAL 1 DAY <=
              (SELECT max(time) - INTERVAL 2 DAY FROM rs)
        GROUP BY 1, 2""",
    ),
)
def t_daily(spark, d):
    """Days are given out once the watermark has passed their end."""
    table = run_stream(spark, stream_daily(reading_stream(spark, d)), "stream-daily")
    return quantised(table.select(KEY, "time", *_STREAM_FIGURES), *_STREAM_FIGURES)


@query(
    "T2_stream_clean",
    S.query(
        STREAM_SQL
        + """,
b AS (SELECT station_id, """
        + ", ".join(
            f"avg({c}) AS m_{c}, nullif(stddev_samp({c}), 0) AS s_{c}"
            for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m")
        )
        + """ FROM rs GROUP BY 1),
h AS (SELECT station_id, time, """
        + ", ".join(
            f"CASE WHEN s_{c} IS NULL THEN {c} "
            f"ELSE least(greatest({c}, m_{c} - 1.5 * s_{c}), m_{c} + 1.5 * s_{c}) END AS {c}"
            for c in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m")
        )
        + " FROM rs JOIN b USING (station_id))",
        f"""SELECT station_id, time,
        {S.quantised(["temperature_2m", "relative_humidity_2m", "wind_speed_10m"])},
        {S.q(S.FEELS_LIKE, "feels_like")},
        CASE WHEN hour(time) >= 6 AND hour(time) < 18 THEN 1 ELSE 0 END::INTEGER AS is_daytime FROM h""",
    ),
)
def t_clean(spark, d):
    arriving = reading_stream(spark, d)
    stored = fixture.table(spark, d, "lineitem")
    known = stored.select(
        F.floor(F.col("l_suppkey") / fixture.SUPPLIERS_PER_STATION).alias(KEY),
        (F.col("l_quantity") * 0.9 - 5).alias("temperature_2m"),
        (F.col("l_discount") * 1000).alias("relative_humidity_2m"),
        (F.col("l_tax") * 500).alias("wind_speed_10m"),
    )
    capped = [c for c in CAPPED_READINGS if c in known.columns]
    bounds = clean.outlier_bounds(known, columns=capped, threshold=1.5)
    table = run_stream(spark, stream_clean(arriving, bounds), "stream-clean")
    figures = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "feels_like"]
    return quantised(table.select(KEY, "time", *figures, "is_daytime"), *figures)


_FILLED = ("temperature_2m", "relative_humidity_2m")
_SO_FAR = "OVER (PARTITION BY station_id ORDER BY time ROWS UNBOUNDED PRECEDING)"


@query(
    "T2_stream_fill",
    S.query(
        S.I
        + """,
ends AS (SELECT station_id, least("""
        + ", ".join(f"max(time) FILTER ({c} IS NOT NULL)" for c in _FILLED)
        + """) AS until
         FROM w WHERE time <= (SELECT max(time) - INTERVAL 2 DAY FROM w) GROUP BY 1),
r AS (SELECT station_id, time, """
        + ", ".join(
            f"{c}, avg({c}) {_SO_FAR} AS m_{c}, nullif(stddev_samp({c}) {_SO_FAR}, 0) AS s_{c}"
            for c in _FILLED
        )
        + " FROM i)",
        "SELECT station_id, time, "
        + ", ".join(
            S.q(
                f"CASE WHEN s_{c} IS NULL THEN {c} "
                f"ELSE least(greatest({c}, m_{c} - 1.5 * s_{c}), m_{c} + 1.5 * s_{c}) END",
                c,
            )
            for c in _FILLED
        )
        + " FROM r JOIN ends USING (station_id) WHERE time <= until",
    ),
)
def t_fill(spark, d):
    """Gaps filled and readings capped to the bounds so far, with state per station."""
    path = fresh_path(spark, "arriving")
    weather(spark, d).select(KEY, "time", *_FILLED).write.parquet(path)
    schema = spark.read.parquet(path).schema
    arriving = spark.readStream.schema(schema).parquet(path)
    filled = stream_fill(arriving, columns=_FILLED, max_gap="365 days", threshold=1.5)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        table = run_stream(spark, filled, "stream-fill")
    finally:
        spark.conf.set(setting, before)
    return quantised(clean.cap_to_bounds(table, _FILLED), *_FILLED)
