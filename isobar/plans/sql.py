"""The same computations as plain SQL for a second engine, as shared fragments.

Every fragment is a list of common table expressions over the given tables;
``w`` hourly weather, ``i`` gaps filled, ``c`` capped, ``h`` clean, ``d`` daily.
"""

from __future__ import annotations

READINGS = (
    "temperature_2m",
    "relative_humidity_2m",
    "wind_speed_10m",
    "wind_direction_10m",
    "surface_pressure",
    "precipitation",
)
CAPPED = ("temperature_2m", "relative_humidity_2m", "surface_pressure", "wind_speed_10m")
DAILY_VARIABLES = (
    "temperature_2m_mean",
    "temperature_2m_min",
    "temperature_2m_max",
    "feels_like_mean",
    "feels_like_min",
    "feels_like_max",
    "relative_humidity_2m_mean",
    "precipitation_sum",
    "surface_pressure_mean",
    "wind_speed_10m_mean",
    "wind_speed_10m_max",
)


def q(expression: str, name: str | None = None) -> str:
    """Four decimals; the rounding border is moved off the decimals that occur."""
    out = f"floor(({expression}) * 10000 + 0.3819) / 10000.0"
    return f"CAST({out} AS DOUBLE) AS {name}" if name else f"CAST({out} AS DOUBLE)"


W = """
g AS (
  SELECT l_suppkey // 20 AS station_id,
         l_shipdate + to_hours(CAST(l_orderkey % 24 AS INTEGER)) AS time,
         avg(l_quantity) AS q, avg(l_discount) AS d, avg(l_tax) AS x,
         min(l_extendedprice) AS p, min(l_orderkey) AS k
  FROM lineitem GROUP BY 1, 2),
w AS (
  SELECT station_id, time,
    CASE WHEN k % 11 <> 0 THEN round(q * 0.9 - 5.0137, 6) END AS temperature_2m,
    CASE WHEN k % 13 <> 0 THEN round(d * 1000 + 0.137, 6) END AS relative_humidity_2m,
    CASE WHEN k % 509 = 0 THEN 150.0 ELSE round(x * 500, 6) END AS wind_speed_10m,
    CAST(k * 37 % 360 AS DOUBLE) AS wind_direction_10m,
    CASE WHEN k % 499 = 0 THEN 1400.0 ELSE 980 + p / 1500 END AS surface_pressure,
    CASE WHEN k % 4 = 0 THEN round(x * 50, 6) ELSE 0.0 END AS precipitation
  FROM g)"""


def near(source: str, columns, name: str = "near", key: str = "station_id") -> str:
    """Known neighbours of each row by position."""
    before = f"(PARTITION BY {key} ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    after = f"(PARTITION BY {key} ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    parts = []
    for c in columns:
        at = f"CASE WHEN {c} IS NOT NULL THEN rn END"
        parts += [
            f"last_value({c} IGNORE NULLS) OVER {before} AS p_{c}",
            f"last_value({at} IGNORE NULLS) OVER {before} AS pr_{c}",
            f"first_value({c} IGNORE NULLS) OVER {after} AS n_{c}",
            f"first_value({at} IGNORE NULLS) OVER {after} AS nr_{c}",
        ]
    numbered = f"row_number() OVER (PARTITION BY {key} ORDER BY time) AS rn"
    return (
        f"{name}_rn AS (SELECT *, {numbered} FROM {source}),\n"
        f"{name} AS (SELECT *, {', '.join(parts)} FROM {name}_rn)"
    )


def linear(c: str) -> str:
    return (
        f"CASE WHEN {c} IS NOT NULL THEN {c} "
        f"WHEN p_{c} IS NOT NULL AND n_{c} IS NOT NULL "
        f"THEN p_{c} + (n_{c} - p_{c}) * ((rn - pr_{c}) / CAST(nr_{c} - pr_{c} AS DOUBLE)) "
        f"ELSE coalesce(p_{c}, n_{c}) END AS {c}"
    )


I = (
    W
    + ",\n"
    + near("w", READINGS)
    + ",\ni AS (SELECT station_id, time, "
    + ", ".join(linear(c) for c in READINGS)
    + " FROM near)"
)


def capped(source: str, bounds: str = "b") -> str:
    """Clip to the mean and three deviations, per station."""
    figures = ", ".join(f"avg({c}) AS m_{c}, nullif(stddev_samp({c}), 0) AS s_{c}" for c in CAPPED)
    clip = ", ".join(
        f"CASE WHEN s_{c} IS NULL OR {c} IS NULL THEN {c} "
        f"ELSE least(greatest({c}, m_{c} - 3 * s_{c}), m_{c} + 3 * s_{c}) END AS {c}"
        for c in CAPPED
    )
    rest = ", ".join(c for c in READINGS if c not in CAPPED)
    return (
        f"{bounds} AS (SELECT station_id, {figures} FROM {source} GROUP BY station_id),\n"
        f"c AS (SELECT station_id, time, {clip}, {rest} FROM {source} JOIN {bounds} USING (station_id))"
    )


T, R, V = "temperature_2m", "relative_humidity_2m", "wind_speed_10m"
F_ = f"({T} * 9 / 5 + 32)"
HEAT_INDEX = f"""CASE WHEN {T} < 26.7 OR {R} < 40 THEN {T} ELSE
  ((-42.379 + 2.04901523 * {F_} + 10.14333127 * {R} - 0.22475541 * {F_} * {R}
    - 0.00683783 * {F_} * {F_} - 0.05481717 * {R} * {R} + 0.00122874 * {F_} * {F_} * {R}
    + 0.00085282 * {F_} * {R} * {R} - 0.00000199 * {F_} * {F_} * {R} * {R}) - 32) * 5 / 9 END"""
WIND_CHILL = f"""CASE WHEN {T} > 10 OR {V} <= 4.8 THEN {T} ELSE
  13.12 + 0.6215 * {T} - 11.37 * pow({V}, 0.16) + 0.3965 * {T} * pow({V}, 0.16) END"""
FEELS_LIKE = f"""CASE WHEN {T} >= 26.7 THEN {HEAT_INDEX}
  WHEN {T} <= 10 AND {V} > 0 THEN {WIND_CHILL} ELSE {T} END"""

H = I + ",\n" + capped("i") + f",\nh AS (SELECT *, {FEELS_LIKE} AS feels_like FROM c)"

# Adding 0.0 turns a negative zero into zero, whose angle is another one.
DIRECTION = (
    "fmod(degrees(atan2(round(avg(sin(radians(wind_direction_10m))), 12) + 0.0, "
    "round(avg(cos(radians(wind_direction_10m))), 12) + 0.0)) + 360, 360)"
)

DAILY_SELECT = f"""SELECT station_id, date_trunc('day', time)::TIMESTAMP AS time,
  avg(temperature_2m) AS temperature_2m_mean, min(temperature_2m) AS temperature_2m_min,
  max(temperature_2m) AS temperature_2m_max, avg(feels_like) AS feels_like_mean,
  min(feels_like) AS feels_like_min, max(feels_like) AS feels_like_max,
  avg(relative_humidity_2m) AS relative_humidity_2m_mean,
  coalesce(sum(precipitation), 0) AS precipitation_sum,
  avg(surface_pressure) AS surface_pressure_mean, avg(wind_speed_10m) AS wind_speed_10m_mean,
  max(wind_speed_10m) AS wind_speed_10m_max, {DIRECTION} AS wind_direction_10m_dominant
  FROM h GROUP BY 1, 2"""

D = H + f",\nd AS ({DAILY_SELECT})"

STATIONS = """
st AS (
  SELECT station_id, name, country,
         CAST((station_id * 37) % 140 - 70 AS DOUBLE) AS latitude,
         CAST((station_id * 101) % 360 - 180 AS DOUBLE) AS longitude,
         CAST((station_id * 13) % 900 AS DOUBLE) AS elevation
  FROM (SELECT s_suppkey // 20 AS station_id, min(s_name) AS name, min(n_name) AS country
        FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1))"""

SUMMARY = (
    D
    + ","
    + STATIONS
    + """,
sm AS (
  SELECT station_id, any_value(name) AS name, any_value(latitude) AS latitude,
         any_value(longitude) AS longitude, any_value(country) AS country,
         avg(temperature_2m_mean) AS temperature_2m_mean, avg(precipitation_sum) AS precipitation_sum
  FROM d JOIN st USING (station_id) GROUP BY station_id)"""
)

SPLIT = (
    D
    + """,
sp_rn AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time) - 1 AS pos,
                 count(*) OVER (PARTITION BY station_id) AS n FROM d),
sp AS (SELECT *, CASE WHEN pos < (CASE WHEN n > 30 THEN n - 30 ELSE floor(n * 0.8) END)
                      THEN 'train' ELSE 'test' END AS split FROM sp_rn)"""
)

MEAN_FORECAST = (
    SPLIT
    + """,
mf AS (
  SELECT station_id, 'mean' AS model, last_day + to_days(CAST(i AS INTEGER)) AS time, forecast,
         forecast - width AS lower_ci, forecast + width AS upper_ci
  FROM (SELECT station_id, avg(temperature_2m_mean) AS forecast,
               2 * stddev_samp(temperature_2m_mean) AS width, max(time) AS last_day
        FROM sp WHERE split = 'train' GROUP BY station_id), generate_series(1, 90) AS s(i))"""
)

# A second model that plain SQL can state: the last training value, kept level.
LEVEL_FORECAST = (
    MEAN_FORECAST
    + """,
lf AS (
  SELECT station_id, 'last_value' AS model, last_day + to_days(CAST(i AS INTEGER)) AS time, forecast,
         forecast AS lower_ci, forecast AS upper_ci
  FROM (SELECT station_id, arg_max(temperature_2m_mean, time) AS forecast, max(time) AS last_day
        FROM sp WHERE split = 'train' GROUP BY station_id), generate_series(1, 90) AS s(i)),
fc AS (SELECT * FROM mf UNION ALL SELECT * FROM lf),
te AS (SELECT * FROM sp WHERE split = 'test'),
ap AS (
  SELECT fc.station_id, model, temperature_2m_mean AS actual, forecast
  FROM (SELECT *, row_number() OVER (PARTITION BY station_id, model ORDER BY time) AS r FROM fc) fc
  JOIN (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY time) AS r FROM te) te
    ON fc.station_id = te.station_id AND fc.r = te.r),
ad AS (
  SELECT * FROM (
    SELECT fc.station_id, fc.model, fc.time, te.temperature_2m_mean AS actual, fc.forecast,
           count(*) OVER (PARTITION BY fc.station_id, fc.model) AS found, tn.expected
    FROM fc JOIN te ON fc.station_id = te.station_id AND fc.time = te.time
    JOIN (SELECT station_id, count(*) AS expected FROM te GROUP BY 1) tn
      ON tn.station_id = fc.station_id) WHERE found = expected),
me AS (
  SELECT station_id, model, avg(abs(actual - forecast)) AS mae,
         sqrt(avg((actual - forecast) * (actual - forecast))) AS rmse,
         coalesce(avg(abs((actual - forecast) / nullif(actual, 0)) * 100), 0) AS mape
  FROM ap GROUP BY 1, 2)"""
)


def query(ctes: str, select: str) -> str:
    return f"WITH {ctes.strip()}\n{select}"


def quantised(columns, prefix: str = "") -> str:
    return ", ".join(q(f"{prefix}{c}", c) for c in columns)
