"""The fitted models as plain SQL for a second engine, on the fragments of ``sql``.

``sr`` holds series as rows of ``(station_id, target, time, y, split)``; ``tr`` the
training rows with their position, ``en`` one row per series with the last training
time and the steps ahead.  Each model gives ``(station_id, target, model, time,
forecast, lower_ci, upper_ci)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from ..operators.forecast.seasonal_ar import LAGS as AR_LAGS
from ..operators.forecast.seasonal_ar import LONG_AR, MOST, SEASON
from ..operators.forecast.trend_seasonal import CYCLES, KNOT_PENALTY, KNOT_RANGE, KNOTS, SEASON_PENALTY, SIZE
from ..operators.timeseries import LAGS, ROLLING
from . import sql as S

S_KEY = "station_id, target"
OVER = f"OVER (PARTITION BY {S_KEY} ORDER BY time"


def series(targets: Sequence[str]) -> str:
    """Daily figures as series, split as ``train_test_split`` does."""
    parts = "\nUNION ALL\n".join(f"SELECT station_id, '{t}' AS target, time, {t} AS y FROM d" for t in targets)
    return (
        S.D
        + f""",
lo AS ({parts}),
lr AS (SELECT *, row_number() {OVER}) - 1 AS pos, count(*) OVER (PARTITION BY {S_KEY}) AS n FROM lo),
sr AS (SELECT {S_KEY}, time, y, CASE WHEN pos < (CASE WHEN n > 30 THEN n - 30 ELSE floor(n * 0.8) END)
                                     THEN 'train' ELSE 'test' END AS split FROM lr),
tr AS (SELECT {S_KEY}, time, y, row_number() {OVER}) - 1 AS pos FROM sr WHERE split = 'train'),
en AS (SELECT {S_KEY}, max(time) FILTER (split = 'train') AS last_time,
              greatest(90, count(*) FILTER (split = 'test')) AS steps FROM sr GROUP BY ALL)"""
    )


def solved(name: str, source: str, keys: str, size: int) -> str:
    """``x``: solutions of the augmented matrices ``a`` (lists of rows) by Gauss and Jordan."""
    return f"""
{name}_gj AS (
  SELECT {keys}, 1 AS k, a FROM {source}
  UNION ALL
  SELECT {keys}, k + 1,
         [CASE WHEN i = k THEN [v / a[k][k] FOR v IN a[k]]
               ELSE [a[i][j] - a[i][k] * a[k][j] / a[k][k] FOR j IN range(1, {size + 2})] END FOR i IN range(1, {size + 1})]
  FROM {name}_gj WHERE k <= {size}),
{name} AS (SELECT {keys}, [a[i][{size + 1}] FOR i IN range(1, {size + 1})] AS x FROM {name}_gj WHERE k = {size + 1})"""


def dot(a: str, b: str, n: str) -> str:
    return f"list_sum([{a}[i] * {b}[i] FOR i IN range(1, {n} + 1)])"


_CALENDAR = (
    "month({t})::DOUBLE, sin(2 * pi() * dayofyear({t}) / 365.25), cos(2 * pi() * dayofyear({t}) / 365.25)"
)


def lag_linear() -> str:
    """``ll``: regression on lags, rolling means and season, run forward a day at a time."""
    lags = [f"lag(y, {k}) {OVER})" for k in LAGS]
    over = [f"{OVER} ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in ROLLING]
    rolls = [f"CASE WHEN count(y) {o} = {k} THEN avg(y) {o} END" for k, o in zip(ROLLING, over, strict=True)]
    framed = [*lags, *rolls]
    later = "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    filled = ", ".join(f"coalesce(f{i}, first_value(f{i} IGNORE NULLS) {OVER} {later}, 0)" for i in range(len(framed)))
    m = 3 + len(framed)
    hist = "len(hist)"
    ahead = [f"CASE WHEN {hist} >= {k} THEN hist[{hist} + 1 - {k}] ELSE 0 END" for k in LAGS]
    ahead += [f"CASE WHEN {hist} >= {k} THEN list_avg(hist[{hist} - {k} + 1:{hist}]) ELSE 0 END" for k in ROLLING]
    now = "(last_time + to_days(CAST(step + 1 AS INTEGER)))"
    row = f"[{_CALENDAR.format(t=now)}, {', '.join(ahead)}]"
    return f"""
ll_f AS (SELECT {S_KEY}, time, y, {", ".join(f"{e} AS f{i}" for i, e in enumerate(framed))} FROM tr),
ll_t AS (SELECT {S_KEY}, [{_CALENDAR.format(t="time")}, {filled}, y] AS t FROM ll_f),
ll_m AS (SELECT {S_KEY}, i, avg(t[i]) AS m FROM ll_t, (SELECT unnest(range(1, {m + 2})) AS i) GROUP BY ALL),
ll_mu AS (SELECT {S_KEY}, list(m ORDER BY i) AS mu FROM ll_m GROUP BY ALL),
ll_c AS (SELECT {S_KEY}, i, j, avg((t[i] - mu[i]) * (t[j] - mu[j])) AS c
         FROM ll_t JOIN ll_mu USING ({S_KEY}), (SELECT unnest(range(1, {m + 2})) AS i), (SELECT unnest(range(1, {m + 2})) AS j)
         GROUP BY ALL),
ll_r AS (SELECT {S_KEY}, i, list(c ORDER BY j) AS r FROM ll_c GROUP BY ALL),
ll_a AS (SELECT {S_KEY}, list(r ORDER BY i) AS a FROM ll_r GROUP BY ALL),
{solved("ll_s", "ll_a_", S_KEY, m).replace("FROM ll_a_", f"FROM (SELECT {S_KEY}, a[1:{m}] AS a FROM ll_a)")},
ll_w AS (SELECT {S_KEY}, x AS w, mu[{m + 1}] - {dot("x", "mu", m)} AS level,
                sqrt(greatest(a[{m + 1}][{m + 1}] - {dot("x", f"a[{m + 1}]", m)}, 0)) AS spread
         FROM ll_s JOIN ll_mu USING ({S_KEY}) JOIN ll_a USING ({S_KEY})),
ll_h AS (SELECT {S_KEY}, list(y ORDER BY time) AS hist
         FROM (SELECT *, row_number() {OVER} DESC) AS r FROM tr) WHERE r <= {max(LAGS)} GROUP BY ALL),
ll_run AS (
  SELECT {S_KEY}, 0 AS step, hist, last_time, steps, w, level, spread
  FROM ll_h JOIN en USING ({S_KEY}) JOIN ll_w USING ({S_KEY})
  UNION ALL
  SELECT {S_KEY}, step + 1, list_append(hist, level + {dot("w", row, m)}), last_time, steps, w, level, spread
  FROM ll_run WHERE step < steps),
ll AS (SELECT {S_KEY}, 'linear_regression' AS model, last_time + to_days(CAST(step AS INTEGER)) AS time,
              hist[len(hist)] AS forecast, hist[len(hist)] - 1.96 * spread AS lower_ci, hist[len(hist)] + 1.96 * spread AS upper_ci
       FROM ll_run WHERE step > 0)"""


def trend_seasonal(history: bool) -> str:
    """``ts``: penalised regression on a broken line and two cycles."""
    share = "coalesce((day - first_day) / nullif(last_day - first_day, 0), 0)"
    terms = ["1::DOUBLE", "s", *[f"greatest(s - {KNOT_RANGE * (i + 1) / KNOTS!r}, 0)" for i in range(KNOTS)]]
    for period, order in CYCLES:
        for n in range(1, order + 1):
            terms += [f"{f}(2 * pi() * {n} * day / {period})" for f in ("sin", "cos")]
    listed = f"[{', '.join(terms)}]"
    penalty = [0.0, 0.0, *[KNOT_PENALTY] * KNOTS, *[SEASON_PENALTY] * (SIZE - 2 - KNOTS)]
    day = "CAST(date_diff('day', DATE '1970-01-01', CAST(time AS DATE)) AS DOUBLE)"
    past = f"SELECT {S_KEY}, time FROM tr\n  UNION ALL\n  " if history else ""
    return f"""
ts_d AS (SELECT {S_KEY}, {day} AS day, y FROM tr WHERE y IS NOT NULL),
ts_z AS (SELECT {S_KEY}, min(day) AS first_day, max(day) AS last_day, count(*) AS n, sum(y) / count(*) AS center,
                coalesce(nullif(greatest(max(y) - sum(y) / count(*), sum(y) / count(*) - min(y)), 0), 1) AS largest
         FROM ts_d GROUP BY ALL),
ts_s AS (SELECT {S_KEY}, day, {share} AS s, (y - center) / largest AS y FROM ts_d JOIN ts_z USING ({S_KEY})),
ts_t AS (SELECT {S_KEY}, list_append({listed}, y) AS t FROM ts_s),
ts_g AS (SELECT {S_KEY}, i, j, sum(t[i] * t[j]) AS g
         FROM ts_t, (SELECT unnest(range(1, {SIZE + 2})) AS i), (SELECT unnest(range(1, {SIZE + 2})) AS j) WHERE i <= j GROUP BY ALL),
ts_f AS (SELECT {S_KEY}, i, j, g FROM ts_g UNION ALL SELECT {S_KEY}, j, i, g FROM ts_g WHERE i < j),
ts_p AS (SELECT {S_KEY}, i, j, g + CASE WHEN i = j AND i <= {SIZE} THEN {penalty}[i] ELSE 0 END AS g FROM ts_f),
ts_r AS (SELECT {S_KEY}, i, list(g ORDER BY j) AS r FROM ts_p GROUP BY ALL),
ts_a AS (SELECT {S_KEY}, list(r ORDER BY i) AS a FROM ts_r GROUP BY ALL),
{solved("ts_x", "ts_a_", S_KEY, SIZE).replace("FROM ts_a_", f"FROM (SELECT {S_KEY}, a[1:{SIZE}] AS a FROM ts_a)")},
ts_w AS (SELECT {S_KEY}, x, first_day, last_day, center, largest,
                sqrt(greatest(a[{SIZE + 1}][{SIZE + 1}] - {dot("x", f"a[{SIZE + 1}]", SIZE)}
                              - list_sum([{penalty}[i] * x[i] * x[i] FOR i IN range(1, {SIZE + 1})]), 0) / n) * largest AS spread
         FROM ts_x JOIN ts_a USING ({S_KEY}) JOIN ts_z USING ({S_KEY})),
ts_n AS (
  {past}SELECT {S_KEY}, last_time + to_days(CAST(unnest(range(1, steps + 1)) AS INTEGER)) AS time FROM en),
ts_q AS (SELECT *, {share} AS s FROM (SELECT *, {day} AS day FROM ts_n JOIN ts_w USING ({S_KEY}))),
ts_v AS (SELECT *, center + largest * {dot("x", "t", SIZE)} AS forecast FROM (SELECT *, {listed} AS t FROM ts_q)),
ts AS (SELECT {S_KEY}, 'trend_seasonal' AS model, time, forecast, forecast - 1.96 * spread AS lower_ci,
              forecast + 1.96 * spread AS upper_ci FROM ts_v)"""


def ar_fits(name: str, weekly: bool, orders: Sequence[tuple[int, int]]) -> str:
    """``<name>_k``: fits of the given orders with their weights; ``<name>_l``: latest values, changes and shocks."""
    n, m = name, 2 * len(AR_LAGS)
    over = f"{OVER}"
    change = "y - lag(y, 1) {o})".format(o=over)
    if weekly:
        change += f" - (lag(y, {SEASON}) {over}) - lag(y, {SEASON + 1}) {over}))"
    used = {
        (p, q): [int(k <= p or k == SEASON) for k in AR_LAGS] + [int(k <= q or k == SEASON) for k in AR_LAGS] for p, q in orders
    }
    listed = ", ".join(f"({p}, {q}, {u})" for (p, q), u in used.items())
    count = "(list_sum(used) + 2)"
    terms = [*[f"lag(w, {k}) {over})" for k in AR_LAGS], *[f"lag(e, {k}) {over})" for k in AR_LAGS], "w"]
    o_key = f"{S_KEY}, p, q"
    return f"""
{n}_d AS (SELECT {S_KEY}, unnest(generate_series(min(date_trunc('day', time)), max(date_trunc('day', time)), INTERVAL 1 DAY)) AS time
          FROM tr GROUP BY {S_KEY}),
{n}_y AS (SELECT {S_KEY}, time, coalesce(last_value(y IGNORE NULLS) {over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                 first_value(y IGNORE NULLS) {over} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS y
          FROM {n}_d LEFT JOIN tr USING ({S_KEY}, time)),
{n}_w AS (SELECT {S_KEY}, time, y, {change} AS w FROM {n}_y),
{n}_p AS (SELECT {S_KEY}, w, [{", ".join(f"w * lag(w, {k}) {over})" for k in range(LONG_AR + 1))}] AS p FROM {n}_w),
{n}_ps AS (SELECT {S_KEY}, i, coalesce(sum(p[i]), 0) AS s FROM {n}_p, (SELECT unnest(range(1, {LONG_AR + 2})) AS i) GROUP BY ALL),
{n}_pl AS (SELECT {S_KEY}, list(s ORDER BY i) AS s FROM {n}_ps GROUP BY ALL),
{n}_pa AS (SELECT {S_KEY}, [list_append([s[abs(i - j) + 1] FOR j IN range(1, {LONG_AR + 1})], s[i + 1]) FOR i IN range(1, {LONG_AR + 1})] AS a
           FROM {n}_pl),
{solved(f"{n}_phi", f"{n}_pa", S_KEY, LONG_AR)},
{n}_e AS (SELECT {S_KEY}, time, y, w, w - ({" + ".join(f"x[{k}] * lag(w, {k}) {over})" for k in range(1, LONG_AR + 1))}) AS e
          FROM {n}_w JOIN {n}_phi USING ({S_KEY})),
{n}_t AS (SELECT {S_KEY}, [{", ".join(terms)}] AS t FROM {n}_e),
{n}_u AS (SELECT * FROM {n}_t WHERE list_count(t) = {m + 1}),
{n}_m AS (SELECT {S_KEY}, i, avg(t[i]) AS mu, count(*) AS n FROM {n}_u, (SELECT unnest(range(1, {m + 2})) AS i) GROUP BY ALL),
{n}_ml AS (SELECT {S_KEY}, list(mu ORDER BY i) AS mu, any_value(n) AS n FROM {n}_m GROUP BY ALL),
{n}_c AS (SELECT {S_KEY}, i, j, avg((t[i] - mu[i]) * (t[j] - mu[j])) AS c FROM {n}_u JOIN {n}_ml USING ({S_KEY}),
                 (SELECT unnest(range(1, {m + 2})) AS i), (SELECT unnest(range(1, {m + 2})) AS j) GROUP BY ALL),
{n}_r AS (SELECT {S_KEY}, i, list(c ORDER BY j) AS r FROM {n}_c GROUP BY ALL),
{n}_g AS (SELECT {S_KEY}, list(r ORDER BY i) AS a FROM {n}_r GROUP BY ALL),
{n}_o(p, q, used) AS (VALUES {listed}),
{n}_a AS (SELECT {o_key}, used, a AS g, [[CASE WHEN used[i] = 0 THEN CAST(i = j AS int) WHEN j <= {m} AND used[j] = 0 THEN 0
                                              ELSE a[i][j] END FOR j IN range(1, {m + 2})] FOR i IN range(1, {m + 1})] AS a
          FROM {n}_g, {n}_o),
{solved(f"{n}_x", f"{n}_a", o_key, m)},
{n}_v AS (SELECT {o_key}, x, mu[{m + 1}] - {dot("x", "mu", m)} AS level, n, {count} AS c,
                 greatest(g[{m + 1}][{m + 1}] - {dot("x", f"g[{m + 1}]", m)}, 1e-12) AS variance
          FROM {n}_x JOIN {n}_a USING ({o_key}) JOIN {n}_ml USING ({S_KEY})),
{n}_k AS (SELECT *, n * ln(variance) + 2 * c + 2 * c * (c + 1) / (n - c - 1)::DOUBLE AS aicc FROM {n}_v),
{n}_l AS (SELECT {S_KEY}, list(y ORDER BY time) AS ys, list(w ORDER BY time) AS ws, list(e ORDER BY time) AS es
          FROM (SELECT *, row_number() {OVER} DESC) AS r FROM {n}_e) WHERE r <= {SEASON + 1} GROUP BY ALL)"""


def ar_run(name: str, weekly: bool, label: str) -> str:
    """``<name>``: the order with the least criterion run forward, and the response to one shock beside it."""
    n, lags = name, len(AR_LAGS)

    def moved(w: str, e: str, base: str) -> str:
        own = " + ".join(f"x[{i + 1}] * {w}[len({w}) + 1 - {k}]" for i, k in enumerate(AR_LAGS))
        shock = " + ".join(f"x[{lags + i + 1}] * {e}[len({e}) + 1 - {k}]" for i, k in enumerate(AR_LAGS))
        return f"({base} + {own} + {shock})"

    def next_y(y: str, d: str) -> str:
        week = f" + {y}[len({y}) + 1 - {SEASON}] - {y}[len({y}) - {SEASON}]" if weekly else ""
        return f"{y}[len({y})]{week} + {d}"

    zeros = [0.0] * (SEASON + 1)
    pulse = "CASE WHEN step = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    keep = f"{S_KEY}, steps, last_time, x, level, variance"
    return f"""
{n}_best AS (SELECT {S_KEY}, x, level, variance FROM {n}_k
             QUALIFY row_number() OVER (PARTITION BY {S_KEY} ORDER BY aicc, p, q) = 1),
{n}_run AS (
  SELECT {keep}, 0 AS step, ys, ws, es, {zeros}::DOUBLE[] AS y1, {zeros}::DOUBLE[] AS w1, {zeros}::DOUBLE[] AS e1, 0.0::DOUBLE AS squares
  FROM {n}_best JOIN {n}_l USING ({S_KEY}) JOIN en USING ({S_KEY})
  UNION ALL
  SELECT {keep}, step + 1, list_append(ys, {next_y("ys", "d0")}), list_append(ws, d0), list_append(es, 0.0::DOUBLE),
         list_append(y1, {next_y("y1", "d1")}), list_append(w1, d1), list_append(e1, {pulse}),
         squares + pow({next_y("y1", "d1")}, 2)
  FROM (SELECT *, {moved("ws", "es", "level")} AS d0, {moved("w1", "e1", f"({pulse})")} AS d1 FROM {n}_run) WHERE step < steps),
{n} AS (SELECT {S_KEY}, '{label}' AS model, last_time + to_days(CAST(step AS INTEGER)) AS time, ys[len(ys)] AS forecast,
               ys[len(ys)] - 1.96 * sqrt(variance * squares) AS lower_ci, ys[len(ys)] + 1.96 * sqrt(variance * squares) AS upper_ci
        FROM {n}_run WHERE step > 0)"""


ORDERS = [(p, q) for p in range(MOST + 1) for q in range(MOST + 1)]

MEAN = f"""
mn AS (SELECT {S_KEY}, 'mean' AS model, last_day + to_days(CAST(i AS INTEGER)) AS time, f AS forecast,
              f - width AS lower_ci, f + width AS upper_ci
       FROM (SELECT {S_KEY}, avg(y) AS f, 2 * stddev_samp(y) AS width, max(time) AS last_day FROM tr GROUP BY ALL),
            generate_series(1, 90) AS s(i))"""

COMPARED = f"""
te AS (SELECT {S_KEY}, time, y FROM sr WHERE split = 'test'),
pa AS (
  SELECT {S_KEY}, model, TRUE AS by_position, t.y AS actual, f.forecast
  FROM (SELECT *, row_number() OVER (PARTITION BY {S_KEY}, model ORDER BY time) AS r FROM fc) f
  JOIN (SELECT *, row_number() {OVER}) AS r FROM te) t USING ({S_KEY}, r)
  UNION ALL
  SELECT {S_KEY}, model, FALSE, y, forecast FROM (
    SELECT *, count(*) OVER (PARTITION BY {S_KEY}, model) AS found FROM fc JOIN te USING ({S_KEY}, time))
  JOIN (SELECT {S_KEY}, count(*) AS expected FROM te GROUP BY ALL) USING ({S_KEY}) WHERE found = expected),
me AS (
  SELECT {S_KEY}, model, by_position, {S.q("avg(abs(actual - forecast))", "mae")},
         {S.q("sqrt(avg((actual - forecast) * (actual - forecast)))", "rmse")},
         {S.q("coalesce(avg(abs((actual - forecast) / nullif(actual, 0)) * 100), 0)", "mape")}
  FROM pa GROUP BY {S_KEY}, model, by_position)"""

DECOMPOSE = (
    S.D
    + """,
de_p AS (SELECT station_id, time, temperature_2m_mean AS x, row_number() OVER (PARTITION BY station_id ORDER BY time) - 1 AS pos,
                count(*) OVER (PARTITION BY station_id) AS n FROM d),
de_s AS (SELECT *, CASE WHEN n >= 730 THEN 365 ELSE greatest(7, least(n // 2 - 1, 30)) END AS p FROM de_p),
de_w AS (SELECT *, sum(x) OVER (PARTITION BY station_id ORDER BY time ROWS UNBOUNDED PRECEDING) AS s FROM de_s),
de_b AS (
  SELECT a.*, least(pos + p // 2, n - 1) AS high, greatest(pos - p // 2, 0) AS low,
         least(pos + (p - 1) // 2, n - 1) AS few_high FROM de_w a),
de_t AS (
  SELECT b.station_id, b.time, b.x, b.pos, b.n, b.p,
         CASE WHEN b.n < 2 * b.p THEN (f.s - l.s + l.x) / (b.few_high - b.low + 1)
              WHEN b.pos >= b.p // 2 AND b.pos + b.p // 2 < b.n
              THEN (h.s - l.s + l.x - CASE WHEN b.p % 2 = 0 THEN (l.x + h.x) / 2 ELSE 0 END) / b.p END AS trend
  FROM de_b b JOIN de_w l ON l.station_id = b.station_id AND l.pos = b.low
              JOIN de_w h ON h.station_id = b.station_id AND h.pos = b.high
              JOIN de_w f ON f.station_id = b.station_id AND f.pos = b.few_high),
de_e AS (SELECT *, p // 2 AS front, n - 1 - p // 2 AS back FROM de_t),
de_l AS (
  SELECT station_id,
    regr_slope(trend, pos) FILTER (pos >= front AND pos < least(front + p, back)) AS fs,
    regr_intercept(trend, pos) FILTER (pos >= front AND pos < least(front + p, back)) AS fl,
    regr_slope(trend, pos) FILTER (pos >= greatest(front, back - p) AND pos < back) AS bs,
    regr_intercept(trend, pos) FILTER (pos >= greatest(front, back - p) AND pos < back) AS bl
  FROM de_e GROUP BY station_id),
de_x AS (
  SELECT station_id, time, x, p, n, pos % p AS phase,
    CASE WHEN n >= 2 * p AND pos < front THEN fl + fs * pos WHEN n >= 2 * p AND pos > back THEN bl + bs * pos ELSE trend END AS trend
  FROM de_e JOIN de_l USING (station_id)),
de_h AS (SELECT station_id, phase, avg(x - trend) AS m FROM de_x GROUP BY ALL),
de_c AS (SELECT station_id, phase, m - avg(m) OVER (PARTITION BY station_id) AS c FROM de_h),
de AS (SELECT station_id, time, x AS observed, trend, CASE WHEN n >= 2 * p THEN c ELSE 0 END AS seasonal,
              x - trend - CASE WHEN n >= 2 * p THEN c ELSE 0 END AS resid, CAST(p AS INTEGER) AS period
       FROM de_x JOIN de_c USING (station_id, phase))"""
)

_LAG_OVER = "OVER (PARTITION BY station_id ORDER BY time)"
PACF = (
    S.D
    + f""",
dv AS (SELECT station_id, time, temperature_2m_mean - avg(temperature_2m_mean) OVER (PARTITION BY station_id) AS x FROM d),
pr AS (SELECT station_id, [{", ".join(f"x * lag(x, {k}) {_LAG_OVER}" for k in range(41))}] AS p FROM dv),
sm AS (SELECT station_id, i, count(*) AS n, coalesce(sum(p[i]), 0) AS s FROM pr, (SELECT unnest(range(1, 42)) AS i) GROUP BY ALL),
cv AS (SELECT station_id, any_value(n) AS n, list(s / greatest(n - i + 1, 1) ORDER BY i) AS c FROM sm GROUP BY ALL),
dl AS (
  SELECT station_id, n, c, 0 AS lag, 1.0::DOUBLE AS pacf, []::DOUBLE[] AS phi, c[1] AS error FROM cv
  UNION ALL
  SELECT station_id, n, c, lag + 1, newest,
         list_append([phi[j] - newest * phi[len(phi) + 1 - j] FOR j IN range(1, len(phi) + 1)], newest), error * (1 - newest * newest)
  FROM (SELECT *, (c[lag + 2] - coalesce(list_sum([phi[j] * c[lag + 2 - j] FOR j IN range(1, lag + 1)]), 0)) / nullif(error, 0) AS newest
        FROM dl) WHERE lag < 40)"""
)


def query(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"
