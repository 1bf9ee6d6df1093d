"""SQL building blocks of the twins: the panel and what derives from it, as common table expressions."""

from __future__ import annotations

from hazeline.functions.aqi import PM10_BANDS, PM25_BANDS
from hazeline.plans.panel import STATIONS
from hazeline.schema import AQI_CHANGES, AQI_LAGS, AQI_WINDOWS, CATEGORY_ORDER, PM_LAGS, PM_WINDOWS, SHORT_CATEGORY_ORDER


def sub_index(c: str, bands) -> str:
    arms = " ".join(
        f"WHEN {c} <= {hi}::DOUBLE THEN round_even((({ihi}::DOUBLE - {ilo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE))"
        f" * ({c} - {lo}::DOUBLE) + {ilo}::DOUBLE, 0)::INT"
        for lo, hi, ilo, ihi in bands
    )
    return f"CASE WHEN {c} IS NULL OR {c} < 0 THEN NULL {arms} ELSE 500 END"


def pm25_index(c: str) -> str:
    return sub_index(f"(floor(({c}) * 10) / 10::DOUBLE)", PM25_BANDS)


def pm10_index(c: str) -> str:
    return sub_index(f"floor({c})", PM10_BANDS)


def category(x: str, names=CATEGORY_ORDER) -> str:
    g = [n.replace("'", "''") for n in names]
    return (
        f"CASE WHEN {x} IS NULL OR {x} < 0 THEN NULL WHEN {x} <= 50 THEN '{g[0]}' WHEN {x} <= 100 THEN '{g[1]}' "
        f"WHEN {x} <= 150 THEN '{g[2]}' WHEN {x} <= 200 THEN '{g[3]}' WHEN {x} <= 300 THEN '{g[4]}' ELSE '{g[5]}' END"
    )


def short_category(x: str) -> str:
    return category(x, SHORT_CATEGORY_ORDER)


def clip(x: str) -> str:
    return f"least(greatest(CAST({x} AS DOUBLE), 0::DOUBLE), 500::DOUBLE)"


def prediction_category(x: str) -> str:
    return category(f"round_even({clip(x)}, 0)::INT")


def rank_of(c: str) -> str:
    arms = " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(CATEGORY_ORDER, 1))
    return f"(CASE {c} {arms} END)::INT"


def _coordinate(i: int) -> str:
    return "CASE city " + " ".join(f"WHEN '{s[0]}' THEN {s[i]}::DOUBLE" for s in STATIONS) + " END"


_SHAPE = f"""
  {_coordinate(1)} AS latitude, {_coordinate(2)} AS longitude,
  coalesce(v_min, 0)::DECIMAL(18,2) AS pm2_5, coalesce(v_max, 0)::DECIMAL(18,2) AS pm10,
  coalesce(v_sum, 0)::DECIMAL(18,2) AS carbon_monoxide, coalesce(k_max, 0)::INT AS nitrogen_dioxide,
  coalesce(k_min, 0)::INT AS sulphur_dioxide, coalesce(users, 0)::BIGINT AS ozone,
  (coalesce(u_sum, 0) % 40)::INT AS temperature, (coalesce(k_sum, 0) % 101)::INT AS humidity, 0::INT AS precipitation,
  coalesce(n, 0)::BIGINT AS wind_speed, (coalesce(e_sum, 0) % 360)::INT AS wind_direction,
  (1000 + coalesce(k_sum, 0) % 50)::INT AS pressure"""


def _lags() -> str:
    cols = [f"lag(aqi_current, {n}) OVER w AS aqi_lag_{n}h" for n in AQI_LAGS]
    cols += [f"lag({p}, {n}) OVER w AS {p}_lag_{n}h" for p in ("pm2_5", "pm10") for n in PM_LAGS]
    return ",\n  ".join(cols)


def _frame(n: int) -> str:
    return f"(PARTITION BY city ORDER BY timestamp ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def rolling_mean(c: str, n: int) -> str:
    f = _frame(n)
    return f"CASE WHEN count({c}) OVER {f} = {n} THEN CAST(sum({c}) OVER {f} AS DOUBLE) / {n}::DOUBLE END"


def rolling_std(c: str, n: int) -> str:
    f = _frame(n)
    s, q = f"CAST(sum({c}) OVER {f} AS DOUBLE)", f"CAST(sum({c}::BIGINT * {c}::BIGINT) OVER {f} AS DOUBLE)"
    return f"CASE WHEN count({c}) OVER {f} = {n} THEN sqrt(greatest({n} * {q} - {s} * {s}, 0) / ({n} * ({n} - 1))) END"


def _rolling() -> str:
    cols = [f"{rolling_mean('aqi_current', n)} AS aqi_rolling_mean_{n}h" for n in AQI_WINDOWS]
    cols += [f"{rolling_std('aqi_current', n)} AS aqi_rolling_std_{n}h" for n in AQI_WINDOWS]
    cols += [f"{rolling_mean(p, n)} AS {p}_rolling_mean_{n}h" for p in ("pm2_5", "pm10") for n in PM_WINDOWS]
    return ",\n  ".join(cols)


def _changes() -> str:
    cols = [f"aqi_current - lag(aqi_current, {n}) OVER w AS aqi_change_{n}h" for n in AQI_CHANGES]
    cols += [f"{p} - lag({p}, 1) OVER w AS {p}_change_1h" for p in ("pm2_5", "pm10")]
    return ",\n  ".join(cols)


CALENDAR = """
  date_part('hour', timestamp)::INT AS hour, (date_part('isodow', timestamp) - 1)::INT AS day_of_week,
  date_part('month', timestamp)::INT AS month, (date_part('isodow', timestamp) >= 6)::INT AS is_weekend"""
CYCLIC = """
  sin(2 * pi() * date_part('hour', timestamp) / 24) AS hour_sin, cos(2 * pi() * date_part('hour', timestamp) / 24) AS hour_cos,
  sin(2 * pi() * (date_part('isodow', timestamp) - 1) / 7) AS day_of_week_sin,
  cos(2 * pi() * (date_part('isodow', timestamp) - 1) / 7) AS day_of_week_cos,
  sin(2 * pi() * date_part('month', timestamp) / 12) AS month_sin, cos(2 * pi() * date_part('month', timestamp) / 12) AS month_cos"""
WEATHER = """
  sin(radians(wind_direction::DOUBLE)) AS wind_direction_sin, cos(radians(wind_direction::DOUBLE)) AS wind_direction_cos,
  temperature::DOUBLE * humidity::DOUBLE AS temp_humidity_interaction,
  humidity::DOUBLE / (wind_speed::DOUBLE + 1::DOUBLE) AS stagnation_index"""

PRELUDE = f"""
WITH readings AS (
  SELECT event_type AS city, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS timestamp, ts, event_id, user_id,
    CAST(value AS DECIMAL(18,2)) AS value, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k
  FROM events),
spine AS (
  SELECT event_type AS city, unnest(generate_series(CAST(date_trunc('day', min(ts)) AS TIMESTAMP),
    CAST(date_trunc('day', max(ts)) AS TIMESTAMP) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS timestamp
  FROM events GROUP BY event_type),
hourly AS (
  SELECT city, timestamp, min(value) AS v_min, max(value) AS v_max, sum(value) AS v_sum, max(k) AS k_max, min(k) AS k_min,
    count(DISTINCT user_id) AS users, count(*) AS n, sum(k) AS k_sum, sum(user_id) AS u_sum, sum(event_id) AS e_sum
  FROM readings GROUP BY city, timestamp),
sparse AS (SELECT city, timestamp, {_SHAPE} FROM hourly),
panel AS (SELECT city, timestamp, {_SHAPE} FROM spine LEFT JOIN hourly USING (city, timestamp)),
dirty AS (
  SELECT city, timestamp, event_id,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -value ELSE value END AS pm2_5,
    CASE WHEN event_id % 83 = 0 THEN -value ELSE value + k END AS pm10,
    k AS carbon_monoxide, k AS nitrogen_dioxide, user_id % 50 AS sulphur_dioxide, value AS ozone, k AS dust,
    user_id % 40 AS temperature, k + 3 AS humidity, 0 AS precipitation, k % 20 AS wind_speed,
    event_id % 370 AS wind_direction, 790 + k AS pressure, {_coordinate(1)} AS latitude, {_coordinate(2)} AS longitude
  FROM readings),
means AS (
  SELECT *, {rolling_mean('pm2_5', 24)} AS pm2_5_24h_mean, {rolling_mean('pm10', 24)} AS pm10_24h_mean FROM panel),
indices AS (
  SELECT *, {pm25_index('pm2_5_24h_mean')} AS pm2_5_aqi, {pm10_index('pm10_24h_mean')} AS pm10_aqi FROM means),
aqi AS (
  SELECT *, CASE WHEN pm2_5_aqi IS NOT NULL AND pm10_aqi IS NOT NULL THEN greatest(pm2_5_aqi, pm10_aqi) END AS aqi_current,
    CASE WHEN pm2_5_aqi >= pm10_aqi THEN 'pm2_5' WHEN pm2_5_aqi < pm10_aqi THEN 'pm10' END AS dominant_pollutant
  FROM indices),
named AS (SELECT *, {category('aqi_current')} AS aqi_category FROM aqi),
targets AS (
  SELECT *, lead(aqi_current, 24) OVER w AS target_aqi_24h, lead(aqi_current, 48) OVER w AS target_aqi_48h,
    lead(aqi_current, 72) OVER w AS target_aqi_72h
  FROM named WINDOW w AS (PARTITION BY city ORDER BY timestamp)),
features AS (
  SELECT *, {_lags()},
  {_rolling()},
  {_changes()},
  {CALENDAR}, {CYCLIC}, {WEATHER}
  FROM targets WINDOW w AS (PARTITION BY city ORDER BY timestamp)),
forecasts AS (
  SELECT city, timestamp, 24 AS horizon_hours, target_aqi_24h AS y, aqi_current, aqi_rolling_mean_24h FROM features
  UNION ALL SELECT city, timestamp, 48, target_aqi_48h, aqi_current, aqi_rolling_mean_24h FROM features
  UNION ALL SELECT city, timestamp, 72, target_aqi_72h, aqi_current, aqi_rolling_mean_24h FROM features),
predictions AS (
  SELECT city, timestamp, horizon_hours, 'persistence' AS model, y::DOUBLE AS y_true, aqi_current::DOUBLE AS prediction
  FROM forecasts WHERE y IS NOT NULL AND aqi_current IS NOT NULL
  UNION ALL SELECT city, timestamp, horizon_hours, 'mean_24h', y::DOUBLE, aqi_rolling_mean_24h
  FROM forecasts WHERE y IS NOT NULL AND aqi_rolling_mean_24h IS NOT NULL)"""
