"""Windows over the hourly panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.inputs import aqi_panel, events, feature_panel, panel, readings, sparse, target_panel
from hazeline.catalog.registry import query
from hazeline.functions.text import naive_hour_bucket
from hazeline.operators import features as Fe
from hazeline.operators import grid as G
from hazeline.operators import targets as T
from hazeline.schema import AQI_WINDOWS, FEATURES, TARGETS

KEY = ["city", "timestamp"]


def _select(df, names):
    return df.select(*KEY, *names)


def _sql(names, table="features", where=""):
    return f"SELECT city, timestamp, {', '.join(names)} FROM {table} {where}"


_FLAGSHIP = ["pm2_5_24h_mean", "pm10_24h_mean", "pm2_5_aqi", "pm10_aqi", "aqi_current", "aqi_category",
             "dominant_pollutant", *TARGETS]


@query("aqi_with_targets", _sql(_FLAGSHIP, "targets"), "pm2_5_24h_mean pm10_24h_mean")
def flagship(spark, folder):
    """Minimum slice: raw events to hourly panel, AQI, and look-ahead targets."""
    return _select(target_panel(spark, folder), _FLAGSHIP)


@query("w1_trailing_means", _sql(["pm2_5_24h_mean", "pm10_24h_mean"], "means"), "pm2_5_24h_mean pm10_24h_mean")
def trailing(spark, folder):
    return _select(T.trailing_means(panel(spark, folder)), ["pm2_5_24h_mean", "pm10_24h_mean"])


_W2 = ["pm2_5_aqi", "pm10_aqi", "aqi_current", "aqi_category", "dominant_pollutant"]


@query("w2_current_aqi", _sql(_W2, "named"))
def current(spark, folder):
    return _select(aqi_panel(spark, folder), _W2)


@query("w3_future_targets", _sql(["aqi_current", *TARGETS], "targets"))
def targets(spark, folder):
    return _select(target_panel(spark, folder), ["aqi_current", *TARGETS])


@query("w3_gapped_panel", f"""
SELECT city, timestamp, m25 AS pm2_5_24h_mean, aqi::INT AS aqi_current,
  (CASE WHEN lead(timestamp, 24) OVER w = timestamp + INTERVAL 24 HOUR THEN lead(aqi, 24) OVER w END)::INT AS target_aqi_24h
FROM (SELECT *, greatest({S.pm25_index('m25')}, {S.pm10_index('m10')}) AS aqi FROM (
  SELECT city, timestamp, CASE WHEN whole THEN CAST(s25 AS DOUBLE) / 24::DOUBLE END AS m25, CASE WHEN whole THEN CAST(s10 AS DOUBLE) / 24::DOUBLE END AS m10
  FROM (SELECT city, timestamp, sum(pm2_5) OVER f AS s25, sum(pm10) OVER f AS s10,
          count(*) OVER f = 24 AND min(timestamp) OVER f = timestamp - INTERVAL 23 HOUR AS whole
        FROM sparse WINDOW f AS (PARTITION BY city ORDER BY timestamp ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))))
WINDOW w AS (PARTITION BY city ORDER BY timestamp)""", "pm2_5_24h_mean")
def gapped(spark, folder):
    """The panel with its absent hours: whatever a gap touches is NULL, never the value of another hour."""
    rows = T.build_targets(sparse(spark, folder), on_gap="trust")
    return rows.select("city", "timestamp", "pm2_5_24h_mean", F.col("aqi_current").cast("int").alias("aqi_current"),
                       F.col("target_aqi_24h").cast("int").alias("target_aqi_24h"))


_COMPLETE = "WHERE aqi_current IS NOT NULL AND target_aqi_24h IS NOT NULL AND target_aqi_48h IS NOT NULL AND target_aqi_72h IS NOT NULL"


@query("w4_complete_targets", _sql(["aqi_current", *TARGETS], "targets", _COMPLETE))
def complete(spark, folder):
    return _select(T.complete_targets(target_panel(spark, folder)), ["aqi_current", *TARGETS])


@query("w5_build_summary", f"""
SELECT count(*) AS input_rows, count(*) FILTER ({_COMPLETE}) AS output_rows, count(DISTINCT city) AS cities,
  count(aqi_current) AS rows_with_current_aqi,
  count(*) FILTER (WHERE target_aqi_24h IS NOT NULL AND target_aqi_48h IS NOT NULL AND target_aqi_72h IS NOT NULL)
    AS rows_with_all_targets FROM targets""")
def summary(spark, folder):
    return T.build_summary(target_panel(spark, folder), drop_incomplete=True)


_W6 = [f"aqi_lag_{n}h" for n in (1, 3, 6, 12, 24, 48, 72)]
_W7 = [f"{p}_lag_{n}h" for p in ("pm2_5", "pm10") for n in (1, 3, 6, 24)]
_W8 = [f"aqi_rolling_mean_{n}h" for n in AQI_WINDOWS]
_W9 = [f"aqi_rolling_std_{n}h" for n in AQI_WINDOWS]
_W10 = [f"{p}_rolling_mean_{n}h" for p in ("pm2_5", "pm10") for n in (6, 24)]
_W11 = ["aqi_change_1h", "aqi_change_3h", "aqi_change_24h", "pm2_5_change_1h", "pm10_change_1h"]
_W12 = ["hour", "day_of_week", "month", "is_weekend"]
_W13 = ["hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos"]
_W14 = ["wind_direction_sin", "wind_direction_cos"]
_W15 = ["temp_humidity_interaction", "stagnation_index"]


@query("w6_aqi_lags", _sql(_W6))
def aqi_lags(spark, folder):
    return _select(feature_panel(spark, folder), _W6)


@query("w7_pm_lags", _sql(_W7), " ".join(_W7))
def pm_lags(spark, folder):
    return _select(feature_panel(spark, folder), _W7)


@query("w8_aqi_rolling_mean", _sql(_W8), " ".join(_W8))
def aqi_means(spark, folder):
    return _select(feature_panel(spark, folder), _W8)


@query("w9_aqi_rolling_std", _sql(_W9), " ".join(_W9))
def aqi_stds(spark, folder):
    return _select(feature_panel(spark, folder), _W9)


@query("w10_pm_rolling_mean", _sql(_W10), " ".join(_W10))
def pm_means(spark, folder):
    return _select(feature_panel(spark, folder), _W10)


@query("w11_changes", _sql(_W11), "pm2_5_change_1h pm10_change_1h")
def changes(spark, folder):
    return _select(feature_panel(spark, folder), _W11)


@query("w12_calendar", _sql(_W12))
def calendar(spark, folder):
    return _select(panel(spark, folder).withColumns(Fe.calendar_columns()), _W12)


@query("w13_cyclic", _sql(_W13), " ".join(_W13))
def cyclic(spark, folder):
    return _select(panel(spark, folder).withColumns(Fe.cyclic_columns()), _W13)


@query("w14_wind_direction", _sql(_W14), " ".join(_W14))
def wind(spark, folder):
    return _select(panel(spark, folder).withColumns(Fe.weather_columns()), _W14)


@query("w15_weather_products", _sql(_W15), " ".join(_W15))
def products(spark, folder):
    return _select(panel(spark, folder).withColumns(Fe.weather_columns()), _W15)


@query("w16_model_projection", _sql(FEATURES), " ".join(FEATURES))
def projection(spark, folder):
    return Fe.model_projection(feature_panel(spark, folder))


_W17 = "WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, *TARGETS])


@query("w17_complete_rows", _sql([*FEATURES, *TARGETS], "features", _W17), " ".join([*FEATURES, *TARGETS]))
def complete_rows(spark, folder):
    rows = Fe.complete_rows(feature_panel(spark, folder))
    return Fe.model_projection(rows, *[F.col(t).cast("double").alias(t) for t in TARGETS])


@query("w18_newest_feature_row", f"""
SELECT city, timestamp, aqi_current, {', '.join(FEATURES)} FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM features WHERE aqi_current IS NOT NULL)
WHERE rn = 1""", " ".join(FEATURES))
def newest(spark, folder):
    return Fe.model_projection(Fe.newest_features(panel(spark, folder)), "aqi_current")


@query("w19_hour_bucket", "SELECT event_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour FROM events")
def bucket(spark, folder):
    return events(spark, folder).select("event_id", naive_hour_bucket(F.col("ts")).alias("hour"))


@query("w20_hours_behind", """
SELECT p.city, reading, latest_history, date_diff('hour', latest_history, reading)::BIGINT AS gap_hours
FROM (SELECT city, max(timestamp) AS reading FROM sparse GROUP BY city) p
LEFT JOIN (SELECT city, max(timestamp) AS latest_history FROM panel
  WHERE timestamp < TIMESTAMP '2024-01-29 00:00:00' GROUP BY city) h USING (city)""")
def behind(spark, folder):
    stored = panel(spark, folder).where(F.col("timestamp") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    return G.hours_behind(stored, sparse(spark, folder))


@query("w21_target_alignment", """
WITH long AS (
  SELECT city, timestamp, 24 AS horizon_hours, target_aqi_24h AS value FROM targets
  UNION ALL SELECT city, timestamp, 48, target_aqi_48h FROM targets
  UNION ALL SELECT city, timestamp, 72, target_aqi_72h FROM targets)
SELECT l.horizon_hours, count(*) AS checked,
  count(*) FILTER (WHERE a.aqi_current IS NULL OR abs(l.value - a.aqi_current) > 1e-9) AS mismatches
FROM long l LEFT JOIN named a ON a.city = l.city AND a.timestamp = l.timestamp + to_hours(l.horizon_hours)
WHERE l.value IS NOT NULL GROUP BY l.horizon_hours""")
def alignment(spark, folder):
    return T.target_alignment(target_panel(spark, folder))


@query("w22_boundary_leaks", """
SELECT city, count(*) FILTER (WHERE rn <= 24 AND target_aqi_24h IS NOT NULL) AS leaks_24h,
  count(*) FILTER (WHERE rn <= 48 AND target_aqi_48h IS NOT NULL) AS leaks_48h,
  count(*) FILTER (WHERE rn <= 72 AND target_aqi_72h IS NOT NULL) AS leaks_72h
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM targets) GROUP BY city""")
def leaks(spark, folder):
    return T.boundary_leaks(target_panel(spark, folder))


@query("w23_warm_up", """
SELECT city, count(*) FILTER (WHERE rn <= 23 AND aqi_current IS NOT NULL) AS early_aqi,
  count(*) FILTER (WHERE rn = 24 AND aqi_current IS NOT NULL) AS first_aqi
FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp) AS rn FROM named) GROUP BY city""")
def warm_up(spark, folder):
    return T.warm_up(aqi_panel(spark, folder))


@query("w23_feature_warm_up", f"""
SELECT city, source_start, first_usable, coalesce(first_usable >= source_start + INTERVAL 72 HOUR, false) AS passed
FROM (SELECT city, min(timestamp) AS source_start FROM panel GROUP BY city)
LEFT JOIN (SELECT city, min(timestamp) AS first_usable FROM features {_W17} GROUP BY city) USING (city)""")
def feature_warm_up(spark, folder):
    return T.feature_warm_up(panel(spark, folder), Fe.complete_rows(feature_panel(spark, folder)))


@query("w24_feature_summary", """
SELECT count(*) AS input_rows, count(*) AS output_rows, count(DISTINCT city) AS cities, 56 AS feature_count FROM features""")
def feature_summary(spark, folder):
    return Fe.feature_summary(panel(spark, folder), feature_panel(spark, folder))


_GAPS = """
SELECT city, previous, timestamp AS current, date_diff('second', previous, timestamp) / 3600::DOUBLE AS gap_hours
FROM (SELECT city, timestamp, lag(timestamp) OVER (PARTITION BY city ORDER BY timestamp) AS previous FROM {t})
WHERE previous IS NOT NULL AND timestamp <> previous + INTERVAL 1 HOUR"""


@query("v7_gaps", _GAPS.format(t="sparse"), "gap_hours")
def gaps(spark, folder):
    return G.gaps(sparse(spark, folder))


@query("v7_first_gaps", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY current)::INT AS gap_number
  FROM ({_GAPS.format(t='sparse')})) WHERE gap_number <= 5""", "gap_hours")
def first_gaps(spark, folder):
    return G.first_gaps(sparse(spark, folder))


@query("v7_gap_counts", f"""
SELECT city, count(*) AS non_hourly_gaps FROM ({_GAPS.format(t='readings')}) GROUP BY city""")
def gap_counts(spark, folder):
    """Raw readings repeat hours, which counts as a non-hourly step too."""
    return G.gap_counts(readings(spark, folder))


@query("v7_continuity", """
SELECT city, sum(n)::BIGINT AS rows, count(*) AS distinct_hours, min(timestamp) AS start, max(timestamp) AS "end",
  sum(n) = count(*) AND date_diff('hour', min(timestamp), max(timestamp)) + 1 = count(*) AS continuous
FROM (SELECT city, timestamp, count(*) AS n FROM sparse GROUP BY city, timestamp) GROUP BY city""")
def continuity(spark, folder):
    return G.continuity(sparse(spark, folder))


@query("v7_missing_hours", """
SELECT s.city, s.timestamp FROM spine s LEFT JOIN sparse p USING (city, timestamp) WHERE p.pm2_5 IS NULL""")
def missing_hours(spark, folder):
    return G.missing_hours(sparse(spark, folder))
