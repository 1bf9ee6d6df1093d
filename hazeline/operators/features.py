"""The 56 model features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.exact import exact, std_of
from hazeline.operators.grid import BLOCK_HOURS, at_hour, block_window, drop_halo, full_window, with_halo
from hazeline.operators.targets import MEAN_HOURS, current_aqi, future_targets, gate, recent_rows, trailing_means
from hazeline.schema import (
    AQI_CHANGES,
    AQI_LAGS,
    AQI_WINDOWS,
    FEATURES,
    HORIZONS,
    PANEL_COLUMNS,
    PM_LAGS,
    PM_WINDOWS,
    TARGETS,
    all_present,
    one_row,
    require_columns,
)

FEATURE_LOOKBACK = max(AQI_LAGS)


def lag_columns(w) -> dict:
    """W6, W7."""
    cols = {f"aqi_lag_{n}h": at_hour("aqi_current", n, w) for n in AQI_LAGS}
    cols.update({f"{p}_lag_{n}h": at_hour(p, n, w) for p in ("pm2_5", "pm10") for n in PM_LAGS})
    return cols


def aqi_mean_columns(w) -> dict:
    """The index is an integer, so its sum is exact as it stands."""
    x = F.col("aqi_current").cast("long")
    return {
        f"aqi_rolling_mean_{n}h": full_window(
            x, n, w, lambda frame, n=n: F.sum(x).over(frame).cast("double") / F.lit(float(n))
        )
        for n in AQI_WINDOWS
    }


def aqi_std_columns(w) -> dict:
    """Sample spread from integer sums."""
    x = F.col("aqi_current").cast("long")
    return {
        f"aqi_rolling_std_{n}h": full_window(
            x,
            n,
            w,
            lambda frame, n=n: std_of(F.lit(n), F.sum(x).over(frame), F.sum(x * x).over(frame)),
        )
        for n in AQI_WINDOWS
    }


def pm_mean_columns(w) -> dict:
    """W10."""
    return {
        f"{p}_rolling_mean_{n}h": full_window(
            exact(F.col(p)),
            n,
            w,
            lambda frame, p=p, n=n: F.sum(exact(F.col(p))).over(frame).cast("double") / F.lit(float(n)),
        )
        for p in ("pm2_5", "pm10")
        for n in PM_WINDOWS
    }


def change_columns(w) -> dict:
    """W11."""
    cols = {f"aqi_change_{n}h": F.col("aqi_current") - at_hour("aqi_current", n, w) for n in AQI_CHANGES}
    cols.update({f"{p}_change_1h": F.col(p) - at_hour(p, 1, w) for p in ("pm2_5", "pm10")})
    return cols


def calendar_columns() -> dict:
    """Monday is day 0."""
    t = F.col("timestamp")
    return {
        "hour": F.hour(t),
        "day_of_week": F.weekday(t),
        "month": F.month(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    }


def cyclic_columns() -> dict:
    """W13."""
    t = F.col("timestamp")
    parts = {"hour": (F.hour(t), 24), "day_of_week": (F.weekday(t), 7), "month": (F.month(t), 12)}
    cols = {}
    for name, (part, period) in parts.items():
        angle = F.lit(2 * math.pi) * part / F.lit(float(period))
        cols[f"{name}_sin"] = F.sin(angle)
        cols[f"{name}_cos"] = F.cos(angle)
    return cols


def weather_columns() -> dict:
    """W14, W15."""
    wind = F.radians(F.col("wind_direction").cast("double"))
    humidity = F.col("humidity").cast("double")
    return {
        "wind_direction_sin": F.sin(wind),
        "wind_direction_cos": F.cos(wind),
        "temp_humidity_interaction": F.col("temperature").cast("double") * humidity,
        "stagnation_index": humidity / (F.col("wind_speed").cast("double") + F.lit(1.0)),
    }


def row_features(df: DataFrame) -> DataFrame:
    """Everything that needs only its own row."""
    return df.withColumns({**calendar_columns(), **cyclic_columns(), **weather_columns()})


def window_features(df: DataFrame, w) -> DataFrame:
    return df.withColumns(
        {**lag_columns(w), **aqi_mean_columns(w), **aqi_std_columns(w), **pm_mean_columns(w), **change_columns(w)}
    )


def engineer(df: DataFrame, on_gap: str = "trust", block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Features on a panel that already carries ``aqi_current``."""
    require_columns(df, [*PANEL_COLUMNS, "aqi_current"], "feature input")
    blocked = with_halo(gate(df, on_gap), FEATURE_LOOKBACK, 0, block_hours)
    return row_features(drop_halo(window_features(blocked, block_window())))


def build_features(df: DataFrame, on_gap: str = "trust", block_hours: int = BLOCK_HOURS) -> DataFrame:
    """Raw panel to AQI, targets and features in a single shuffle on (city, block)."""
    require_columns(df, PANEL_COLUMNS, "feature input")
    w = block_window()
    blocked = with_halo(gate(df, on_gap), MEAN_HOURS - 1 + FEATURE_LOOKBACK, max(HORIZONS), block_hours)
    out = current_aqi(trailing_means(blocked, w))
    out = drop_halo(window_features(future_targets(out, w), w))
    return row_features(out)


def model_projection(df: DataFrame, *extra: str) -> DataFrame:
    """The ordered 56-column contract as DOUBLE, after ``city``, ``timestamp`` and ``extra``."""
    if len(FEATURES) != 56 or len(set(FEATURES)) != 56:
        raise ValueError("the feature contract must be 56 distinct names")
    require_columns(df, FEATURES, "model input")
    return df.select("city", "timestamp", *extra, *[F.col(c).cast("double").alias(c) for c in FEATURES])


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with every feature and every target."""
    return df.where(all_present([*FEATURES, *TARGETS]))


def latest_per_city(df: DataFrame) -> DataFrame:
    """Newest row with AQI per city; a maximum combines before the shuffle, a ranking would not."""
    row = F.struct("timestamp", *[c for c in df.columns if c not in ("city", "timestamp")])
    newest = df.where(F.col("aqi_current").isNotNull()).groupBy("city").agg(F.max_by(row, F.col("timestamp")).alias("_r"))
    return newest.select("city", "_r.*").select(*df.columns)


def newest_features(df: DataFrame, on_gap: str = "trust") -> DataFrame:
    """W18 from a raw panel: what ``latest_per_city`` finds among all features, built from each city's newest hours alone."""
    recent = recent_rows(gate(df, on_gap), 1, MEAN_HOURS - 1 + FEATURE_LOOKBACK)
    return latest_per_city(build_features(recent))


def feature_summary(source: DataFrame, features: DataFrame) -> DataFrame:
    """W24 summary: rows in and out, cities, feature count."""
    counted = features.agg(F.count("*").alias("output_rows"), F.count_distinct("city").alias("cities"))
    total = source.agg(F.count("*").alias("input_rows"))
    return one_row(total, counted).withColumn("feature_count", F.lit(len(FEATURES)))
