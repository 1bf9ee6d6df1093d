"""Names, fixed lists and table schemas."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

KEYS = ["city", "timestamp"]
HORIZONS = (24, 48, 72)
TARGETS = [f"target_aqi_{h}h" for h in HORIZONS]

# Ordered category names.
CATEGORY_ORDER = [
    "Good",
    "Moderate",
    "Unhealthy for Sensitive Groups",
    "Unhealthy",
    "Very Unhealthy",
    "Hazardous",
]
SHORT_CATEGORY_ORDER = ["Good", "Moderate", "USG", "Unhealthy", "Very Unhealthy", "Hazardous"]

POLLUTANTS = ["pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone"]
POLLUTANTS_WITH_DUST = [*POLLUTANTS, "dust"]
WEATHER = ["temperature", "humidity", "precipitation", "wind_speed", "wind_direction", "pressure"]
PANEL_COLUMNS = ["timestamp", "city", "latitude", "longitude", *POLLUTANTS, *WEATHER]
CANONICAL_COLUMNS = ["timestamp", "city", "latitude", "longitude", *POLLUTANTS_WITH_DUST, *WEATHER]
HISTORY_COLUMNS = ["timestamp", "city", "latitude", "longitude", *WEATHER, *POLLUTANTS, "source"]
NON_NEGATIVE = ["precipitation", "wind_speed", *POLLUTANTS]

AQI_LAGS = (1, 3, 6, 12, 24, 48, 72)
PM_LAGS = (1, 3, 6, 24)
AQI_WINDOWS = (3, 6, 12, 24)
PM_WINDOWS = (6, 24)
AQI_CHANGES = (1, 3, 24)

# The 24 base columns, in model order.
BASE_FEATURES = [
    "latitude", "longitude", "temperature", "humidity", "precipitation", "wind_speed", "pressure",
    "pm2_5", "pm10", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone",
    "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "is_weekend",
    "wind_direction_sin", "wind_direction_cos", "temp_humidity_interaction", "stagnation_index",
]
FEATURES = (
    BASE_FEATURES
    + [f"aqi_lag_{n}h" for n in AQI_LAGS]
    + [f"{p}_lag_{n}h" for p in ("pm2_5", "pm10") for n in PM_LAGS]
    + [f"aqi_rolling_mean_{n}h" for n in AQI_WINDOWS]
    + [f"aqi_rolling_std_{n}h" for n in AQI_WINDOWS]
    + [f"{p}_rolling_mean_{n}h" for p in ("pm2_5", "pm10") for n in PM_WINDOWS]
    + [f"aqi_change_{n}h" for n in AQI_CHANGES]
    + ["pm2_5_change_1h", "pm10_change_1h"]
)

# Accepted range per numeric column, (minimum, maximum).
RANGE_RULES = {
    "pm10": (0, None),
    "pm2_5": (0, None),
    "carbon_monoxide": (0, None),
    "nitrogen_dioxide": (0, None),
    "sulphur_dioxide": (0, None),
    "ozone": (0, None),
    "dust": (0, None),
    "humidity": (0, 100),
    "precipitation": (0, None),
    "wind_speed": (0, None),
    "wind_direction": (0, 360),
    "pressure": (800, 1200),
}

# City name, latitude, longitude.
CITIES = [
    ("Faisalabad", 31.4504, 73.1350),
    ("Islamabad", 33.6844, 73.0479),
    ("Karachi", 24.8607, 67.0011),
    ("Lahore", 31.5204, 74.3587),
    ("Multan", 30.1575, 71.5249),
    ("Peshawar", 34.0151, 71.5249),
    ("Quetta", 30.1798, 66.9750),
    ("Rahim Yar Khan", 28.4212, 70.2989),
    ("Sialkot", 32.4945, 74.5229),
]

PANEL_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType()), T.StructField("city", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in CANONICAL_COLUMNS[2:]]
)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("city", T.StringType()),
        T.StructField("forecast_created_at", T.TimestampType()),
        T.StructField("target_timestamp", T.TimestampType()),
        T.StructField("horizon_hours", T.IntegerType()),
        T.StructField("predicted_aqi", T.DoubleType()),
        T.StructField("predicted_category", T.StringType()),
        T.StructField("model_name", T.StringType()),
        T.StructField("model_alias", T.StringType()),
        T.StructField("actual_aqi", T.DoubleType()),
        T.StructField("actual_category", T.StringType()),
        T.StructField("absolute_error", T.DoubleType()),
        T.StructField("category_correct", T.BooleanType()),
        T.StructField("category_distance", T.IntegerType()),
        T.StructField("adjacent_category_correct", T.BooleanType()),
        T.StructField("evaluated_at", T.TimestampType()),
    ]
)
LEDGER_COLUMNS = LEDGER_SCHEMA.fieldNames()
LEDGER_KEYS = ["city", "forecast_created_at", "horizon_hours"]


def city_dimension(spark: SparkSession) -> DataFrame:
    """Nine cities with coordinates."""
    return spark.createDataFrame(CITIES, "city string, latitude double, longitude double")


def missing_columns(df: DataFrame, names) -> list[str]:
    return sorted(set(names) - set(df.columns))


def require_columns(df: DataFrame, names, what: str = "input") -> DataFrame:
    """V1: names are known on the driver, so the check costs no job."""
    missing = missing_columns(df, names)
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def is_ntz(df: DataFrame, name: str = "timestamp") -> bool:
    return isinstance(df.schema[name].dataType, T.TimestampNTZType)


def all_present(names: list[str]) -> Column:
    """Every named column is known.

    Separate IS NOT NULL conjuncts, not one ``dropna`` predicate over all columns: the optimizer derives a copy of a
    predicate for every computed column it mentions, which doubles a wide predicate with each of them.
    """
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row frames with different columns side by side, without a join."""
    stacked = first
    for other in others:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return stacked.agg(*[F.first(c, ignorenulls=True).alias(c) for c in stacked.columns])


def epoch_seconds(col: Column) -> Column:
    """Whole seconds since 1970 for TIMESTAMP and TIMESTAMP_NTZ alike (session zone UTC)."""
    return F.unix_seconds(col.cast("timestamp"))


def epoch_hours(col: Column) -> Column:
    return F.floor(epoch_seconds(col) / F.lit(3600)).cast("long")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def long_form(df: DataFrame, ids: list[str], columns: list[str], name: str, value: str, as_type: str | None = None):
    """Unpivot ``columns``; ``as_type`` gives them one common type first."""
    if as_type:
        df = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in columns])
    return df.unpivot(ids, columns, name, value)
