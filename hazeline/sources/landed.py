"""Files in, files out. Payload readers take a DataFrame with the JSON text of each landed file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, types as T
from pyspark.sql import functions as F

from hazeline.functions.aqi import nan_to_null
from hazeline.operators.ledger import normalise
from hazeline.schema import KEYS, LEDGER_SCHEMA, PANEL_SCHEMA, require_columns

# Source variable names and the panel names they become.
WEATHER_NAMES = {
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "precipitation": "precipitation",
    "wind_speed_10m": "wind_speed",
    "wind_direction_10m": "wind_direction",
    "pressure_msl": "pressure",
}
LIVE_WEATHER_NAMES = {**{k: v for k, v in WEATHER_NAMES.items() if k != "pressure_msl"}, "surface_pressure": "pressure"}
POLLUTION_NAMES = {
    c: c
    for c in ("pm10", "pm2_5", "carbon_monoxide", "nitrogen_dioxide", "sulphur_dioxide", "ozone", "dust")
}


def _names_of_csv(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType = PANEL_SCHEMA) -> DataFrame:
    """The header decides which schema fields are read; a missing path is an error from the reader."""
    names = _names_of_csv(spark, path)
    kinds = {f.name: f.dataType for f in schema}
    present = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    return _without_nan(spark.read.option("header", True).schema(present).csv(path))


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, for the validation report."""
    return spark.read.option("header", True).csv(path)


def _without_nan(df: DataFrame) -> DataFrame:
    return df.select(
        *[nan_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
          for f in df.schema]
    )


def read_panel(spark: SparkSession, path: str, sort: bool = False) -> DataFrame:
    """Parquet panel with UTC timestamps and no NaN. Sorting is for sinks, so it is off unless asked for."""
    df = spark.read.parquet(path)
    if isinstance(df.schema["timestamp"].dataType, T.StringType):
        df = df.withColumn("timestamp", F.to_timestamp("timestamp"))
    df = _without_nan(df)
    return df.orderBy(*KEYS) if sort else df


def write_panel(df: DataFrame, path: str, by: list[str] = ("city",), mode: str = "overwrite") -> None:
    """S3: partitioned Parquet, sorted inside each file so that row-group statistics prune by time.

    The rebalance hint gathers each partition's rows into few files and lets adaptive execution split the large ones:
    one city may hold a large share of all rows.
    """
    spread = df.hint("rebalance", *by)
    spread.sortWithinPartitions(*by, "timestamp").write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S4."""
    df.write.mode(mode).option("header", True).csv(path)


# S5 ---------------------------------------------------------------------------------------------------------------


def hourly_rows(df: DataFrame, names: dict[str, str], payload: str = "payload", keep: list[str] = ("city",)) -> DataFrame:
    """``{"hourly": {"time": [...], "x": [...]}}`` to one row per hour with the panel's names.

    A time that can't be read gives a NULL timestamp, which the builds' checks name; it does not end the job.
    """
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]
    schema = T.StructType([T.StructField("hourly", T.StructType(arrays))])
    parsed = df.select(*keep, F.from_json(payload, schema).alias("_p"))
    zipped = F.arrays_zip(F.col("_p.hourly.time").alias("time"), *[F.col(f"_p.hourly.{n}").alias(n) for n in names])
    return parsed.select(*keep, F.explode(zipped).alias("_r")).select(
        *keep, F.try_to_timestamp("_r.time").alias("timestamp"),
        *[F.col(f"_r.{source}").alias(target) for source, target in names.items()],
    )


def hourly_checked(df: DataFrame, names: dict[str, str], payload: str = "payload", keep: list[str] = ("city",)) -> tuple[DataFrame, DataFrame]:
    """(the rows of ``hourly_rows`` that can be read, all others with their ``position``, time text and ``reason``), from one parse.

    ``no_time``: the payload can't be read or has no time list (one row per payload, no position); ``bad_time``: the time can't be read;
    ``bad_value``: a value is no number. A value that is absent or null is no fault here: the builds' checks decide about it.
    """
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("hourly", T.StructType([T.StructField(n, texts) for n in ("time", *names)]))])
    parsed = df.select(*keep, F.from_json(payload, schema).alias("_p"))
    zipped = F.arrays_zip(F.col("_p.hourly.time").alias("time"), *[F.col(f"_p.hourly.{n}").alias(n) for n in names])
    rows = parsed.select(*keep, F.posexplode_outer(zipped).alias("position", "_r"))
    values = {target: F.col(f"_r.{source}").try_cast("double") for source, target in names.items()}
    unread = F.lit(False)
    for source, target in names.items():
        unread = unread | (F.col(f"_r.{source}").isNotNull() & values[target].isNull())
    time = F.try_to_timestamp("_r.time")
    reason = F.when(F.col("_r").isNull(), "no_time").when(time.isNull(), "bad_time").when(unread, "bad_value")
    rows = rows.withColumn("reason", reason)
    accepted = rows.where("reason IS NULL").select(*keep, time.alias("timestamp"), *[v.alias(t) for t, v in values.items()])
    return accepted, rows.where("reason IS NOT NULL").select(*keep, "position", F.col("_r.time").alias("time"), "reason")


def wind_to_ms(df: DataFrame, unit: str) -> DataFrame:
    """History files state wind in km/h, live readings in m/s."""
    if unit == "ms":
        return df
    if unit == "kmh":
        return df.withColumn("wind_speed", F.col("wind_speed") / F.lit(3.6))
    raise ValueError(f"unknown wind unit {unit!r}")


# S6 ---------------------------------------------------------------------------------------------------------------

WEATHER_PAYLOAD = (
    "dt LONG, coord STRUCT<lat: DOUBLE, lon: DOUBLE>, main STRUCT<temp: DOUBLE, humidity: DOUBLE, pressure: DOUBLE>, "
    "wind STRUCT<speed: DOUBLE, deg: DOUBLE>, rain STRUCT<`1h`: DOUBLE>, snow STRUCT<`1h`: DOUBLE>"
)
POLLUTION_PAYLOAD = (
    "coord STRUCT<lat: DOUBLE, lon: DOUBLE>, list ARRAY<STRUCT<dt: LONG, components: STRUCT<pm2_5: DOUBLE, pm10: DOUBLE, "
    "co: DOUBLE, no2: DOUBLE, so2: DOUBLE, o3: DOUBLE>>>"
)


def current_weather(df: DataFrame, payload: str = "payload", keep: list[str] = ("city",)) -> DataFrame:
    """One weather reading per payload; ``accepted`` is false where a required field is missing."""
    zero = F.lit(0.0)
    p = df.select(*keep, F.from_json(payload, WEATHER_PAYLOAD).alias("p"))
    rain, snow = F.coalesce(F.col("p.rain.1h"), zero), F.coalesce(F.col("p.snow.1h"), zero)
    out = p.select(
        *keep,
        F.timestamp_seconds("p.dt").alias("timestamp"),
        F.col("p.coord.lat").alias("latitude"),
        F.col("p.coord.lon").alias("longitude"),
        F.col("p.main.temp").alias("temperature"),
        F.col("p.main.humidity").alias("humidity"),
        F.greatest(rain + snow, zero).alias("precipitation"),
        F.coalesce(F.col("p.wind.speed"), zero).alias("wind_speed"),
        F.coalesce(F.col("p.wind.deg"), zero).alias("wind_direction"),
        F.col("p.main.pressure").alias("pressure"),
    )
    required = ["timestamp", "latitude", "longitude", "temperature", "humidity", "pressure"]
    return out.withColumn("accepted", _all_present(required))


def current_pollution(df: DataFrame, payload: str = "payload", keep: list[str] = ("city",)) -> DataFrame:
    """The first reading of a pollution payload; missing or negative concentrations are not accepted."""
    p = df.select(*keep, F.from_json(payload, POLLUTION_PAYLOAD).alias("p"))
    first = F.try_element_at(F.col("p.list"), F.lit(1))
    names = {"pm2_5": "pm2_5", "pm10": "pm10", "co": "carbon_monoxide", "no2": "nitrogen_dioxide",
             "so2": "sulphur_dioxide", "o3": "ozone"}
    out = p.select(
        *keep,
        F.timestamp_seconds(first["dt"]).alias("timestamp"),
        F.col("p.coord.lat").alias("latitude"),
        F.col("p.coord.lon").alias("longitude"),
        *[first["components"][source].alias(target) for source, target in names.items()],
    )
    ok = _all_present(["timestamp", "latitude", "longitude", *names.values()])
    for target in names.values():
        ok = ok & F.coalesce(F.col(target) >= 0, F.lit(False))
    return out.withColumn("accepted", ok)


def _all_present(names: list[str]) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull()
    return ok


def accepted_and_refused(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("accepted").drop("accepted"), df.where(~F.col("accepted")).drop("accepted")


# S7 ---------------------------------------------------------------------------------------------------------------

STATION_PAYLOAD = (
    "status STRING, data STRUCT<aqi: STRING, city: STRUCT<name: STRING, geo: ARRAY<DOUBLE>>, time: STRUCT<iso: STRING>>"
)


def station_feed(df: DataFrame, payload: str = "payload", keep: list[str] = ("city",)) -> DataFrame:
    """Station readings; ``accepted`` is false unless the feed says ok. "-" and blanks are unknown values."""
    p = df.select(*keep, F.from_json(payload, STATION_PAYLOAD).alias("p"))
    geo = F.col("p.data.city.geo")
    located = F.size(geo) >= 2
    return p.select(
        *keep,
        F.try_to_timestamp("p.data.time.iso").alias("timestamp"),
        nan_to_null(F.col("p.data.aqi").try_cast("double")).alias("reported_aqi"),
        F.col("p.data.city.name").alias("station_name"),
        F.when(located, F.try_element_at(geo, F.lit(1))).alias("latitude"),
        F.when(located, F.try_element_at(geo, F.lit(2))).alias("longitude"),
        F.coalesce(F.col("p.status") == "ok", F.lit(False)).alias("accepted"),
    )


# S9, S10, S12 -----------------------------------------------------------------------------------------------------


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """CSV or Parquet by suffix, with the fixed columns and types."""
    if path.lower().rstrip("/").endswith(".csv"):
        raw = spark.read.option("header", True).csv(path)
    else:
        raw = spark.read.parquet(path)
    return normalise(raw)


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER_SCHEMA)


def write_predictions(df: DataFrame, path: str) -> None:
    """One dataset with a folder per horizon."""
    df.withColumn("horizon", F.concat(F.col("horizon_hours").cast("string"), F.lit("h"))).write.mode(
        "overwrite"
    ).partitionBy("horizon").parquet(path)


def read_predictions(spark: SparkSession, path: str, validate: bool = True) -> DataFrame:
    """All horizons as one table with a ``horizon`` column from the folder names."""
    df = require_columns(
        spark.read.parquet(path), ["city", "timestamp", "horizon_hours", "y_true", "prediction"], "predictions"
    )
    if validate:
        bad = F.col("y_true").isNull() | F.col("prediction").isNull() | F.isnan("y_true") | F.isnan("prediction") | (
            F.abs("y_true") == float("inf")) | (F.abs("prediction") == float("inf"))
        if df.where(bad).limit(1).count():
            raise ValueError("null or non-finite prediction values detected.")
    return df


def write_report(df: DataFrame, path: str) -> None:
    """Nested report rows as JSON lines."""
    df.write.mode("overwrite").json(path)
