"""An hourly panel from raw event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.functions.exact import exact
from hazeline.functions.text import naive_hour_bucket
from hazeline.operators.grid import spine

# Station, latitude, longitude.
STATIONS = [
    ("click", 31.45, 73.13),
    ("error", 33.68, 73.04),
    ("purchase", 24.86, 67.0),
    ("signup", 31.52, 74.35),
    ("view", 30.15, 71.52),
]


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def readings(ev: DataFrame) -> DataFrame:
    """Raw events as sensor readings at their hour."""
    return ev.select(
        F.col("event_type").alias("city"),
        naive_hour_bucket(F.col("ts")).alias("timestamp"),
        "ts",
        "event_id",
        "user_id",
        exact(F.col("value")).alias("value"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _hourly(rows: DataFrame) -> DataFrame:
    def filled(c):
        return F.coalesce(c, F.lit(0))

    k, n = filled(F.sum("k")), F.count("event_id")
    latitude = F.create_map(*[x for s, lat, _ in STATIONS for x in (F.lit(s), F.lit(lat))])
    longitude = F.create_map(*[x for s, _, lon in STATIONS for x in (F.lit(s), F.lit(lon))])
    out = rows.groupBy("city", "timestamp").agg(
        exact(filled(F.min("value"))).alias("pm2_5"),
        exact(filled(F.max("value"))).alias("pm10"),
        exact(filled(F.sum("value"))).alias("carbon_monoxide"),
        filled(F.max("k")).alias("nitrogen_dioxide"),
        filled(F.min("k")).alias("sulphur_dioxide"),
        F.count_distinct("user_id").alias("ozone"),
        n.alias("wind_speed"),
        (k % 101).cast("int").alias("humidity"),
        (filled(F.sum("user_id")) % 40).cast("int").alias("temperature"),
        (filled(F.sum("event_id")) % 360).cast("int").alias("wind_direction"),
        (F.lit(1000) + k % 50).cast("int").alias("pressure"),
    )
    return out.withColumns(
        {"precipitation": F.lit(0), "latitude": latitude[F.col("city")], "longitude": longitude[F.col("city")]}
    ).select("city", "timestamp", "latitude", "longitude", "pm2_5", "pm10", "carbon_monoxide", "nitrogen_dioxide",
             "sulphur_dioxide", "ozone", "temperature", "humidity", "precipitation", "wind_speed", "wind_direction",
             "pressure")


def sparse_panel(ev: DataFrame) -> DataFrame:
    """Hours that hold at least one event."""
    return _hourly(readings(ev))


def panel(ev: DataFrame) -> DataFrame:
    """Gap-free panel: spine hours ride through the same aggregation as rows without values, so no join is needed."""
    rows = readings(ev).drop("ts")
    grid = spine(ev.select(F.col("event_type").alias("city"), F.col("ts").alias("timestamp")))
    return _hourly(rows.unionByName(grid, allowMissingColumns=True))
