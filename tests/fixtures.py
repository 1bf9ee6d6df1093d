"""Panels with known answers, built by Spark from a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OFFSETS = {"Islamabad": 0.0, "Lahore": 50.0}


def hourly(spark, rows: int, cities=tuple(OFFSETS)) -> DataFrame:
    """(city, timestamp, i) hourly from 2026-01-01."""
    names = F.explode(F.array(*[F.lit(c) for c in cities])).alias("city")
    base = spark.range(rows).select(F.col("id").cast("int").alias("i"), names)
    ts = (F.lit("2026-01-01 00:00:00").cast("timestamp") + F.make_interval(hours=F.col("i"))).cast("timestamp_ntz")
    return base.withColumn("timestamp", ts)


def _offset():
    return F.create_map(*[x for c, o in OFFSETS.items() for x in (F.lit(c), F.lit(o))])[F.col("city")]


def target_panel(spark, rows: int = 120) -> DataFrame:
    return hourly(spark, rows).withColumns(
        {"pm2_5": F.lit(20.0) + F.col("i") * 0.1 + _offset(), "pm10": F.lit(40.0) + F.col("i") * 0.1 + _offset()})


def feature_panel(spark, rows: int = 120) -> DataFrame:
    i, o = F.col("i"), _offset()
    lat = F.when(F.col("city") == "Islamabad", 33.6844).otherwise(31.5204)
    lon = F.when(F.col("city") == "Islamabad", 73.0479).otherwise(74.3587)
    return hourly(spark, rows).withColumns({
        "latitude": lat, "longitude": lon, "temperature": 20.0 + i % 10, "humidity": 40.0 + i % 30, "precipitation": F.lit(0.0),
        "wind_speed": 3.0 + i % 5, "wind_direction": ((i * 15) % 360).cast("double"), "pressure": 1010.0 + i % 5,
        "pm2_5": 30.0 + i + o, "pm10": 50.0 + i + o, "carbon_monoxide": F.lit(500.0), "nitrogen_dioxide": F.lit(20.0),
        "sulphur_dioxide": F.lit(10.0), "ozone": F.lit(50.0), "aqi_current": (100 + i + o).cast("int")})
