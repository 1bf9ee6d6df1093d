"""Inputs the queries share, all derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.operators.evaluate import long_predictions
from hazeline.operators.features import build_features, complete_rows
from hazeline.operators.targets import build_aqi, build_targets
from hazeline.plans import panel as P
from hazeline.session import written


def events(spark: SparkSession, folder: str) -> DataFrame:
    return P.events(spark, folder)


def readings(spark, folder) -> DataFrame:
    return P.readings(events(spark, folder))


def sparse(spark, folder) -> DataFrame:
    return P.sparse_panel(events(spark, folder))


def panel(spark, folder) -> DataFrame:
    return P.panel(events(spark, folder))


def aqi_panel(spark, folder) -> DataFrame:
    return build_aqi(panel(spark, folder))


def target_panel(spark, folder) -> DataFrame:
    return build_targets(panel(spark, folder))


def feature_panel(spark, folder) -> DataFrame:
    return build_features(panel(spark, folder))


def predictions(spark, folder) -> DataFrame:
    models = {"persistence": F.col("aqi_current"), "mean_24h": F.col("aqi_rolling_mean_24h")}
    return long_predictions(feature_panel(spark, folder), models)


def dirty(spark, folder) -> DataFrame:
    """One row per event with missing, negative and out-of-range cells."""
    r = readings(spark, folder)
    e, v, k = F.col("event_id"), F.col("value"), F.col("k")
    lat = F.create_map(*[x for s, la, _ in P.STATIONS for x in (F.lit(s), F.lit(la))])
    lon = F.create_map(*[x for s, _, lo in P.STATIONS for x in (F.lit(s), F.lit(lo))])
    return r.select(
        "city", "timestamp", "event_id",
        F.when(e % 97 == 0, None).when(e % 89 == 0, -v).otherwise(v).alias("pm2_5"),
        F.when(e % 83 == 0, -v).otherwise(v + k).alias("pm10"),
        k.alias("carbon_monoxide"), k.alias("nitrogen_dioxide"), (F.col("user_id") % 50).alias("sulphur_dioxide"),
        v.alias("ozone"), k.alias("dust"), (F.col("user_id") % 40).alias("temperature"), (k + 3).alias("humidity"),
        F.lit(0).alias("precipitation"), (k % 20).alias("wind_speed"), (e % 370).alias("wind_direction"),
        (k + 790).alias("pressure"), lat[F.col("city")].alias("latitude"), lon[F.col("city")].alias("longitude"),
    )


def feature_table(spark, folder) -> DataFrame:
    """Complete feature rows as a stored table, for work that reads them several times."""
    return written(complete_rows(feature_panel(spark, folder)), "features")
