"""Index functions over every event value."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.inputs import events, predictions, readings
from hazeline.catalog.registry import query
from hazeline.functions import aqi
from hazeline.functions.aqi import ALERTS


@query("d1_truncation", """
SELECT event_id, floor(value * 10) / 10::DOUBLE AS pm2_5_truncated, floor(value) AS pm10_truncated FROM events""",
       "pm2_5_truncated pm10_truncated")
def truncation(spark, folder):
    v = F.col("value")
    return events(spark, folder).select(
        "event_id", aqi.truncate_pm25(v).alias("pm2_5_truncated"), aqi.truncate_pm10(v).alias("pm10_truncated"))


@query("d2_sub_indices", f"""
SELECT event_id, {S.pm25_index('value')} AS pm2_5_aqi, {S.pm10_index('value')} AS pm10_aqi FROM events""")
def sub_indices(spark, folder):
    v = F.col("value")
    return events(spark, folder).select("event_id", aqi.pm25_index(v).alias("pm2_5_aqi"), aqi.pm10_index(v).alias("pm10_aqi"))


_PAIR = f"""SELECT event_id, {S.pm25_index('value::DOUBLE')} AS a, {S.pm10_index('(value + k)::DOUBLE')} AS b FROM readings"""


def _pair(spark, folder):
    r = readings(spark, folder)
    return r.select("event_id", aqi.pm25_index(F.col("value")).alias("a"), aqi.pm10_index(F.col("value") + F.col("k")).alias("b"))


@query("d3_overall_index", f"""
SELECT event_id, greatest(a, b) AS aqi, CASE WHEN a >= b THEN 'pm2_5' ELSE 'pm10' END AS dominant_pollutant FROM ({_PAIR})""")
def overall(spark, folder):
    a, b = F.col("a"), F.col("b")
    return _pair(spark, folder).select(
        "event_id", aqi.overall_index(a, b).alias("aqi"), aqi.dominant_pollutant(a, b).alias("dominant_pollutant"))


@query("d4_category", f"""
SELECT event_id, {S.category('greatest(a, b)')} AS category FROM ({_PAIR})""")
def category(spark, folder):
    index = aqi.overall_index(F.col("a"), F.col("b"))
    return _pair(spark, folder).select("event_id", aqi.category(index).alias("category"))


@query("d5_prediction_category", f"""
SELECT event_id, {S.clip('value * 2 - 50')} AS clipped, {S.prediction_category('value * 2 - 50')} AS category FROM events""",
       "clipped")
def prediction_category(spark, folder):
    x = F.col("value") * 2 - 50
    return events(spark, folder).select(
        "event_id", aqi.clip_prediction(x).alias("clipped"), aqi.category_of_prediction(x).alias("category"))


def _alert_sql(x: str, what: int) -> str:
    cuts = [50, 100, 150, 200, 300]
    arms = " ".join(f"WHEN {x} <= {c} THEN '{ALERTS[i][what]}'" for i, c in enumerate(cuts))
    return f"CASE {arms} ELSE '{ALERTS[5][what]}' END"


@query("d6_alert", f"""
SELECT event_id, {_alert_sql('value', 0)} AS level,
  (CASE WHEN value <= 50 THEN 0 WHEN value <= 100 THEN 1 WHEN value <= 150 THEN 2 WHEN value <= 200 THEN 3
   WHEN value <= 300 THEN 4 ELSE 5 END)::INT AS severity, {_alert_sql('value', 1)} AS message FROM events""")
def alert(spark, folder):
    return events(spark, folder).select("event_id", aqi.alert(F.col("value")).alias("a")).select("event_id", "a.*")


_DISTANCE = f"abs({S.rank_of(S.prediction_category('y_true'))} - {S.rank_of(S.prediction_category('prediction'))})"


@query("d7_category_distance", f"""
SELECT city, timestamp, horizon_hours, model, {_DISTANCE} AS distance, {_DISTANCE} <= 1 AS adjacent FROM predictions""")
def distance(spark, folder):
    d = aqi.category_distance(
        aqi.category_of_prediction(F.col("y_true")), aqi.category_of_prediction(F.col("prediction")))
    return predictions(spark, folder).select(
        "city", "timestamp", "horizon_hours", "model", d.alias("distance"), (d <= 1).alias("adjacent"))


@query("d8_negative_rejection", f"""
SELECT event_id, event_id % 89 = 0 AND value > 0 AS rejected,
  CASE WHEN event_id % 89 = 0 AND value > 0 THEN NULL ELSE {S.pm25_index('value')} END AS pm2_5_aqi FROM events""")
def negative(spark, folder):
    v = F.when(F.col("event_id") % 89 == 0, -F.col("value")).otherwise(F.col("value"))
    return events(spark, folder).select("event_id", (v < 0).alias("rejected"), aqi.pm25_index(v).alias("pm2_5_aqi"))
