from __future__ import annotations

import math
import statistics
from datetime import datetime, timedelta

import pytest
from fixtures import feature_panel, hourly, target_panel
from pyspark.sql import Window
from pyspark.sql import functions as F

from hazeline.operators import features as Fe
from hazeline.operators import grid as G
from hazeline.operators import targets as T
from hazeline.schema import FEATURES


def _rows(df, city):
    return df.where(F.col("city") == city).orderBy("timestamp").collect()


def test_targets_known_answers(spark):
    rows = _rows(T.build_targets(target_panel(spark)), "Islamabad")
    assert all(r["aqi_current"] is None for r in rows[:23]) and rows[23]["aqi_current"] is not None
    assert rows[23]["pm2_5_24h_mean"] == pytest.approx(sum(20 + 0.1 * i for i in range(24)) / 24)
    for i in range(23, 48):
        assert rows[i]["target_aqi_24h"] == rows[i + 24]["aqi_current"]
        assert rows[i]["target_aqi_72h"] == rows[i + 72]["aqi_current"]
    assert all(r["target_aqi_24h"] is None for r in rows[-24:])


@pytest.mark.parametrize("fault", ["none", "gap at the end", "missing cell", "negative", "repeated hour", "off the hour", "short"])
def test_newest_features_of_a_pruned_build(spark, fault):
    """The newest row, and the newest 30 hours with AQI, as from all rows; an even history leaves at most 190 hours."""
    p, i = feature_panel(spark, 500).drop("aqi_current"), F.col("i")
    lahore = F.col("city") == "Lahore"
    if fault == "gap at the end":
        p = p.where(~lahore | (i != 490))
    elif fault in ("missing cell", "negative"):
        p = p.withColumn("pm10", F.when(lahore & (i == 470), None if fault == "missing cell" else -1.0).otherwise(F.col("pm10")))
    elif fault == "repeated hour":
        p = p.unionByName(p.where(lahore & (i == 480)))
    elif fault == "off the hour":
        p = p.withColumn("timestamp", F.when(lahore & (i == 480), F.col("timestamp") + F.expr("INTERVAL 5 MINUTES")).otherwise(F.col("timestamp")))
    elif fault == "short":
        p = p.where(~lahore | (i < 20))
    want = Fe.model_projection(Fe.latest_per_city(Fe.build_features(p)), "aqi_current", "aqi_category")
    got = Fe.model_projection(Fe.newest_features(p), "aqi_current", "aqi_category")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    newest = Window.partitionBy("city").orderBy(F.col("timestamp").desc())
    hours = [T.build_aqi(x).where("aqi_current IS NOT NULL").withColumn("rn", F.row_number().over(newest)).where("rn <= 30").select(
        "city", "timestamp", "aqi_current") for x in (p, T.recent_rows(p, 30))]
    assert hours[0].exceptAll(hours[1]).count() == 0 and hours[0].count() == hours[1].count()
    if fault == "none":
        assert T.recent_rows(p, 1, 95).count() <= 2 * 190


@pytest.mark.parametrize("block_hours", [7, 24, 50, 5000])
def test_time_blocks_do_not_change_the_answer(spark, block_hours):
    """Blocks far shorter than the look-back give the plain window's rows."""
    p = feature_panel(spark, 260).drop("aqi_current")
    plain = Fe.model_projection(Fe.build_features(p, block_hours=1_000_000), "target_aqi_72h")
    blocked = Fe.model_projection(Fe.build_features(p, block_hours=block_hours), "target_aqi_72h")
    assert blocked.count() == plain.count() == 520
    assert blocked.exceptAll(plain).count() == 0


def test_gap_is_an_error_or_quarantined(spark):
    p = target_panel(spark).where(~((F.col("city") == "Lahore") & (F.col("i") == 60)))
    with pytest.raises(ValueError, match="continuous hourly"):
        T.build_targets(p, on_gap="raise")
    kept = T.build_targets(p, on_gap="quarantine")
    assert {r["city"] for r in kept.select("city").distinct().collect()} == {"Islamabad"}


def test_particulate_input_rules(spark):
    with pytest.raises(ValueError, match="negative"):
        T.require_particulates(target_panel(spark).withColumn("pm2_5", F.when(F.col("i") == 3, -1.0).otherwise(F.col("pm2_5"))))
    with pytest.raises(ValueError, match="missing values"):
        T.require_particulates(target_panel(spark).withColumn("pm10", F.when(F.col("i") != 3, F.col("pm10"))))
    with pytest.raises(ValueError, match="missing required columns"):
        T.build_targets(target_panel(spark).drop("pm10"))
    with pytest.raises(ValueError, match="empty"):
        T.require_particulates(target_panel(spark).where(F.col("i") < 0))


def test_features_known_answers(spark):
    df = Fe.engineer(feature_panel(spark))
    for city, first in (("Islamabad", 100), ("Lahore", 150)):
        rows = _rows(df, city)
        assert rows[0]["aqi_lag_1h"] is None
        assert rows[10]["aqi_lag_1h"] == rows[9]["aqi_current"]
        assert rows[4]["aqi_rolling_mean_6h"] is None
        assert rows[5]["aqi_rolling_mean_6h"] == pytest.approx(sum(first + i for i in range(6)) / 6)
        assert rows[5]["aqi_rolling_std_6h"] == pytest.approx(statistics.stdev(range(6)))
        assert rows[24]["aqi_change_24h"] == 24
        assert rows[6]["hour_sin"] == pytest.approx(math.sin(2 * math.pi * 6 / 24))
        assert rows[0]["day_of_week"] == 3 and rows[50]["is_weekend"] == 1  # a Thursday; two days later a Saturday
        assert rows[1]["stagnation_index"] == pytest.approx(41 / 5)
    assert len(FEATURES) == 56 and len(set(FEATURES)) == 56


def test_newest_row_and_summary(spark):
    built = Fe.build_features(feature_panel(spark).drop("aqi_current"))
    newest = Fe.latest_per_city(built).select("city", "timestamp").collect()
    assert len(newest) == 2 and {str(r["timestamp"]) for r in newest} == {"2026-01-05 23:00:00"}
    s = Fe.feature_summary(feature_panel(spark), built).first()
    assert (s["input_rows"], s["output_rows"], s["cities"], s["feature_count"]) == (240, 240, 2, 56)


def test_previous_row_across_blocks(spark):
    """Gaps longer than a block, repeated hours: equal to a plain lag."""
    p = hourly(spark, 400).where((F.col("i") < 20) | (F.col("i") % 37 < 5)).select("city", "timestamp")
    p = p.unionByName(p.where(F.hour("timestamp") == 3))
    plain = p.withColumn("previous", F.lag("timestamp").over(Window.partitionBy("city").orderBy("timestamp")))
    for block in (6, 48, 100_000):
        mine = G.previous_row(p, ["city"], block_hours=block)
        assert mine.exceptAll(plain).count() == 0 and mine.count() == plain.count()


def test_spine_and_missing_hours(spark):
    p = hourly(spark, 48).where(F.col("i") != 30)
    assert G.spine(p).count() == 96
    assert G.missing_hours(p).count() == 2
    assert [r["non_hourly_gaps"] for r in G.gap_counts(p).collect()] == [1, 1]


def test_gap_counts_of_repeated_times(spark):
    """Every repetition is a step of its own, wherever blocks meet; times that are missing are none."""
    t = datetime(2024, 1, 1)
    rows = [("a", t)] * 500 + [("a", t + timedelta(hours=h)) for h in (1, 2, 30, 31, 100)] + [("b", t), ("b", t + timedelta(hours=1)), ("b", None), ("b", None)]
    df = spark.createDataFrame(rows, "city string, timestamp timestamp")
    got = {r["city"]: r["non_hourly_gaps"] for r in G.gap_counts(df).collect()}
    assert got == {"a": 499 + 2}
    assert got == {r["city"]: r["n"] for r in G.gaps(df).groupBy("city").agg(F.count("*").alias("n")).collect()}
