"""History: no city is lost, and one bad time does not end a job."""

from __future__ import annotations

import pytest
from fixtures import hourly
from pyspark.sql import functions as F

from hazeline.operators.history import HISTORY_COLUMNS, checked, load, recover_gap, save, upsert
from hazeline.sources.landed import hourly_checked, hourly_rows


def _history(df, source: str):
    have = {"city": F.col("city"), "timestamp": F.col("timestamp"), "source": F.lit(source)}
    return df.select(*[have.get(c, F.lit(1.0)).alias(c) for c in HISTORY_COLUMNS])


def test_city_without_recovered_rows_stays(spark):
    stored = _history(hourly(spark, 10), "archive")
    recovered = _history(hourly(spark, 20).where("city = 'Lahore'"), "archive")
    rows = {r.city: r.n for r in recover_gap(stored, recovered).groupBy("city").agg(F.count("*").alias("n")).collect()}
    assert rows == {"Islamabad": 10, "Lahore": 20}


def test_bad_time_is_a_null(spark):
    df = spark.createDataFrame([("x", '{"hourly": {"time": ["2026-01-01T00:00", "soon"], "a": [1.0, 2.0]}}')], "city string, payload string")
    rows = hourly_rows(df, {"a": "b"}).collect()
    assert [(r.timestamp is None, r.b) for r in rows] == [(False, 1.0), (True, 2.0)]


def _readings(spark, rows):
    """(city, hours after the first, minute, value) as readings with the time they were taken."""
    df = spark.createDataFrame(rows, "city string, h int, m int, v double")
    start = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    hour = start + F.make_interval(hours=F.col("h"))
    have = {"city": F.col("city"), "timestamp": hour, "source": F.lit("openweather_live"), "pm10": F.col("v")}
    return df.select(*[have.get(c, F.lit(1.0)).alias(c) for c in HISTORY_COLUMNS],
                     (hour + F.make_interval(mins=F.col("m"))).alias("observed_at"))


def test_hours_behind_one_another_are_caught_up(spark):
    stored = _history(hourly(spark, 10), "archive")
    rows = _readings(spark, [("Lahore", h, 5, float(h)) for h in (10, 11, 12, 13, 15)] + [("Islamabad", 11, 5, 0.0), ("Multan", 9, 0, 0.0)])
    kept, refused = upsert(stored, rows)
    assert {r.city: r.n for r in kept.groupBy("city").agg(F.count("*").alias("n")).collect()} == {"Islamabad": 10, "Lahore": 14}
    assert sorted((r.city, r.timestamp.hour, r.reason) for r in refused.collect()) == [
        ("Islamabad", 11, "gap"), ("Lahore", 15, "gap"), ("Multan", 9, "no_recovery")]


def test_later_reading_of_an_hour_wins_in_any_order(spark):
    stored = _history(hourly(spark, 10), "archive")
    rows = [("Lahore", 9, 50, 7.0), ("Lahore", 9, 10, 99.0), ("Lahore", 10, 20, 5.0), ("Lahore", 10, 40, 3.0)]
    for given in (rows, rows[::-1]):
        kept = upsert(stored, _readings(spark, given))[0].where("city = 'Lahore' AND source = 'openweather_live'")
        assert sorted((r.timestamp.hour, r.pm10) for r in kept.collect()) == [(9, 7.0), (10, 3.0)]


def test_check_after_upsert_names_the_city(spark):
    stored = _history(hourly(spark, 120), "archive")
    kept, _ = upsert(stored, _readings(spark, [("Lahore", 120, 5, -4.0)]))
    good, bad = checked(kept)
    assert [r.city for r in good.select("city").distinct().collect()] == ["Islamabad"]
    assert [(r.city, r.reasons) for r in bad.collect()] == [("Lahore", ["negative_values"])]


def test_refused_hours_say_why(spark):
    payloads = ['{"hourly": {"time": ["2026-01-01T00:00", "soon", "2026-01-01T02:00", "2026-01-01T03:00"], "a": [1.5, 2, "n/a", null]}}',
                '{"hourly": {"a": [1.0]}}', "no json", None, '{"hourly": {"time": [], "a": []}}']
    df = spark.createDataFrame([(f"c{i}", p) for i, p in enumerate(payloads)], "city string, payload string")
    good, bad = hourly_checked(df, {"a": "b"})
    assert sorted((r.timestamp.hour, r.b) for r in good.where("b IS NOT NULL").collect()) == [(0, 1.5)]
    assert [r.timestamp.hour for r in good.where("b IS NULL").collect()] == [3]
    assert sorted((r.city, r.position, r.reason) for r in bad.where("position IS NOT NULL").collect()) == [("c0", 1, "bad_time"), ("c0", 2, "bad_value")]
    assert sorted((r.city, r.reason) for r in bad.where("position IS NULL").collect()) == [(f"c{i}", "no_time") for i in (1, 2, 3, 4)]
    assert hourly_checked(df.limit(0), {"a": "b"})[1].count() == 0


def test_readers_see_whole_accepted_versions_only(spark, tmp_path):
    path = str(tmp_path / "history")
    with pytest.raises(FileNotFoundError):
        load(spark, path)
    both = _history(hourly(spark, 120), "archive")
    with pytest.raises(ValueError, match="history of 2 cities refused"):
        save(both.withColumn("pm10", F.lit(-1.0)), path)
    with pytest.raises(FileNotFoundError):
        load(spark, path)
    assert save(both, path) == 1
    lahore = both.where("city = 'Lahore'").withColumn("pm10", F.lit(7.0))
    assert save(lahore, path) == 2
    with pytest.raises(ValueError, match="Lahore: negative_values"):
        save(lahore.withColumn("pm10", F.lit(-7.0)), path)
    got = {(r.city, r.pm10): r.n for r in load(spark, path).groupBy("city", "pm10").agg(F.count("*").alias("n")).collect()}
    assert got == {("Islamabad", 1.0): 120, ("Lahore", 7.0): 120}
