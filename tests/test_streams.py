"""Streams give the same answer however the input is cut into files and batches; gaps and small differences are seen."""

from __future__ import annotations

import pytest
from fixtures import feature_panel, target_panel
from pyspark.sql import functions as F

from hazeline.operators import ledger as L
from hazeline.operators.audit import city_pairs, city_similarity
from hazeline.operators.features import build_features
from hazeline.operators.targets import build_targets
from hazeline.schema import HISTORY_COLUMNS, POLLUTANTS, WEATHER
from hazeline.streaming import jobs as T


def in_files(df, path: str, files: int) -> None:
    """``files`` files of rows in mixed order."""
    df.withColumn("_r", F.xxhash64(*df.columns)).repartition(files, "_r").drop("_r").write.option("maxRecordsPerFile", 0).parquet(path)


@pytest.mark.parametrize("files", [1, 4, 50])
def test_hours_do_not_depend_on_batches(spark, tmp_path, files):
    panel = target_panel(spark, 80).select("city", F.col("timestamp").cast("timestamp").alias("timestamp"), "pm2_5", "pm10")
    in_files(panel, str(tmp_path / "in"), files)
    stream = T.file_stream(spark, str(tmp_path / "in"), panel.schema, files_per_batch=max(1, files // 4))
    T.trailing_aqi(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    got = {(r.city, r.timestamp): r for r in T.latest_trailing_aqi(spark, str(tmp_path / "out")).collect()}
    want = [r for r in build_targets(target_panel(spark, 80)).withColumn("timestamp", F.col("timestamp").cast("timestamp")).collect()
            if r.aqi_current is not None]
    assert len(got) == len(want) == 2 * (80 - 23)
    for r in want:
        assert got[r.city, r.timestamp].pm2_5_24h_mean == pytest.approx(r.pm2_5_24h_mean)
        assert got[r.city, r.timestamp].aqi_current == r.aqi_current


@pytest.mark.parametrize("files", [1, 4, 50])
def test_readings_and_alarms_do_not_depend_on_batches(spark, tmp_path, files):
    readings = target_panel(spark, 60).select(
        "city", F.col("timestamp").cast("timestamp").alias("observed_at"), F.col("i").alias("reading_id"), "pm2_5")
    readings = readings.union(readings.where("reading_id % 7 = 0"))  # delivered again
    in_files(readings, str(tmp_path / "in"), files)

    def stream():
        return T.file_stream(spark, str(tmp_path / "in"), readings.schema, files_per_batch=1)
    T.hourly_readings(stream(), str(tmp_path / "hours"), str(tmp_path / "p1"))
    assert T.latest_readings(spark.read.parquet(str(tmp_path / "hours"))).count() == 120
    T.newest_readings(stream(), str(tmp_path / "newest"), str(tmp_path / "p2"))
    stored = target_panel(spark, 40).select("city", "timestamp")
    alarms = T.gap_alarms(spark.read.parquet(str(tmp_path / "newest")), stored).collect()
    assert sorted((r.city, r.readings, r.gap_hours) for r in alarms) == [("Islamabad", 69, 20), ("Lahore", 69, 20)]


def test_a_gap_gives_null_not_another_hour(spark):
    whole, gap = target_panel(spark, 120), target_panel(spark, 120).where("i <> 60")
    want = {(r.city, r.i): r for r in build_targets(whole).collect()}
    seen = 0
    for r in build_targets(gap, on_gap="trust").collect():
        for c in ("pm2_5_24h_mean", "aqi_current", "target_aqi_24h", "target_aqi_48h"):
            if r[c] is not None:
                assert r[c] == want[r.city, r.i][c]
            seen += r[c] is None and want[r.city, r.i][c] is not None
    assert seen > 40
    full = {(r.city, r.i): r for r in build_features(feature_panel(spark, 200).drop("aqi_current")).collect()}
    for r in build_features(feature_panel(spark, 200).drop("aqi_current").where("i <> 90"), on_gap="trust").collect():
        for c in ("aqi_lag_24h", "pm2_5_lag_1h", "aqi_rolling_mean_24h", "pm10_rolling_mean_24h", "aqi_change_24h"):
            assert r[c] is None or r[c] == full[r.city, r.i][c]


def test_means_and_matches_keep_their_decimals(spark):
    same = target_panel(spark, 24).withColumn("pm2_5", F.lit(9.0949))
    assert {r.pm2_5_24h_mean for r in build_targets(same).where("i = 23").collect()} == {9.0949}
    near = target_panel(spark, 30).select("city", "timestamp", F.when(F.col("city") == "Lahore", F.col("i") + 0.003).otherwise(
        F.col("i").cast("double")).alias("ozone"))
    row = city_similarity(near, columns=["ozone"]).first()
    assert row.exact_match_pct == 0 and row.near_match_pct == 100 and row.mae == pytest.approx(0.003)


def test_pairs_of_seventy_cities(spark):
    names = spark.range(70).select(F.concat(F.lit("c"), F.lpad("id", 3, "0")).alias("city"))
    pairs = city_pairs(names)
    assert pairs.count() == 70 * 69 // 2 and pairs.where("city_a >= city_b").count() == 0


def _matured(spark, tmp_path, forecasts, actual_files, per_batch, cut=1):
    """State of a T3 table after forecasts in ``cut`` files and actuals in the files given, ``per_batch`` files a batch."""
    made = L.new_records(forecasts).drop(*L.SCORED)
    in_files(made, str(tmp_path / "forecasts"), cut)
    for i, df in enumerate(actual_files):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "actuals"))
    sides = [T.file_stream(spark, str(tmp_path / name), schema, files_per_batch=per_batch)
             for name, schema in (("forecasts", made.schema), ("actuals", actual_files[0].schema))]
    T.matured_forecasts(*sides, str(tmp_path / "table"), str(tmp_path / "progress"), F.lit("2026-02-01 00:00:00"))
    return sides


def _forecast_rows(spark, hours=40):
    start = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return spark.range(hours).select(
        F.lit("Lahore").alias("city"), (start + F.make_interval(hours=F.col("id").cast("int"))).alias("forecast_created_at"),
        F.lit("24H").alias("horizon"), (F.col("id") * 4.0).alias("predicted_aqi"), F.lit("Moderate").alias("predicted_category"),
        F.lit("m").alias("model_name"), F.lit("a").alias("model_alias"))


def _actual_rows(spark, low, high, plus=0.0, minute=10):
    start = F.lit("2026-01-02 00:00:00").cast("timestamp")
    at = start + F.make_interval(hours=F.col("id").cast("int"))
    return spark.range(low, high).select(F.lit("LAHORE").alias("city"), at.alias("timestamp"), (F.col("id") * 5.0 + plus).alias("aqi_current"),
                                         (at + F.make_interval(mins=F.lit(minute))).alias("observed_at"))


def test_late_actuals_score_every_forecast(spark, tmp_path):
    """The newest hours come first; none of 40 forecasts is lost, and every score column is filled."""
    forecasts = _forecast_rows(spark)
    _matured(spark, tmp_path, forecasts, [_actual_rows(spark, 20, 40), _actual_rows(spark, 0, 10), _actual_rows(spark, 10, 20)], 1)
    got = T.latest_scores(spark, str(tmp_path / "table"))
    want = L.evaluate(L.new_records(forecasts), _actual_rows(spark, 0, 40), F.lit("2026-02-01 00:00:00").cast("timestamp"))
    assert got.columns == want.columns and got.count() == 40
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert T.pending_forecasts(spark, str(tmp_path / "table")).count() == 0


@pytest.mark.parametrize("cut,per_batch", [(1, 100), (4, 1), (7, 2)])
def test_revised_hours_score_alike_in_any_order(spark, tmp_path, cut, per_batch):
    forecasts = _forecast_rows(spark, 12)
    actuals = [_actual_rows(spark, 0, 9, 50.0, 5), _actual_rows(spark, 3, 10, 0.0, 40), _actual_rows(spark, 0, 3, 1.0, 20)]
    order = actuals if cut != 4 else actuals[::-1]
    _matured(spark, tmp_path, forecasts, order, per_batch, cut)
    got = {r.forecast_created_at.hour: r.actual_aqi for r in T.latest_scores(spark, str(tmp_path / "table")).collect()}
    assert got == {h: h * 5.0 + (1.0 if h < 3 else 0.0) for h in range(10)}
    assert sorted(r.forecast_created_at.hour for r in T.pending_forecasts(spark, str(tmp_path / "table")).collect()) == [10, 11]


@pytest.mark.parametrize("files", [1, 2])
def test_revised_hours_of_means_follow_their_time(spark, tmp_path, files):
    """An hour first 10, revised to 4: the trailing mean is that of 4, in one batch as in two."""
    base = target_panel(spark, 24).where("city = 'Lahore'").select(
        "city", F.col("timestamp").cast("timestamp").alias("timestamp"), F.lit(10.0).alias("pm2_5"), F.lit(10.0).alias("pm10"))
    base = base.withColumn("observed_at", F.col("timestamp"))
    revised = base.where(F.hour("timestamp") == 5).withColumns({"pm2_5": F.lit(4.0), "observed_at": F.col("timestamp") + F.expr("INTERVAL 1 HOUR")})
    for df in ([base.union(revised)] if files == 1 else [revised, base]):
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = T.file_stream(spark, str(tmp_path / "in"), base.schema, files_per_batch=1)
    T.trailing_aqi(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert [r.pm2_5_24h_mean for r in T.latest_trailing_aqi(spark, str(tmp_path / "out")).collect()] == [9.75]


def test_pairs_wait_for_each_other_and_a_replayed_batch_changes_nothing(spark, tmp_path):
    panel = feature_panel(spark, 60)
    rows = panel.select(*[F.col(c) if c in panel.columns else F.lit("archive" if c == "source" else 1.0).alias(c) for c in HISTORY_COLUMNS])
    first = F.lit("2026-01-01 00:00:00").cast(rows.schema["timestamp"].dataType) + F.expr("INTERVAL 40 HOURS")
    history, live = rows.where(F.col("timestamp") < first), rows.where(F.col("timestamp") >= first)
    cities = rows.groupBy("city").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))

    def side(name, columns, lost):
        df = live.where(~lost).select("city", (F.col("timestamp").cast("timestamp") + F.expr("INTERVAL 9 MINUTES")).alias("observed_at"), *columns)
        in_files(df, str(tmp_path / name), 5)
        return lambda: T.file_stream(spark, str(tmp_path / name), df.schema, files_per_batch=2)

    hole = (F.col("city") == "Lahore") & (F.col("timestamp") == first + F.expr("INTERVAL 6 HOURS"))
    weather, pollution = side("weather", WEATHER, F.lit(False)), side("pollution", POLLUTANTS, hole)
    path = str(tmp_path / "table")
    T.live_history(weather(), pollution(), cities, history, path, str(tmp_path / "p1"))
    got = {r.city: (r.n, r.live) for r in T.live_state(spark, path, history).groupBy("city").agg(
        F.count("*").alias("n"), F.count_if(F.col("source") == "openweather_live").alias("live")).collect()}
    assert got == {"Islamabad": (60, 20), "Lahore": (46, 6)}
    before = sorted(map(str, T.live_state(spark, path, history).collect()))
    T.live_history(weather(), pollution(), cities, history, path, str(tmp_path / "p2"))  # every batch again, by its number
    assert sorted(map(str, T.live_state(spark, path, history).collect())) == before
