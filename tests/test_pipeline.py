"""Quality report, sequences, ledger life cycle, history, models."""

from __future__ import annotations

import numpy as np
import pytest
from fixtures import feature_panel, hourly
from pyspark.sql import functions as F

from hazeline.operators import history as H
from hazeline.operators import ledger as L
from hazeline.operators import models as M
from hazeline.operators import quality as Q
from hazeline.operators import sequences as S
from hazeline.schema import BASE_FEATURES
from hazeline.sources.landed import empty_ledger, read_csv_text


def _raw(spark):
    i = F.col("i")
    return hourly(spark, 48).select(
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "city", F.lit(33.6).alias("latitude"), F.lit(73.0).alias("longitude"),
        (40.0 + i).alias("pm10"), (30.0 + i).alias("pm2_5"), F.lit(500.0).alias("carbon_monoxide"), F.lit(20.0).alias("nitrogen_dioxide"),
        F.lit(10.0).alias("sulphur_dioxide"), F.lit(50.0).alias("ozone"), F.lit(5.0).alias("dust"), (15.0 + i % 10).alias("temperature"),
        (50.0 + i % 20).alias("humidity"), F.lit(0.0).alias("precipitation"), (3.0 + i % 4).alias("wind_speed"),
        ((i * 15) % 360).cast("double").alias("wind_direction"), (1010.0 + i % 5).alias("pressure"), F.lit("Good").alias("aqi_category"))


def test_validation_report(spark, tmp_path):
    path = str(tmp_path / "raw")
    _raw(spark).write.option("header", True).csv(path)
    r = Q.validation_report(read_csv_text(spark, path), path).first()
    assert (r["row_count"], r["city_count"], r["expected_rows_per_city"], r["missing_values"], r["duplicate_rows"]) == (96, 2, 48, 0, 0)
    assert r["hourly_continuity"] and r["balanced_cities"] and r["weather_variability_valid"] and r["status"] == "REVIEW"
    assert r["warnings"] == [Q.WARN_ZONE, Q.WARN_AQI] and r["invalid_numeric_ranges"] == {}
    bad = _raw(spark).withColumn("humidity", F.when(F.col("pm10") == 45, 120.0).otherwise(F.col("humidity")))
    assert Q.validation_report(bad.where("city = 'Lahore'")).first()["invalid_numeric_ranges"] == {"humidity": 1}
    gap = Q.validation_report(_raw(spark).where(~((F.col("pm10") == 50) & (F.col("city") == "Lahore")))).first()
    assert not gap["hourly_continuity"] and Q.WARN_GAPS in gap["warnings"] and Q.WARN_BALANCE in gap["warnings"]
    dropped = Q.validation_report(_raw(spark).drop("ozone")).first()
    assert dropped["status"] == "FAIL" and dropped["missing_required_columns"] == ["ozone"]


def _sequence_panel(spark, rows=100):
    cols = {c: (F.col("i") + k + 1).cast("double") for k, c in enumerate(BASE_FEATURES)}
    return hourly(spark, rows, ("Islamabad",)).withColumns({**cols, "target_aqi_24h": 100.0 + F.col("i")})


def test_sequences(spark):
    p = _sequence_panel(spark)
    scaler = S.scaler_map(S.fit_scaler(p))
    assert scaler["latitude"][0] == pytest.approx(50.5) and scaler["latitude"][1] == pytest.approx(np.arange(100).std())
    for block in (13, 5000):
        rows = S.build_sequences(p, "target_aqi_24h", scaler, block_hours=block).orderBy("timestamp").collect()
        assert len(rows) == 29 and np.array([r["seq"] for r in rows]).shape == (29, 72, 24)
        want = (np.arange(100) - 49.5) / np.arange(100).std()
        assert np.array(rows[3]["seq"])[:, 5] == pytest.approx(want[3:75], abs=1e-5) and rows[0]["y"] == 171.0
    assert S.sequence_counts(S.build_sequences(p, "target_aqi_24h", scaler), p).first()["passed"]
    gap = S.build_sequences(p.where(F.col("i") != 80), "target_aqi_24h", scaler)
    assert gap.count() == 9  # only windows that end before the missing hour
    with pytest.raises(ValueError, match="NaN or infinite"):
        S.fit_scaler(p.withColumn("ozone", F.lit(float("nan"))))


def test_ledger_life_cycle(spark):
    made = spark.createDataFrame(
        [("Lahore", "2026-01-01 00:00:00", f"{h}h", p, c, "m", "a") for h, p, c in
         ((24, 150.0, "Unhealthy for Sensitive Groups"), (48, 130.0, "Unhealthy for Sensitive Groups"), (72, 120.0, "odd"))],
        "city string, forecast_created_at string, horizon string, predicted_aqi double, predicted_category string, model_name string, model_alias string")
    made = made.withColumn("forecast_created_at", F.to_timestamp("forecast_created_at"))
    ledger = L.record(L.record(empty_ledger(spark), made), made)
    assert ledger.count() == 3
    history = spark.sql("""SELECT 'LAHORE' AS city, timestamp, aqi_current FROM VALUES (timestamp'2026-01-02 00:00:00', 160),
      (timestamp'2026-01-03 00:00:00', 135), (timestamp'2026-01-04 00:00:00', 90) t(timestamp, aqi_current)""")
    early = L.performance_summary(L.evaluate(ledger, history, F.lit("2026-01-02 01:00:00").cast("timestamp"))).orderBy("horizon_hours").collect()
    assert [r["evaluated_forecasts"] for r in early] == [1, 0, 0]
    assert early[1]["status"] == L.AWAITING and early[1]["next_maturity_at"] == "2026-01-03T00:00:00+00:00"
    done = L.evaluate(ledger, history, F.lit("2026-01-04 01:00:00").cast("timestamp"))
    rows = {r["horizon_hours"]: r for r in done.collect()}
    assert rows[24]["actual_category"] == "Unhealthy" and rows[24]["category_distance"] == 1 and not rows[24]["category_correct"]
    assert rows[48]["category_correct"] and rows[48]["absolute_error"] == 5
    assert rows[72]["category_distance"] is None and rows[72]["adjacent_category_correct"] is None
    s = {r["horizon_hours"]: r for r in L.performance_summary(done, "lahore").collect()}
    assert s[24]["within_10_aqi_pct"] == 100 and s[24]["adjacent_category_accuracy_pct"] == 100 and s[72]["adjacent_category_accuracy_pct"] is None
    assert L.current_state(ledger.unionByName(done)).where("actual_aqi IS NOT NULL").count() == 3
    assert L.performance_by_city(done).count() == 3


def _history(spark, rows=120):
    return feature_panel(spark, rows).withColumn("source", F.lit(H.BOOTSTRAP_SOURCE)).select(*H.HISTORY_COLUMNS)


def test_gap_recovery_and_refresh(spark):
    whole = _history(spark)
    cut = whole.where(F.col("timestamp") < F.lit("2026-01-05 20:00:00").cast("timestamp_ntz"))
    reading = whole.where(F.col("timestamp") == F.lit("2026-01-05 23:00:00").cast("timestamp_ntz")).withColumn("source", F.lit(H.LIVE_SOURCE))
    _, refused = H.upsert(cut, reading)
    assert refused.count() == 2
    fixed, refused = H.refresh(cut, reading, whole)
    assert refused.count() == 0 and H.validated(fixed).count() == 240
    assert {r["source"] for r in H.newest_source(fixed).collect()} == {H.LIVE_SOURCE}
    with pytest.raises(ValueError, match="too_short"):
        H.validated(whole.where(F.col("timestamp") < F.lit("2026-01-03").cast("timestamp_ntz")))


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3)) * [1.0, 5.0, 0.2] + [0, 10, -2]
    y = x @ [2.0, -0.5, 3.0] + rng.normal(size=200)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, y double")
    fitted = M.ridge("y", 200, float(y.std()), alpha=10.0, features=["a", "b", "c"]).fit(df)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 10.0 * np.eye(3), z.T @ (y - y.mean())) / x.std(0)
    betas, means, base = M.linear_terms(fitted, ["a", "b", "c"])
    assert list(betas.values()) == pytest.approx(want.tolist(), rel=1e-6)
    assert base == pytest.approx(y.mean(), rel=1e-9)
