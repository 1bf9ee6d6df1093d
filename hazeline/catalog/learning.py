"""Models, their reports, and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.inputs import aqi_panel, feature_table, panel, sparse
from hazeline.catalog.ledger import _FORECASTS, NOW, _forecasts as forecast_batch
from hazeline.catalog.registry import query
from hazeline.catalog.tables import FOLDS
from hazeline.operators import models as M
from hazeline.operators.features import latest_per_city
from hazeline.operators.history import BOOTSTRAP_SOURCE
from hazeline.operators.ledger import SCORED, new_records
from hazeline.operators.splits import walk_forward
from hazeline.plans.reports import forecast_report
from hazeline.operators.explain import linear_contributions
from hazeline.schema import FEATURES, HISTORY_COLUMNS, KEYS, POLLUTANTS, WEATHER
from hazeline.session import work_dir, written
from hazeline.sources.landed import write_report
from hazeline.streaming import jobs as T

# The published sizes are the defaults of the model functions; these keep a run over the small tables short.
QUICK = M.TreeSize(forest_trees=10, forest_depth=6, boosted_trees=5, boosted_depth=3)


def _sides(spark, folder, fold=0):
    rows = walk_forward(feature_table(spark, folder), FOLDS[fold:fold + 1])
    return (M.model_rows(rows.where(F.col("role") == "train")),
            M.model_rows(rows.where(F.col("role") != "train")))


def _one(spark, folder, name, horizon=24):
    train, evaluation = _sides(spark, folder)
    return M.train_and_evaluate(name, horizon, train, {"validation": evaluation}, QUICK)[1].drop("fit_seconds")


@query("m2_ridge")
def ridge(spark, folder):
    return _one(spark, folder, "ridge")


@query("m3_random_forest")
def forest(spark, folder):
    return _one(spark, folder, "random_forest")


@query("m4_boosted_trees")
def boosted(spark, folder):
    return _one(spark, folder, "boosted_trees")


@query("m5_train_and_evaluate")
def train_and_evaluate(spark, folder):
    train, validation = _sides(spark, folder)
    _, test = _sides(spark, folder, 1)
    return M.train_and_evaluate("ridge", 48, train, {"validation": validation, "test": test})[1].drop("fit_seconds")


@query("m6_walk_forward_benchmark")
def benchmark(spark, folder):
    labelled = walk_forward(feature_table(spark, folder), FOLDS)
    return M.walk_forward_benchmark(labelled, ["persistence", "ridge"], ["fold_1", "fold_2"]).drop("fit_seconds")


@query("m7_s12_training_report")
def training_report(spark, folder):
    """Candidate metrics of the last fold as a nested JSON report, read back."""
    labelled = walk_forward(feature_table(spark, folder), FOLDS)
    scores = M.walk_forward_benchmark(labelled, ["persistence", "ridge"], ["fold_2"])
    report = scores.agg(
        F.lit("candidate").alias("status"), F.lit(len(FEATURES)).alias("feature_count"), F.lit(False).alias("promoted"),
        F.array_sort(F.collect_list(F.struct("horizon_hours", "model", "mae", "rmse", "r2"))).alias("results"))
    path = work_dir(spark, "report")
    write_report(report, path)
    back = spark.read.schema(report.schema).json(path)
    return back.select("status", "feature_count", "promoted", F.explode("results").alias("r")).select(
        "status", "feature_count", "promoted", "r.*")


def _fitted(spark, folder):
    train, evaluation = _sides(spark, folder)
    models = {h: M.create("ridge", train, f"target_aqi_{h}h").fit(train) for h in (24, 48, 72)}
    return train, evaluation, models


@query("m8_m9_batch_scoring")
def batch_scoring(spark, folder):
    """Models saved per horizon, loaded again, and applied to the newest row of every city."""
    table = feature_table(spark, folder)
    _, _, models = _fitted(spark, folder)
    path = work_dir(spark, "models")
    M.save_models(models, path)
    newest = latest_per_city(table).select(
        *KEYS, "aqi_current", "aqi_category", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    scored = M.score_all(newest, M.load_models(path), "ridge")
    return scored.select(*KEYS, "horizon", "predicted_aqi", "predicted_category", "model_name", "model_alias")


@query("m10_model_parity")
def model_parity(spark, folder):
    _, evaluation, models = _fitted(spark, folder)
    path = work_dir(spark, "models")
    M.save_models({24: models[24]}, path)
    again = M.load_models(path, [24])[24]
    return M.model_parity(models[24].transform(evaluation), again.transform(evaluation), KEYS)


@query("e13_final_holdout")
def final_holdout(spark, folder):
    train, test = _sides(spark, folder, 1)
    return M.holdout_report(M.holdout_predictions(train, test, "ridge"))


@query("r2_explained_forecast_report")
def explained_report(spark, folder):
    """Scores and contributions of fitted models on every city's newest row."""
    table = feature_table(spark, folder)
    _, _, models = _fitted(spark, folder)
    newest = latest_per_city(table).select(
        *KEYS, "aqi_current", "aqi_category", "dominant_pollutant", *[F.col(c).cast("double").alias(c) for c in FEATURES])
    parts = []
    for h, model in models.items():
        betas, means, _ = M.linear_terms(model)
        parts.append(linear_contributions(newest, betas, means).withColumn("horizon_hours", F.lit(h)))
    contributions = parts[0].unionByName(parts[1]).unionByName(parts[2])
    report = forecast_report(M.score_all(newest, models, "ridge"), contributions)
    rows = report.select(*KEYS, "current_aqi", F.explode("forecasts").alias("f"))
    return rows.select(*KEYS, "current_aqi", "f.horizon_hours", "f.predicted_aqi", "f.predicted_category",
                       F.col("f.alert.level").alias("alert"), F.col("f.explanation")[0]["feature"].alias("top_feature"))


# Streams ----------------------------------------------------------------------------------------------------------


def _reading_stream(spark, folder):
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    stream = T.file_stream(spark, folder, schema, "events.parquet")
    return stream.select(
        F.col("event_type").alias("city"), F.col("ts").cast("timestamp").alias("observed_at"),
        F.col("event_id").alias("reading_id"), "value")


@query("t1_hourly_readings_stream", """
SELECT city, timestamp, event_id AS reading_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY city, timestamp ORDER BY ts DESC, event_id DESC) AS rn FROM readings) WHERE rn = 1""", "value")
def hourly_stream(spark, folder):
    path = work_dir(spark, "t1")
    T.hourly_readings(_reading_stream(spark, folder), path, work_dir(spark, "t1-progress"))
    return T.latest_readings(spark.read.parquet(path)).select("city", "timestamp", "reading_id", "value")


_T2 = f"""
SELECT city, timestamp, m25 AS pm2_5_24h_mean, m10 AS pm10_24h_mean, greatest(a, b) AS aqi_current FROM (
  SELECT *, {S.pm25_index('m25')} AS a, {S.pm10_index('m10')} AS b FROM (
    SELECT city, timestamp, count(*) OVER w AS n, CAST(sum(pm2_5) OVER w AS DOUBLE) / 24::DOUBLE AS m25, CAST(sum(pm10) OVER w AS DOUBLE) / 24::DOUBLE AS m10
    FROM {{table}} WINDOW w AS (PARTITION BY city ORDER BY timestamp RANGE BETWEEN INTERVAL 23 HOUR PRECEDING AND CURRENT ROW)) WHERE n = 24)"""


@query("t2_trailing_aqi_stream", _T2.format(table="panel"), "pm2_5_24h_mean pm10_24h_mean")
def trailing_stream(spark, folder):
    rows = panel(spark, folder).select("city", F.col("timestamp").cast("timestamp").alias("timestamp"), "pm2_5", "pm10")
    source = T.land(rows, "t2-source")
    path = work_dir(spark, "t2")
    T.trailing_aqi(T.file_stream(spark, source, rows.schema), path, work_dir(spark, "t2-progress"))
    return T.latest_trailing_aqi(spark, path).select("city", "timestamp", "pm2_5_24h_mean", "pm10_24h_mean", "aqi_current")


_T3 = f"""
WITH {_FORECASTS}
SELECT m.*, a.aqi_current::DOUBLE AS actual_aqi, {S.category('a.aqi_current')} AS actual_category, abs(a.aqi_current - predicted_aqi) AS absolute_error,
  {S.category('a.aqi_current')} = predicted_category AS category_correct,
  abs({S.rank_of(S.category('a.aqi_current'))} - {S.rank_of('predicted_category')}) AS category_distance,
  abs({S.rank_of(S.category('a.aqi_current'))} - {S.rank_of('predicted_category')}) <= 1 AS adjacent_category_correct,
  TIMESTAMP '{NOW}' AS evaluated_at
FROM made m JOIN named a ON a.city = m.city AND a.timestamp = m.target_timestamp WHERE a.aqi_current IS NOT NULL"""


def _maturity(spark, folder):
    """Three horizons of forecasts and all hours, in files of mixed order; every fifth hour is first observed wrongly."""
    made = new_records(forecast_batch(spark, folder)).drop(*SCORED)
    hours = aqi_panel(spark, folder).where(F.col("aqi_current").isNotNull()).select(
        F.upper("city").alias("city"), F.col("timestamp").cast("timestamp").alias("timestamp"), F.col("aqi_current").cast("double").alias("aqi_current"))
    final = hours.withColumn("observed_at", F.col("timestamp") + F.expr("INTERVAL 40 MINUTES"))
    wrong = hours.where(F.hour("timestamp") % 5 == 0).withColumn("aqi_current", F.col("aqi_current") + 60.0)
    wrong = wrong.withColumn("observed_at", F.col("timestamp") + F.expr("INTERVAL 5 MINUTES"))
    path, files = work_dir(spark, "t3"), 3
    sides = [T.file_stream(spark, T.land(df.repartition(files, F.xxhash64(*df.columns)), "t3-source"), df.schema, files_per_batch=1)
             for df in (made, final.unionByName(wrong))]
    T.matured_forecasts(*sides, path, work_dir(spark, "t3-progress"), F.lit(NOW))
    return path


@query("t3_matured_forecasts_stream", _T3, "predicted_aqi actual_aqi absolute_error")
def maturity_stream(spark, folder):
    return T.latest_scores(spark, _maturity(spark, folder))


@query("t3_pending_forecasts", f"""
WITH {_FORECASTS} SELECT m.* FROM made m LEFT JOIN named a ON a.city = m.city AND a.timestamp = m.target_timestamp
WHERE a.aqi_current IS NULL""", "predicted_aqi")
def pending_stream(spark, folder):
    return T.pending_forecasts(spark, _maturity(spark, folder))


_LIVE = "TIMESTAMP '2024-01-29 00:00:00'"
_COLS = ", ".join(c for c in HISTORY_COLUMNS if c != "source")


@query("t1_live_history_stream", f"""
WITH merged AS (SELECT *, CASE WHEN timestamp >= {_LIVE} THEN 'openweather_live' ELSE 'open_meteo_bootstrap' END AS source FROM panel
  WHERE city <> 'view' OR timestamp < {_LIVE} + INTERVAL 10 HOUR)
SELECT {_COLS}, source FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM merged) WHERE rn <= 168""",
       "latitude longitude pm2_5 pm10 carbon_monoxide")
def live_history_stream(spark, folder):
    """Two days of weather and pollution readings in files of mixed order; of one city a pollution hour never comes."""
    p = written(panel(spark, folder), "panel")
    cut = F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")
    history = p.where(F.col("timestamp") < cut).withColumn("source", F.lit(BOOTSTRAP_SOURCE)).select(*HISTORY_COLUMNS)
    live = p.where(F.col("timestamp") >= cut)

    def stream(columns, minutes, rows):
        taken = (F.col("timestamp").cast("timestamp") + F.make_interval(mins=F.lit(minutes))).alias("observed_at")
        rows = rows.select("city", taken, *columns)
        source = T.land(rows.repartition(4, F.xxhash64("city", "observed_at")), "t1-source")
        return T.file_stream(spark, source, rows.schema, files_per_batch=2)

    hole = (F.col("city") == "view") & (F.col("timestamp") == F.lit("2024-01-29 10:00:00").cast("timestamp_ntz"))
    cities = p.groupBy("city").agg(F.first("latitude").alias("latitude"), F.first("longitude").alias("longitude"))
    path = work_dir(spark, "t1-history")
    T.live_history(stream(WEATHER, 7, live), stream(POLLUTANTS, 20, live.where(~hole)), cities, history, path, work_dir(spark, "t1-progress"))
    return T.live_state(spark, path, history)


@query("t4_gap_alarm_stream", """
SELECT r.city, max(r.timestamp) AS reading, count(*) AS readings, max(h.latest) AS latest_history,
  date_diff('hour', max(h.latest), max(r.timestamp))::BIGINT AS gap_hours
FROM readings r LEFT JOIN (SELECT city, max(timestamp) AS latest FROM sparse WHERE timestamp < TIMESTAMP '2024-01-29 00:00:00' GROUP BY city) h USING (city)
GROUP BY r.city HAVING date_diff('hour', max(h.latest), max(r.timestamp)) > 1""")
def gap_stream(spark, folder):
    stored = sparse(spark, folder).where(F.col("timestamp") < F.lit("2024-01-29 00:00:00").cast("timestamp_ntz"))
    path = work_dir(spark, "t4")
    T.newest_readings(_reading_stream(spark, folder), path, work_dir(spark, "t4-progress"))
    return T.gap_alarms(spark.read.parquet(path), stored.select(*KEYS))
