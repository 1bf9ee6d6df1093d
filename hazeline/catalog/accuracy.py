"""Forecast accuracy over baseline forecasts of the whole panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.inputs import feature_panel, predictions, target_panel
from hazeline.catalog.registry import query
from hazeline.catalog.tables import FOLD_TABLE, FOLDS
from hazeline.operators import evaluate as E
from hazeline.operators.splits import walk_forward
from hazeline.schema import CATEGORY_ORDER

_E = "(y_true - prediction)"
_METRICS = f"""count(*) AS rows, avg(abs{_E}) AS mae, sqrt(avg({_E} * {_E})) AS rmse,
  CASE WHEN min(y_true) = max(y_true) THEN CASE WHEN sum({_E} * {_E}) = 0 THEN 1.0 ELSE 0.0 END
    ELSE 1 - sum({_E} * {_E}) / (var_pop(y_true) * count(*)) END AS r2"""
_R = "mae rmse r2"


@query("m1_persistence", "SELECT city, timestamp, aqi_current, aqi_current::DOUBLE AS prediction FROM named", "prediction")
def persistence(spark, folder):
    return E.persistence(target_panel(spark, folder)).select("city", "timestamp", "aqi_current", "prediction")


@query("e1_metrics", f"SELECT horizon_hours, model, {_METRICS} FROM predictions GROUP BY horizon_hours, model", _R)
def metrics(spark, folder):
    return E.metrics(predictions(spark, folder), ["horizon_hours", "model"])


_CORRECT = f"{S.prediction_category('y_true')} = {S.prediction_category('prediction')}"
_FULL = _METRICS + f""", median(abs{_E}) AS median_absolute_error, avg(y_true) AS mean_actual_aqi, avg(prediction) AS mean_predicted_aqi,
  {', '.join(f"count(*) FILTER (WHERE abs{_E} <= {k})::DOUBLE / count(*) * 100 AS within_{k}_aqi_pct" for k in E.TOLERANCES)},
  count(*) FILTER (WHERE {_CORRECT})::DOUBLE / count(*) * 100 AS category_accuracy_pct"""
_RF = _R + (" median_absolute_error mean_actual_aqi mean_predicted_aqi within_5_aqi_pct within_10_aqi_pct within_20_aqi_pct "
            "within_30_aqi_pct category_accuracy_pct")


@query("e2_accuracy", f"SELECT horizon_hours, model, {_FULL} FROM predictions GROUP BY horizon_hours, model", _RF)
def accuracy(spark, folder):
    return E.accuracy(predictions(spark, folder), ["horizon_hours", "model"])


@query("e3_accuracy_by_city", f"SELECT horizon_hours, model, city, {_FULL} FROM predictions GROUP BY horizon_hours, model, city", _RF)
def by_city(spark, folder):
    return E.accuracy(predictions(spark, folder), ["horizon_hours", "model", "city"])


@query("e4_confusion", f"""
SELECT horizon_hours, model, {S.prediction_category('y_true')} AS actual_category,
  {', '.join(f"count(*) FILTER (WHERE {S.prediction_category('prediction')} = '{c}') AS predicted_{c.lower().replace(' ', '_')}" for c in CATEGORY_ORDER)}
FROM predictions GROUP BY ALL""")
def confusion(spark, folder):
    return E.confusion(predictions(spark, folder), ["horizon_hours", "model"])


@query("e5_enriched_rows", f"""
SELECT city, timestamp, horizon_hours, model, y_true, prediction, abs{_E} AS absolute_error, {S.prediction_category('y_true')} AS actual_category,
  {S.prediction_category('prediction')} AS predicted_category, {', '.join(f'abs{_E} <= {k} AS within_{k}' for k in E.TOLERANCES)},
  {_CORRECT} AS category_correct FROM predictions""", "y_true prediction absolute_error")
def enriched(spark, folder):
    return E.enrich(predictions(spark, folder))


@query("e6_improvement", f"""
WITH m AS (SELECT horizon_hours, model, {_METRICS} FROM predictions GROUP BY horizon_hours, model)
SELECT a.*, b.mae AS baseline_mae, (b.mae - a.mae) / nullif(b.mae, 0) * 100 AS improvement_pct
FROM m a JOIN m b USING (horizon_hours) WHERE a.model <> 'persistence' AND b.model = 'persistence'""", _R + " baseline_mae improvement_pct")
def improvement(spark, folder):
    return E.improvement(E.metrics(predictions(spark, folder), ["horizon_hours", "model"]))


def fold_metrics(spark, folder):
    models = {"persistence": F.col("aqi_current"), "mean_24h": F.col("aqi_rolling_mean_24h"), "mean_12h": F.col("aqi_rolling_mean_12h")}
    rows = walk_forward(feature_panel(spark, folder), FOLDS).where(F.col("role") == "validation")
    long = E.long_predictions(rows.withColumn("city", F.concat_ws("|", "fold", "city")), models)
    long = long.withColumn("fold", F.substring_index("city", "|", 1))
    return E.metrics(long, ["fold", "horizon_hours", "model"]).withColumn("fit_seconds", F.lit(0.0))


_FOLDS = f"""{FOLD_TABLE},
fold_rows AS (SELECT f.fold, x.* FROM features x JOIN folds f ON x.timestamp BETWEEN f.a AND f.b WHERE f.role = 'validation'),
fold_long AS ({' UNION ALL '.join(f"SELECT fold, {h} AS horizon_hours, '{m}' AS model, target_aqi_{h}h::DOUBLE AS y_true, {c}::DOUBLE AS prediction FROM fold_rows"
    for h in (24, 48, 72) for m, c in (('persistence', 'aqi_current'), ('mean_24h', 'aqi_rolling_mean_24h'), ('mean_12h', 'aqi_rolling_mean_12h')))}),
fold_metrics AS (SELECT fold, horizon_hours, model, {_METRICS} FROM fold_long WHERE y_true IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL),
agg AS (SELECT horizon_hours, model, count(DISTINCT fold) AS folds, round(avg(mae), 4) AS mean_mae, round(stddev_samp(mae), 4) AS std_mae,
  round(max(mae), 4) AS worst_mae, round(min(mae), 4) AS best_mae, round(avg(rmse), 4) AS mean_rmse, round(stddev_samp(rmse), 4) AS std_rmse,
  round(avg(r2), 4) AS mean_r2, round(min(r2), 4) AS worst_r2, 0::DOUBLE AS total_fit_seconds FROM fold_metrics GROUP BY horizon_hours, model)"""
_RA = "mean_mae std_mae worst_mae best_mae mean_rmse std_rmse mean_r2 worst_r2 total_fit_seconds"


@query("e7_fold_aggregate", f"WITH {_FOLDS} SELECT * FROM agg", _RA)
def fold_aggregate(spark, folder):
    return E.fold_aggregate(fold_metrics(spark, folder))


@query("e8_model_rank", f"""WITH {_FOLDS}
SELECT horizon_hours, model, mean_mae, dense_rank() OVER (PARTITION BY horizon_hours ORDER BY mean_mae)::INT AS rank_by_mean_mae FROM agg""", "mean_mae")
def model_rank(spark, folder):
    ranked = E.rank_models(E.fold_aggregate(fold_metrics(spark, folder)))
    return ranked.select("horizon_hours", "model", "mean_mae", "rank_by_mean_mae")


@query("e9_champions", f"""WITH {_FOLDS}
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY horizon_hours ORDER BY mean_mae, worst_mae, std_mae, model) AS rn FROM agg)
WHERE rn = 1""", _RA)
def champions(spark, folder):
    return E.champions(E.fold_aggregate(fold_metrics(spark, folder)))


def _validation_and_test(spark, folder):
    m = fold_metrics(spark, folder)
    val = m.where(F.col("fold") == "fold_1").select("horizon_hours", "model", *[F.col(c).alias(f"val_{c}") for c in ("mae", "rmse", "r2")])
    test = m.where(F.col("fold") == "fold_2").select("horizon_hours", "model", *[F.col(c).alias(f"test_{c}") for c in ("mae", "rmse", "r2")])
    return val.join(test, ["horizon_hours", "model"])


@query("e10_single_split_champions", f"""WITH {_FOLDS}
SELECT * EXCLUDE (rn) FROM (SELECT v.horizon_hours, v.model, v.mae AS val_mae, v.rmse AS val_rmse, v.r2 AS val_r2, t.mae AS test_mae,
    t.rmse AS test_rmse, t.r2 AS test_r2, row_number() OVER (PARTITION BY v.horizon_hours ORDER BY v.mae, v.rmse, v.r2 DESC, v.model) AS rn
  FROM fold_metrics v JOIN fold_metrics t ON t.horizon_hours = v.horizon_hours AND t.model = v.model AND t.fold = 'fold_2'
  WHERE v.fold = 'fold_1') WHERE rn = 1""", "val_mae val_rmse val_r2 test_mae test_rmse test_r2")
def single_split(spark, folder):
    return E.single_split_champions(_validation_and_test(spark, folder))


@query("e11_common_rows", """
SELECT city, timestamp, horizon_hours, y_true, 0::DOUBLE AS target_spread, p AS persistence_prediction, m AS mean_24h_prediction FROM (
  SELECT city, timestamp, horizon_hours, max(y_true) AS y_true, max(prediction) FILTER (WHERE model = 'persistence') AS p,
    max(prediction) FILTER (WHERE model = 'mean_24h') AS m FROM predictions GROUP BY ALL) WHERE p IS NOT NULL AND m IS NOT NULL""",
       "y_true target_spread persistence_prediction mean_24h_prediction")
def common_rows(spark, folder):
    return E.common_rows(predictions(spark, folder), ["persistence", "mean_24h"])


@query("e11_paired_comparison", f"""
WITH shared AS (SELECT city, timestamp, horizon_hours FROM predictions GROUP BY ALL HAVING count(DISTINCT model) = 2)
SELECT horizon_hours, model, {_METRICS} FROM predictions JOIN shared USING (city, timestamp, horizon_hours) GROUP BY horizon_hours, model""", _R)
def paired(spark, folder):
    return E.paired_comparison(predictions(spark, folder), ["persistence", "mean_24h"])
