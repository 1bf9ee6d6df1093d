"""The forecast ledger over the whole panel's forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.accuracy import _FULL, _RF
from hazeline.catalog.inputs import aqi_panel, events, feature_panel, predictions
from hazeline.catalog.registry import query
from hazeline.operators import evaluate as E
from hazeline.operators import ledger as L
from hazeline.operators.targets import build_aqi
from hazeline.schema import HORIZONS, LEDGER_KEYS
from hazeline.session import work_dir, written
from hazeline.sources.landed import read_ledger

NOW = "2024-01-29 12:00:00"


def _forecasts(spark, folder):
    """The 24-hour mean as the forecast of every hour, at three horizons, as a stored batch."""
    rows = feature_panel(spark, folder).where(F.col("aqi_rolling_mean_24h").isNotNull())
    made = rows.select(
        "city",
        F.col("timestamp").cast("timestamp").alias("forecast_created_at"),
        F.explode(F.array(*[F.lit(f"{h}H") for h in HORIZONS])).alias("horizon"),
        F.col("aqi_rolling_mean_24h").alias("predicted_aqi"),
    ).withColumns({
        "predicted_category": F.lit("Moderate"),
        "model_name": F.lit("mean_24h"),
        "model_alias": F.concat(F.lit("production-"), F.lower("horizon")),
    })
    return written(made, "forecasts")


_FORECASTS = f"""made AS (
  SELECT city, timestamp AS forecast_created_at, timestamp + to_hours(h) AS target_timestamp, h::INT AS horizon_hours,
    aqi_rolling_mean_24h AS predicted_aqi, 'Moderate' AS predicted_category, 'mean_24h' AS model_name, 'production-' || h || 'h' AS model_alias
  FROM features, (VALUES (24), (48), (72)) t(h) WHERE aqi_rolling_mean_24h IS NOT NULL)"""

_SCORED = f"""{_FORECASTS},
scored AS (SELECT m.*, CASE WHEN due THEN a.aqi_current::DOUBLE END AS actual_aqi,
    CASE WHEN due THEN {S.category('a.aqi_current')} END AS actual_category,
    CASE WHEN due THEN abs(a.aqi_current - predicted_aqi) END AS absolute_error,
    CASE WHEN due THEN {S.category('a.aqi_current')} = predicted_category END AS category_correct,
    CASE WHEN due THEN abs({S.rank_of(S.category('a.aqi_current'))} - {S.rank_of('predicted_category')}) END AS category_distance,
    CASE WHEN due THEN abs({S.rank_of(S.category('a.aqi_current'))} - {S.rank_of('predicted_category')}) <= 1 END AS adjacent_category_correct,
    CASE WHEN due THEN TIMESTAMP '{NOW}' END AS evaluated_at
  FROM (SELECT m.*, a.aqi_current IS NOT NULL AND target_timestamp <= TIMESTAMP '{NOW}' AS due FROM made m
    LEFT JOIN named a ON a.city = m.city AND a.timestamp = m.target_timestamp) m
  LEFT JOIN named a ON a.city = m.city AND a.timestamp = m.target_timestamp)"""
_SCORED = _SCORED.replace("SELECT m.*, CASE", "SELECT m.* EXCLUDE (due), CASE")


def _recorded(spark, folder):
    """A ledger that already holds the 24-hour forecasts receives all of them again together with the others."""
    made = _forecasts(spark, folder)
    known = L.new_records(made.where(F.col("horizon") == "24H"))
    return L.record(known, made)


def _evaluated(spark, folder):
    """The scored ledger as the stored table it is in use, so that reports read it instead of rebuilding it."""
    history = build_aqi_history(spark, folder)
    scored = L.evaluate(_recorded(spark, folder), history, F.lit(NOW).cast("timestamp"))
    return written(scored, "ledger")


def build_aqi_history(spark, folder):
    return aqi_panel(spark, folder).select(F.upper("city").alias("city"), "timestamp", "aqi_current")


@query("l1_normalised_ledger", """
SELECT event_type AS city, CASE WHEN event_id % 7 <> 0 THEN CAST(date_trunc('second', ts) AS TIMESTAMP) END AS forecast_created_at,
  NULL::TIMESTAMP AS target_timestamp, 24 AS horizon_hours, CASE WHEN event_id % 11 <> 0 THEN value END AS predicted_aqi,
  NULL::VARCHAR AS predicted_category, 'm' AS model_name, NULL::VARCHAR AS model_alias, NULL::DOUBLE AS actual_aqi, NULL::VARCHAR AS actual_category,
  NULL::DOUBLE AS absolute_error, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false END AS category_correct,
  NULL::INT AS category_distance, NULL::BOOLEAN AS adjacent_category_correct, NULL::TIMESTAMP AS evaluated_at FROM events""",
       "predicted_aqi actual_aqi absolute_error")
def normalised(spark, folder):
    e = F.col("event_id")
    text = events(spark, folder).select(
        F.col("event_type").alias("city"),
        F.when(e % 7 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("forecast_created_at"),
        F.lit("24.0").alias("horizon_hours"),
        F.when(e % 11 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("predicted_aqi"),
        F.lit("m").alias("model_name"),
        F.element_at(F.array(*map(F.lit, [" TRUE", "1", "no", "False ", "maybe"])), (e % 5 + 1).cast("int")).alias("category_correct"),
        F.lit("extra").alias("other"),
    )
    return L.normalise(text)


_NULLS = """NULL::DOUBLE AS actual_aqi, NULL::VARCHAR AS actual_category, NULL::DOUBLE AS absolute_error, NULL::BOOLEAN AS category_correct,
  NULL::INT AS category_distance, NULL::BOOLEAN AS adjacent_category_correct, NULL::TIMESTAMP AS evaluated_at"""


@query("l2_j9_recorded", f"WITH {_FORECASTS} SELECT *, {_NULLS} FROM made", "predicted_aqi actual_aqi absolute_error")
def recorded(spark, folder):
    return _recorded(spark, folder)


@query("j9_new_forecasts", f"WITH {_FORECASTS} SELECT city, forecast_created_at, horizon_hours FROM made WHERE horizon_hours <> 24")
def new_forecasts(spark, folder):
    made = _forecasts(spark, folder)
    known = L.new_records(made.where(F.col("horizon") == "24H"))
    return L.new_records(made).join(known.select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti").select(*LEDGER_KEYS)


@query("l3_j8_evaluated", f"WITH {_SCORED} SELECT * FROM scored", "predicted_aqi actual_aqi absolute_error")
def evaluated(spark, folder):
    return _evaluated(spark, folder)


def _summary(by: str) -> str:
    return f"""{by} count(actual_aqi) AS evaluated_forecasts, avg(absolute_error) AS mae,
  sqrt(avg((actual_aqi - predicted_aqi) * (actual_aqi - predicted_aqi))) AS rmse,
  {', '.join(f"count(*) FILTER (WHERE actual_aqi IS NOT NULL AND absolute_error <= {k})::DOUBLE / nullif(count(actual_aqi), 0) * 100 AS within_{k}_aqi_pct" for k in (10, 20, 30))},
  avg(category_correct::INT) * 100 AS category_accuracy_pct, avg(adjacent_category_correct::INT) * 100 AS adjacent_category_accuracy_pct,
  CASE WHEN count(actual_aqi) > 0 THEN '{L.AVAILABLE}' ELSE '{L.AWAITING}' END AS status,
  strftime(min(target_timestamp) FILTER (WHERE actual_aqi IS NULL), '%Y-%m-%dT%H:%M:%S+00:00') AS next_maturity_at FROM scored GROUP BY"""


_RL = "mae rmse within_10_aqi_pct within_20_aqi_pct within_30_aqi_pct category_accuracy_pct adjacent_category_accuracy_pct"


@query("l4_j11_performance_summary", f"WITH {_SCORED} SELECT {_summary('horizon_hours,')} horizon_hours", _RL)
def performance(spark, folder):
    return L.performance_summary(_evaluated(spark, folder))


@query("l4_performance_by_city", f"WITH {_SCORED} SELECT {_summary('city, horizon_hours,')} city, horizon_hours", _RL)
def performance_by_city(spark, folder):
    return L.performance_by_city(_evaluated(spark, folder))


_HOLDOUT = "SELECT * EXCLUDE (model) FROM (SELECT horizon_hours, model, " + _FULL + " FROM predictions WHERE model = 'persistence' GROUP BY horizon_hours, model)"
_HOLD = ["rows", *_RF.split()]

COMBINED_SQL = f"""WITH {_SCORED}, live AS (SELECT {_summary('city, horizon_hours,')} city, horizon_hours), hold AS ({_HOLDOUT})
SELECT live.*, sum(evaluated_forecasts) OVER (PARTITION BY city)::BIGINT AS live_evaluated_forecasts,
  CASE WHEN sum(evaluated_forecasts) OVER (PARTITION BY city) > 0 THEN '{L.AVAILABLE}' ELSE '{L.AWAITING}' END AS live_status,
  {', '.join(f'hold.{c} AS holdout_{c}' for c in _HOLD)} FROM live LEFT JOIN hold USING (horizon_hours)"""
COMBINED_DOUBLES = _RL + " " + " ".join(f"holdout_{c}" for c in _RF.split())


def holdout(spark, folder):
    """Accuracy of the baseline per horizon, standing for a held-out evaluation."""
    base = predictions(spark, folder).where(F.col("model") == "persistence")
    return E.accuracy(base, ["horizon_hours"])


@query("l5_combined_performance", COMBINED_SQL, COMBINED_DOUBLES)
def combined(spark, folder):
    return L.combined_performance(_evaluated(spark, folder), holdout(spark, folder))


@query("l6_monitoring_history", "SELECT city, timestamp, aqi_current, aqi_category, dominant_pollutant FROM named")
def monitoring(spark, folder):
    return L.monitoring_history(aqi_panel(spark, folder))


@query("l6_newest_agreement", """
SELECT city, timestamp, aqi_current AS pipeline_aqi, aqi_current AS history_aqi, true AS matches FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM named WHERE aqi_current IS NOT NULL) WHERE rn = 1""")
def agreement(spark, folder):
    """Newest feature row against the full-history build."""
    from hazeline.catalog.inputs import panel
    from hazeline.operators.features import latest_per_city

    latest = latest_per_city(feature_panel(spark, folder))
    return L.newest_agreement(L.monitoring_history(build_aqi(panel(spark, folder))), latest)


@query("s9_ledger_files", f"WITH {_SCORED} SELECT * FROM scored", "predicted_aqi actual_aqi absolute_error")
def ledger_files(spark, folder):
    """The scored ledger through CSV and back."""
    path = work_dir(spark, "ledger") + ".csv"
    _evaluated(spark, folder).write.option("header", True).csv(path)
    return read_ledger(spark, path)
