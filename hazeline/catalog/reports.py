"""Reports, explanations, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazeline.catalog import twin as S
from hazeline.catalog.inputs import events, feature_panel, feature_table, panel
from hazeline.catalog.ledger import COMBINED_DOUBLES, COMBINED_SQL, _evaluated, holdout
from hazeline.catalog.registry import query
from hazeline.operators import explain as X
from hazeline.operators import sequences as Q
from hazeline.operators.features import newest_features
from hazeline.operators.targets import build_aqi, recent_rows
from hazeline.plans import reports as R
from hazeline.schema import BASE_FEATURES, CITIES, FEATURES, HORIZONS, TARGETS, city_dimension

_STATS = """min(timestamp) AS start_time, max(timestamp) AS end_time, {h}::INT AS requested_hours, count(*) AS available_hours,
  min(aqi_current)::DOUBLE AS minimum, max(aqi_current)::DOUBLE AS maximum, avg(aqi_current) AS average, stddev_pop(aqi_current) AS standard_deviation"""


def _report_sql(h):
    return f"""SELECT city, {_STATS.format(h=h)} FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn
  FROM named WHERE aqi_current IS NOT NULL) WHERE rn <= {h} GROUP BY city"""


@query("r1_history_report", _report_sql(168), "minimum maximum average standard_deviation")
def history_report(spark, folder):
    return R.history_report(build_aqi(recent_rows(panel(spark, folder), 168)), 168, observations=False)


@query("r1_history_observations", """
SELECT city, timestamp, aqi_current, aqi_category, pm2_5, ozone FROM (
  SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM named WHERE aqi_current IS NOT NULL) WHERE rn <= 24""", "pm2_5")
def observations(spark, folder):
    report = R.history_report(build_aqi(recent_rows(panel(spark, folder), 24)), 24)
    rows = report.select("city", F.explode("observations").alias("o"))
    return rows.select("city", "o.timestamp", "o.aqi_current", "o.aqi_category", "o.pm2_5", "o.ozone")


@query("r3_performance_report", COMBINED_SQL, COMBINED_DOUBLES)
def performance_report(spark, folder):
    return R.performance_report(_evaluated(spark, folder), holdout(spark, folder))


_NAMES = [c for c, _, _ in CITIES]
_CASES = " ".join(f"WHEN event_id % 10 = {i} THEN '{n}'" for i, n in enumerate(_NAMES))


@query("r5_resolve_cities", f"SELECT event_id, CASE {_CASES} END AS canonical, event_id % 10 <> 9 AS supported FROM events")
def resolve(spark, folder):
    """Every event asks for a city in untidy spelling; every tenth for one that is not supported."""
    name = F.try_element_at(F.array(*map(F.lit, [*_NAMES, "Atlantis"])), (F.col("event_id") % 10 + 1).cast("int"))
    untidy = F.concat(F.lit("  "), F.upper(F.regexp_replace(name, " ", "   ")), F.lit("\t"))
    asked = events(spark, folder).select("event_id", untidy.alias("requested"))
    return R.resolve_cities(asked, city_dimension(spark)).select("event_id", "canonical", "supported")


def _persistence_scores(rows):
    cells = F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon_hours")
    from hazeline.functions import aqi

    return rows.select("city", "timestamp", "aqi_current", "aqi_category", "dominant_pollutant", cells).withColumns({
        "predicted_aqi": F.col("aqi_current").cast("double"),
        "predicted_category": aqi.category_of_prediction(F.col("aqi_current")),
        "model_name": F.lit("persistence"), "model_alias": F.lit("baseline"),
    })


_NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY timestamp DESC) AS rn FROM features
  WHERE aqi_current IS NOT NULL) WHERE rn = 1)"""


@query("r2_forecast_report", f"""WITH {_NEWEST}
SELECT city, timestamp, aqi_current AS current_aqi, aqi_category AS current_category, h::INT AS horizon_hours, timestamp + to_hours(h) AS target_at,
  aqi_current::DOUBLE AS predicted_aqi, {S.category('aqi_current')} AS predicted_category,
  (CASE WHEN aqi_current <= 50 THEN 0 WHEN aqi_current <= 100 THEN 1 WHEN aqi_current <= 150 THEN 2 WHEN aqi_current <= 200 THEN 3
    WHEN aqi_current <= 300 THEN 4 ELSE 5 END)::INT AS severity FROM newest, (VALUES (24), (48), (72)) t(h)""", "predicted_aqi")
def forecast_report(spark, folder):
    report = R.forecast_report(_persistence_scores(newest_features(panel(spark, folder))))
    rows = report.select("city", "timestamp", "current_aqi", "current_category", F.explode("forecasts").alias("f"))
    return rows.select("city", "timestamp", "current_aqi", "current_category", "f.horizon_hours", "f.target_at", "f.predicted_aqi",
                       "f.predicted_category", F.col("f.alert.severity").alias("severity"))


@query("r8_run_summary", f"""WITH {_NEWEST}
SELECT city, true AS success, 0::DOUBLE AS runtime_seconds, timestamp, aqi_current AS current_aqi, aqi_current::DOUBLE AS forecast_24h,
  aqi_current::DOUBLE AS forecast_48h, aqi_current::DOUBLE AS forecast_72h, NULL::VARCHAR AS error FROM newest""",
       "runtime_seconds forecast_24h forecast_48h forecast_72h")
def run_summary(spark, folder):
    newest = newest_features(panel(spark, folder))
    return R.run_summary(newest, R.forecast_report(_persistence_scores(newest)))


# Explanations -----------------------------------------------------------------------------------------------------

# A linear model stated outright: coefficients and column means.
COEFFICIENTS = {"aqi_lag_1h": 0.75, "pm2_5": 0.5, "humidity": -0.125, "wind_speed": -0.25, "aqi_rolling_mean_24h": 0.375, "precipitation": 2.0}
MEANS = {"aqi_lag_1h": 75.0, "pm2_5": 12.5, "humidity": 50.0, "wind_speed": 3.0, "aqi_rolling_mean_24h": 74.5, "precipitation": 0.0}
BASE_VALUE = 75.25
_CC = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, *TARGETS])
_X = "contrib AS (" + " UNION ALL ".join(
    f"SELECT city, timestamp, '{c}' AS feature, {c}::DOUBLE AS feature_value, {b}::DOUBLE * ({c}::DOUBLE - {MEANS[c]}::DOUBLE) AS contribution "
    f"FROM features WHERE {_CC}" for c, b in COEFFICIENTS.items()) + ")"


def _scored(spark, folder):
    from hazeline.operators.features import complete_rows

    return X.linear_contributions(complete_rows(feature_panel(spark, folder)), COEFFICIENTS, MEANS)


@query("x1_global_importance", f"""WITH {_X}
SELECT row_number() OVER (ORDER BY m DESC, feature)::INT AS rank, feature, m AS mean_abs_contribution FROM (
  SELECT feature, avg(abs(contribution)) AS m FROM contrib GROUP BY feature)""", "mean_abs_contribution")
def importance(spark, folder):
    return X.global_importance(_scored(spark, folder))


@query("x2_top_contributions", f"""WITH {_X}
SELECT * EXCLUDE (rn), rn::INT AS rank, CASE WHEN contribution > 0 THEN 'increase' WHEN contribution < 0 THEN 'decrease' ELSE 'neutral' END AS direction
FROM (SELECT *, row_number() OVER (PARTITION BY city, timestamp ORDER BY abs(contribution) DESC, feature) AS rn FROM contrib) WHERE rn <= 5""",
       "feature_value contribution")
def top(spark, folder):
    return X.top_contributions(_scored(spark, folder), 5)


@query("x3_additivity", f"""WITH {_X}
SELECT city, timestamp, count(*)::INT AS features, {BASE_VALUE}::DOUBLE AS base_value, {BASE_VALUE}::DOUBLE + sum(contribution) AS total
FROM contrib GROUP BY city, timestamp""", "base_value total")
def additive(spark, folder):
    return X.additivity(_scored(spark, folder), BASE_VALUE)


@query("x4_linear_contributions", f"WITH {_X} SELECT * FROM contrib", "feature_value contribution")
def contributions(spark, folder):
    return X.long_contributions(_scored(spark, folder))


# Sequences --------------------------------------------------------------------------------------------------------


@query("q1_scaler", "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({c}::DOUBLE) AS mean, CASE WHEN min({c}) = max({c}) THEN 1 ELSE stddev_pop({c}::DOUBLE) END AS scale "
    f"FROM features WHERE {_CC}" for c in BASE_FEATURES), "mean scale")
def scaler(spark, folder):
    return Q.fit_scaler(feature_table(spark, folder))


# Scaling stated outright, so that both engines scale alike.
_SCALER = {c: (0.0, 1.0) for c in BASE_FEATURES} | {"wind_speed": (1.0, 2.0), "humidity": (50.0, 4.0)}


def _sequences(spark, folder, target="target_aqi_24h"):
    return Q.build_sequences(feature_panel(spark, folder), target, _SCALER)


@query("q2_sequence_digest", """
SELECT city, timestamp, y, 72 AS steps, 24 AS width, first_wind, last_wind, humidity_sum FROM (
  SELECT city, timestamp, target_aqi_24h::DOUBLE AS y, count(*) OVER f AS n, (lag(wind_speed, 71) OVER w - 1) / 2.0 AS first_wind,
    (wind_speed - 1) / 2.0 AS last_wind, sum((humidity - 50) / 4.0) OVER f AS humidity_sum FROM features
  WINDOW w AS (PARTITION BY city ORDER BY timestamp), f AS (PARTITION BY city ORDER BY timestamp ROWS BETWEEN 71 PRECEDING AND CURRENT ROW))
WHERE n = 72 AND y IS NOT NULL""", "y first_wind last_wind humidity_sum")
def sequence_digest(spark, folder):
    seq, i, j = _sequences(spark, folder), BASE_FEATURES.index("wind_speed"), BASE_FEATURES.index("humidity")
    total = F.aggregate("seq", F.lit(0.0), lambda acc, x: acc + x[j].cast("double"))
    return seq.select("city", "timestamp", "y", F.size("seq").alias("steps"), F.size(F.col("seq")[0]).alias("width"),
                      F.col("seq")[0][i].alias("first_wind"), F.col("seq")[71][i].alias("last_wind"), total.alias("humidity_sum"))


@query("q3_sequence_counts", """
SELECT count(*) AS source_rows, count(DISTINCT city) AS cities, (count(*) - 71 * count(DISTINCT city))::BIGINT AS sequences, 0::BIGINT AS duplicates,
  (count(*) - 71 * count(DISTINCT city))::BIGINT AS expected, true AS passed FROM features WHERE timestamp <= (
  SELECT max(timestamp) FROM features WHERE target_aqi_72h IS NOT NULL)""")
def sequence_counts(spark, folder):
    """Rows up to the last hour that has every target, so that only the warm-up of each city is lost."""
    rows = feature_panel(spark, folder)
    last = rows.where(F.col("target_aqi_72h").isNotNull()).agg(F.max("timestamp").alias("_last"))
    usable = rows.join(F.broadcast(last), F.col("timestamp") <= F.col("_last")).drop("_last")
    made = Q.build_sequences(usable.withColumn("target", F.coalesce("target_aqi_72h", F.lit(0))), "target", _SCALER)
    return Q.sequence_counts(made, usable)
