"""The forecast ledger.

Plain files have no merge, so the ledger is kept as append-only versions; the newest version of a key is its state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

from hazeline.functions import aqi
from hazeline.functions.text import horizon_hours, parse_flag
from hazeline.operators.relational import dedupe
from hazeline.schema import HORIZONS, LEDGER_COLUMNS, LEDGER_KEYS, LEDGER_SCHEMA, require_columns

AWAITING = "awaiting_matured_forecasts"
AVAILABLE = "live_metrics_available"
#: What a score fills in.
SCORED = ("actual_aqi", "actual_category", "absolute_error", "category_correct", "category_distance", "adjacent_category_correct", "evaluated_at")


def _coerce(df: DataFrame, field: T.StructField) -> Column:
    if field.name not in df.columns:
        return F.lit(None).cast(field.dataType)
    c, found = F.col(field.name), df.schema[field.name].dataType
    if found == field.dataType:
        return aqi.nan_to_null(c) if isinstance(found, T.DoubleType) else c
    if isinstance(field.dataType, T.TimestampType):
        return F.try_to_timestamp(c) if isinstance(found, T.StringType) else c.cast("timestamp")
    if isinstance(field.dataType, T.BooleanType):
        return parse_flag(c)
    if isinstance(field.dataType, (T.DoubleType, T.IntegerType)):
        # Through DOUBLE, so that integers written as "24.0" are read.
        return aqi.nan_to_null(c.try_cast("double")).cast(field.dataType)
    return c.cast(field.dataType)


def normalise(df: DataFrame) -> DataFrame:
    """L1: the fixed columns and types; missing columns and bad values become NULL, extra columns go."""
    return df.select(*[_coerce(df, f).alias(f.name) for f in LEDGER_SCHEMA])


def new_records(forecasts: DataFrame) -> DataFrame:
    """L2: forecasts with ``horizon`` text as ledger rows that are not yet scored."""
    require_columns(
        forecasts,
        ["city", "forecast_created_at", "horizon", "predicted_aqi", "predicted_category", "model_name", "model_alias"],
        "forecasts",
    )
    rows = forecasts.withColumns(
        {
            "horizon_hours": horizon_hours(F.col("horizon")),
            "forecast_created_at": F.col("forecast_created_at").cast("timestamp"),
        }
    ).withColumn("target_timestamp", F.col("forecast_created_at") + F.make_interval(hours=F.col("horizon_hours")))
    return normalise(rows)


def record(ledger: DataFrame, forecasts: DataFrame) -> DataFrame:
    """L2 + J9: the ledger with the forecasts whose key it does not hold yet."""
    fresh = new_records(forecasts).join(ledger.select(*LEDGER_KEYS), LEDGER_KEYS, "left_anti")
    return ledger.unionByName(fresh.select(*LEDGER_COLUMNS))


def scores(due: DataFrame, actual: Column, now: Column) -> DataFrame:
    """``due`` with the columns a score fills, from the AQI that came; the category is worked out once, before what depends on it."""
    rows = due.withColumn("_actual", actual.cast("double")).withColumn("actual_category", aqi.category_of_prediction(F.col("_actual")))
    rows = rows.withColumn("category_distance", aqi.category_distance(F.col("actual_category"), F.col("predicted_category")))
    return rows.withColumns({
        "actual_aqi": F.col("_actual"),
        "absolute_error": F.abs(F.col("_actual") - F.col("predicted_aqi")),
        "category_correct": F.col("actual_category") == F.col("predicted_category"),
        "adjacent_category_correct": F.col("category_distance") <= 1,
        "evaluated_at": now.cast("timestamp"),
    }).drop("_actual")


def evaluate(ledger: DataFrame, history: DataFrame, now: Column) -> DataFrame:
    """L3 + J8: score pending forecasts whose hour has come and whose AQI is known.

    Of several rows of an hour the one observed last counts (``observed_at``, where the history has it), then the larger AQI.
    """
    require_columns(history, ["city", "timestamp", "aqi_current"], "history")
    seen = F.col("observed_at") if "observed_at" in history.columns else F.lit(None)
    actual = history.select(
        F.lower("city").alias("_city"),
        F.col("timestamp").cast("timestamp").alias("target_timestamp"),
        aqi.nan_to_null(F.col("aqi_current")).alias("_found"),
        seen.cast("timestamp").alias("_seen"),
    )
    # The last row of an hour decides, also if it holds no value.
    actual = dedupe(actual, ["_city", "target_timestamp"], [F.col("_seen"), F.col("_found")]).drop("_seen")
    actual = actual.where(F.col("_found").isNotNull() & (F.abs("_found") != float("inf")))
    rows = ledger.withColumn("_city", F.lower("city")).join(actual, ["_city", "target_timestamp"], "left")
    due = F.col("actual_aqi").isNull() & (F.col("target_timestamp") <= now)
    rows = rows.withColumn("_due", F.when(due, F.col("_found")))
    new = scores(rows.select(*[c for c in LEDGER_COLUMNS if c not in SCORED], "_due", F.struct(*SCORED).alias("_old")), F.col("_due"), now)
    return new.select(*[F.when(F.col("_due").isNotNull(), F.col(c)).otherwise(F.col(f"_old.{c}")).alias(c) if c in SCORED else F.col(c)
                        for c in LEDGER_COLUMNS])


def current_state(versions: DataFrame) -> DataFrame:
    """State of an append-only ledger: per key the scored version, else any."""
    order = [F.col("evaluated_at").isNotNull(), F.coalesce(F.col("evaluated_at"), F.to_timestamp(F.lit("1970-01-01")))]
    return dedupe(versions, LEDGER_KEYS, order)


def _summary_columns() -> list[Column]:
    done = F.col("actual_aqi").isNotNull()
    e = F.when(done, F.col("actual_aqi") - F.col("predicted_aqi"))
    n = F.count_if(done)

    def pct(condition):
        return F.try_divide(F.count_if(done & condition), n) * 100

    def flag_pct(name):
        return F.avg(F.when(done, F.col(name).cast("int"))) * 100

    return [
        n.alias("evaluated_forecasts"),
        F.min(F.when(~done, F.col("target_timestamp"))).alias("next_maturity"),
        F.avg(F.when(done, F.col("absolute_error"))).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        *[pct(F.col("absolute_error") <= k).alias(f"within_{k}_aqi_pct") for k in (10, 20, 30)],
        flag_pct("category_correct").alias("category_accuracy_pct"),
        flag_pct("adjacent_category_correct").alias("adjacent_category_accuracy_pct"),
    ]


def _finished(df: DataFrame) -> DataFrame:
    n = F.coalesce(F.col("evaluated_forecasts"), F.lit(0))
    iso = F.date_format(F.col("next_maturity").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return df.withColumns(
        {
            "evaluated_forecasts": n,
            "status": F.when(n > 0, AVAILABLE).otherwise(AWAITING),
            "next_maturity_at": iso,
        }
    ).drop("next_maturity")


def performance_summary(ledger: DataFrame, city: str | None = None) -> DataFrame:
    """L4 + J11: always one row per horizon; unknown flags are ignored."""
    rows = ledger if city is None else ledger.where(F.lower("city") == city.lower())
    live = rows.groupBy("horizon_hours").agg(*_summary_columns())
    spine = ledger.sparkSession.createDataFrame([(h,) for h in HORIZONS], "horizon_hours int")
    return _finished(spine.join(live, "horizon_hours", "left"))


def performance_by_city(ledger: DataFrame) -> DataFrame:
    """L4 for every city of the ledger at once, three rows each."""
    key = F.lower("city").alias("city_key")
    live = ledger.groupBy(key, "horizon_hours").agg(*_summary_columns())
    spine = ledger.groupBy(key).agg(F.min("city").alias("city"))
    spine = spine.withColumn("horizon_hours", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    return _finished(spine.join(live, ["city_key", "horizon_hours"], "left").drop("city_key"))


def combined_performance(ledger: DataFrame, holdout: DataFrame) -> DataFrame:
    """Live figures per city beside the holdout figures per horizon, with the city's overall status."""
    names = [c for c in holdout.columns if c != "horizon_hours"]
    fixed = holdout.select("horizon_hours", *[F.col(c).alias(f"holdout_{c}") for c in names])
    live = performance_by_city(ledger)
    totals = live.groupBy("city").agg(F.sum("evaluated_forecasts").alias("live_evaluated_forecasts"))
    totals = totals.withColumn(
        "live_status", F.when(F.col("live_evaluated_forecasts") > 0, AVAILABLE).otherwise(AWAITING)
    )
    return live.join(totals, "city").join(fixed, "horizon_hours", "left")


def monitoring_history(aqi_panel: DataFrame) -> DataFrame:
    """One AQI row per (city, hour): the one observed last (``observed_at``, where there is one), then the larger AQI."""
    names = ["city", "timestamp", "aqi_current", "aqi_category", "dominant_pollutant"]
    seen = ["observed_at"] if "observed_at" in aqi_panel.columns else []
    order = [*map(F.col, seen), F.coalesce(F.col("aqi_current"), F.lit(-1))]
    return dedupe(aqi_panel.select(*names, *seen), ["city", "timestamp"], order).select(*names)


def newest_agreement(monitoring: DataFrame, latest: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Does the newest pipeline row's AQI equal that of the full history?"""
    right = latest.select("city", "timestamp", F.col("aqi_current").alias("pipeline_aqi"))
    out = right.join(monitoring.select("city", "timestamp", F.col("aqi_current").alias("history_aqi")),
                     ["city", "timestamp"], "left")
    diff = F.abs(F.col("history_aqi") - F.col("pipeline_aqi"))
    return out.withColumn("matches", F.coalesce(diff <= tolerance, F.lit(False)))
