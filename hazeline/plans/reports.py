"""The answers of the service as DataFrames, for all cities at once; filter on ``city`` for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions import aqi
from hazeline.functions.exact import exact_avg, exact_std
from hazeline.functions.text import normalised_city
from hazeline.operators.explain import top_contributions
from hazeline.operators.ledger import combined_performance
from hazeline.operators.quality import healthy
from hazeline.operators.relational import newest_hours
from hazeline.schema import HORIZONS, KEYS

ALLOWED_HOURS = (24, 48, 72, 168)
OBSERVATION_COLUMNS = [
    "timestamp", "aqi_current", "aqi_category", "pm2_5", "pm10", "ozone", "nitrogen_dioxide", "sulphur_dioxide",
    "carbon_monoxide", "temperature", "humidity", "wind_speed",
]


def history_report(aqi_panel: DataFrame, hours: int = 168, observations: bool = True) -> DataFrame:
    """The newest hours with AQI per city and their statistics (population spread)."""
    if hours not in ALLOWED_HOURS:
        raise ValueError("History hours must be one of: 24, 48, 72, 168.")
    names = [c for c in OBSERVATION_COLUMNS if c in aqi_panel.columns]
    rows = newest_hours(aqi_panel.where(F.col("aqi_current").isNotNull()).select("city", *names), hours)
    x = F.col("aqi_current").cast("long")
    aggs = [
        F.min("timestamp").alias("start_time"),
        F.max("timestamp").alias("end_time"),
        F.lit(hours).alias("requested_hours"),
        F.count("*").alias("available_hours"),
        F.min(x).cast("double").alias("minimum"),
        F.max(x).cast("double").alias("maximum"),
        exact_avg(x).alias("average"),
        _population_spread(x).alias("standard_deviation"),
    ]
    if observations:
        # At most ``hours`` rows per city.
        aggs.append(F.array_sort(F.collect_list(F.struct(*names))).alias("observations"))
    return rows.groupBy("city").agg(*aggs)


def _population_spread(x: Column) -> Column:
    n = F.count(x).cast("double")
    total, squares = F.sum(x).cast("double"), F.sum(x * x).cast("double")
    return F.sqrt(F.greatest(n * squares - total * total, F.lit(0.0))) / n


def forecast_report(scored: DataFrame, contributions: DataFrame | None = None, top_n: int = 5) -> DataFrame:
    """R2: current state, alert and the three horizons of each city.

    ``scored`` has one row per (city, horizon) of the newest hour; ``contributions`` one row per (city, timestamp,
    horizon_hours) with its contribution array.
    """
    rows = scored.withColumns(
        {
            "target_at": F.col("timestamp") + F.make_interval(hours=F.col("horizon_hours")),
            "alert": aqi.alert(F.col("predicted_aqi")),
        }
    )
    keys = [*KEYS, "horizon_hours"]
    if contributions is not None:
        top = top_contributions(contributions, top_n, keys).groupBy(*keys).agg(
            F.array_sort(F.collect_list(F.struct("rank", "feature", "feature_value", "contribution", "direction"))).alias(
                "explanation")
        )
        rows = rows.join(top, keys, "left")
    else:
        rows = rows.withColumn("explanation", F.lit(None).cast("array<string>"))
    item = F.struct("horizon_hours", "target_at", "predicted_aqi", "predicted_category", "model_name", "model_alias",
                    "alert", "explanation")
    return rows.groupBy(*KEYS).agg(
        F.first("aqi_current").alias("current_aqi"),
        F.first("aqi_category").alias("current_category"),
        F.first("dominant_pollutant").alias("dominant_pollutant"),
        aqi.alert(F.first("aqi_current")).alias("current_alert"),
        F.array_sort(F.collect_list(item)).alias("forecasts"),
    )


def performance_report(ledger: DataFrame, holdout: DataFrame) -> DataFrame:
    """Live and holdout accuracy per city, three rows each."""
    return combined_performance(ledger, holdout)


def resolve_cities(requests: DataFrame, dimension: DataFrame, column: str = "requested") -> DataFrame:
    """Requested names to canonical ones; ``supported`` is false where there is none."""
    known = dimension.select(normalised_city(F.col("city")).alias("_n"), F.col("city").alias("canonical"))
    out = requests.withColumn("_n", normalised_city(F.col(column))).join(known, "_n", "left").drop("_n")
    return out.withColumn("supported", F.col("canonical").isNotNull())


def run_summary(newest: DataFrame, report: DataFrame, runtime_seconds: float = 0.0) -> DataFrame:
    """One row per city with pass or fail; a city with an unusable feature row fails alone."""

    def at(h):
        hit = F.filter("forecasts", lambda f: f["horizon_hours"] == h)
        return F.try_element_at(hit, F.lit(1))["predicted_aqi"].alias(f"forecast_{h}h")

    health = newest.select("city", healthy().alias("_ok"))
    out = health.join(report, "city", "left")
    ok = F.col("_ok") & (F.coalesce(F.size("forecasts"), F.lit(0)) == len(HORIZONS))
    return out.select(
        "city",
        ok.alias("success"),
        F.lit(runtime_seconds).alias("runtime_seconds"),
        "timestamp",
        "current_aqi",
        *[at(h) for h in HORIZONS],
        F.when(~ok, F.when(~F.col("_ok"), "feature row has missing or non-finite values").otherwise(
            "unexpected forecast horizons")).alias("error"),
    )
