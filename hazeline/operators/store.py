"""offline feature table, latest row per entity, retrieval parity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators.quality import dataset_contract, duplicate_keys, missing_total
from hazeline.schema import FEATURES, one_row, require_columns

ENTITY_KEYS = ["city_id", "event_timestamp"]


def offline_table(df: DataFrame) -> DataFrame:
    """(city_id, event_timestamp, created, 56 DOUBLE features)."""
    require_columns(df, ["city", "timestamp", *FEATURES], "feature panel")
    return df.select(
        F.col("city").cast("string").alias("city_id"),
        F.col("timestamp").alias("event_timestamp"),
        F.col("timestamp").alias("created"),
        *[F.col(c).cast("double").alias(c) for c in FEATURES],
    )


def offline_report(table: DataFrame) -> DataFrame:
    """the contract figures of the table in one row."""
    found = dataset_contract(table.withColumnRenamed("city_id", "city"), ts="event_timestamp").drop("passed")
    per_city = table.groupBy("city_id").agg(F.count("*").alias("n"))
    balanced = per_city.agg((F.min("n") == F.max("n")).alias("balanced"), F.min("n").alias("rows_per_city"))
    out = one_row(
        found,
        balanced,
        missing_total(table, FEATURES).withColumnRenamed("missing_values", "missing_feature_cells"),
        duplicate_keys(table, ENTITY_KEYS).withColumnRenamed("duplicates", "duplicate_rows"),
    ).withColumn("feature_count", F.lit(len(FEATURES)))
    ok = (F.col("missing_feature_cells") == 0) & (F.col("duplicate_rows") == 0) & F.col("balanced")
    return out.withColumn("passed", ok)


def write_offline(table: DataFrame, path: str) -> None:
    """Partitioned by entity and month, so that a point-in-time read prunes both; few files each, large ones split."""
    rows = table.withColumn("month", F.date_format("event_timestamp", "yyyy-MM")).hint("rebalance", "city_id", "month")
    rows.write.mode("overwrite").partitionBy("city_id", "month").parquet(path)


def latest_features(table: DataFrame) -> DataFrame:
    """newest row per entity; a maximum combines before the shuffle."""
    rest = [c for c in table.columns if c != "city_id"]
    newest = F.max_by(F.struct(*rest), F.struct("event_timestamp", "created"))
    return table.groupBy("city_id").agg(newest.alias("_r")).select("city_id", "_r.*")


def online_row(latest: DataFrame, city: str) -> DataFrame:
    """read-back by entity."""
    if not city:
        raise ValueError("City cannot be empty.")
    return latest.where(F.col("city_id") == city)


def retrieval_parity(
    expected: DataFrame, retrieved: DataFrame, keys: list[str], features: list[str] = FEATURES, tolerance: float = 1e-9
) -> DataFrame:
    """largest absolute difference per feature over common keys; wide sums, then 56 rows."""
    e = expected.select(*keys, *[F.col(c).cast("double").alias(f"e_{c}") for c in features])
    r = retrieved.select(*keys, *[F.col(c).cast("double").alias(f"r_{c}") for c in features])
    aggs = []
    for c in features:
        a, b = F.col(f"e_{c}"), F.col(f"r_{c}")
        differs = a.isNull() != b.isNull()
        aggs.append(
            F.struct(
                F.max(F.abs(a - b)).alias("max_absolute_difference"),
                F.count_if(differs).alias("only_one_side"),
            ).alias(c)
        )
    long = e.join(r, keys).agg(*aggs).unpivot([], features, "feature", "_s").select("feature", "_s.*")
    ok = (F.coalesce(F.col("max_absolute_difference"), F.lit(0.0)) <= tolerance) & (F.col("only_one_side") == 0)
    return long.withColumn("matches", ok)
